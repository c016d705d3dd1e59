"""Language-model scores by a probabilistic suffix tree over words (after Ron, Singer and Tishby, 1996).

Symbols are the words with A-Z lower-cased, and one mark that ends each text and stands before its first word.  Contexts are
the last word and the last two words.  A context of one word is retained from ``LEAST`` occurrences on; one of two words
if it has as many and the divergence of its next-symbol distribution from that of its suffix, times its count, exceeds a
description-length penalty.  A position takes its longest retained context: a next word seen there has Witten and Bell's
share, the rest goes to the suffix, at last to the counts of single words (add one).  The share of words already seen is
taken out when two words fall back on one, but not when one falls back on none, so probabilities add up to at most one.

Nothing bounds the number of contexts.  Each position is dealt by its last word, so that a task holds every context that ends
in it; words to look up without context are dealt by themselves, and what a task finds for a text by the text.  A word with
``HOT`` of all positions is dealt with the word before it, and a pair as frequent by the text.  Such contexts, at most
``1 / HOT``, are known everywhere, with each next word that has ``SHARE`` of all positions after them.  A bucket asks for the
counts of their other next words by the word and the next one, so scores don't depend on which contexts are hot.

A unigram model of words is learnt beside it, as a base: a word's count is how often it is the last word of a position.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from adlumen.llm.common import U, bucket_count, dealt, mixed, stored, word_hashes

LEAST = 2
HOT = 2e-3
# Contexts with fewer positions than this are never hot, so small tables know no such case.
HOT_LEAST = 100_000
SHARE = 2e-5
FLUSH = 1_000_000
PORTION = 1_000_000
BUCKET_MB, PARTS = 10, 16
# Sums of the base travel as multiples of 2^-28.
BASE_UNIT = 1 << 28
EDGE = U(1)
_WORD, _NEXT = U((1 << 32) - 1), U((1 << 40) - 1)
_STEP = U(0x9FB21C651E98DF25)


def learning_rows(docs: DataFrame, id_column: str, text_column: str, modulus: int, held: int) -> DataFrame:
    """``doc_id, uid, text, held_out``; ``uid`` names a row's id and text, a null id is not held out."""
    doc, text = F.col(id_column).cast("long"), F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    out = F.coalesce(F.pmod(F.crc32(doc.cast("string").cast("binary")), F.lit(modulus)) == held, F.lit(False))
    return docs.select(doc.alias("doc_id"), F.xxhash64(doc, text).alias("uid"), text.alias("text"), out.alias("held_out"))


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of two words in a row, from 32 and 40 bits of their hashes."""
    return mixed((a & _WORD) * _STEP + (b & _NEXT))


def joint(context: np.ndarray, following: np.ndarray) -> np.ndarray:
    """The name of a pair and the word after it."""
    return mixed(context * _STEP + (following & _NEXT))


def positions(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word before last, the last word and the next one, for each position of a text."""
    every = np.concatenate((np.full(2, EDGE), words, np.full(1, EDGE)))
    return every[:-2], every[1:-1], every[2:]


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys stand together, and where each group begins."""
    order = np.argsort(key)
    sorted_key = key[order]
    return order, np.flatnonzero(np.concatenate((np.ones(min(len(key), 1), dtype=bool), sorted_key[1:] != sorted_key[:-1])))


def _sums(values: np.ndarray, order: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum over its group for each row, in the rows' own order."""
    out = np.empty(len(order), dtype=values.dtype)
    out[order] = np.repeat(np.add.reduceat(values[order], at), np.diff(np.append(at, len(order))))
    return out


def _found(names: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is among the sorted names, and where."""
    if not len(names):
        return np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.int64)
    place = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    return names[place] == keys, place


def _planes(values: np.ndarray, width: int = 4) -> bytes:
    """The lowest ``width`` bytes of each number, all first bytes first: small numbers compress to little."""
    return values.astype("<u8").view("u1").reshape(-1, 8)[:, :width].T.tobytes()


def _from_planes(blob: bytes, width: int = 4) -> np.ndarray:
    planes = np.frombuffer(blob, dtype="u1").reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), dtype="u1")
    out[:, :width] = planes.T
    return out.view("<u8").ravel()


def _sorted_ids(ids: np.ndarray) -> bytes:
    """Sorted numbers as differences, of which the highest bytes are mostly zero."""
    return _planes(np.diff(ids.astype(U), prepend=U(0)), 8)


def _from_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(blob, 8), dtype=U)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, np.ndarray]]:
    for batch in batches:
        uids, texts, out = (batch.column(i).to_pylist() for i in range(3))
        yield from zip(uids, out, word_hashes([t.encode() for t in texts]))


def _portions(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Positions of many texts at a time, and whether each is held out."""
    held: list[tuple] = []
    n = 0

    def joined() -> tuple:
        out = tuple(np.concatenate([h[i] for h in held]) for i in range(4))
        held.clear()
        return out

    for _, out, words in _texts(batches):
        held.append((*positions(words), np.full(len(words) + 1, out)))
        n += len(words) + 1
        if n >= size:
            yield joined()
            n = 0
    if held:
        yield joined()


# ---- hot contexts --------------------------------------------------------------------------------------------------


def names_of(before: np.ndarray, last: np.ndarray, following: np.ndarray) -> list[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """Contexts of both lengths and what follows them: kind, context, name without the first word, and name of each position."""
    pair, after = paired(before, last), paired(last, following)
    return [("word", last, last, last), ("pair", pair, last, pair), ("after word", last, following, after), ("after pair", pair, after, joint(pair, following))]


KINDS = ("word", "pair", "after word", "after pair")


def candidates(rows: DataFrame, share: float = SHARE) -> DataFrame:
    """``kind, context, suffix, name``: contexts, and next words in a context, that are frequent in a portion that a task counts.

    What has ``share`` of all positions has it in at least one portion.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for before, last, following, _ in _portions(batches, PORTION):
            for kind, context, suffix, name in names_of(before, last, following):
                found, first, n = np.unique(name, return_index=True, return_counts=True)
                keep = n >= max(share * len(name), 8)
                columns = [pa.array([kind] * int(keep.sum()), pa.string()), *(pa.array(x.astype(np.int64)) for x in (context[first[keep]], suffix[first[keep]], found[keep]))]
                yield pa.RecordBatch.from_arrays(columns, names=["kind", "context", "suffix", "name"])

    return rows.select("uid", "text", "held_out").mapInArrow(run, "kind string, context long, suffix long, name long").distinct()


def hot_contexts(rows: DataFrame, hot: float = HOT, hot_least: int = HOT_LEAST, share: float | None = None) -> dict:
    """Hot words and pairs with their learning counts, and the frequent words after them; also all learning positions.

    At most ``1 / hot`` contexts of a kind, of ``2 / share`` candidates.  Counts are exact.  If a ``share`` is given, the
    other next words are ``estimated``: together they have what is ``left``.
    """
    estimated, share = share is not None, SHARE if share is None else share
    found = stored(candidates(rows, share)).toPandas()
    names = {k: np.sort(found["name"][found["kind"] == k].to_numpy().astype(U)) for k in KINDS}
    shared = rows.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value
        total = {k: np.zeros((2, len(v) + 1), dtype=np.int64) for k, v in names.items()}
        for before, last, following, out in _portions(batches, FLUSH):
            for kind, _, _, name in names_of(before, last, following):
                there, place = _found(names[kind], name)
                for row, some in ((0, there), (1, there & ~out)):
                    total[kind][row, :-1] += np.bincount(place[some], minlength=len(names[kind]))[: len(names[kind])]
                total[kind][:, -1] += len(name), int((~out).sum())
        for kind, (every, learnt) in total.items():
            some = np.flatnonzero(every)
            columns = [pa.array([kind] * len(some), pa.string()), pa.array(some), pa.array(every[some]), pa.array(learnt[some])]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "place", "every", "learnt"])

    counted = rows.select("uid", "text", "held_out").mapInArrow(run, "kind string, place long, every long, learnt long")
    sums = counted.groupBy("kind", "place").agg(F.sum("every").alias("every"), F.sum("learnt").alias("learnt")).toPandas()
    every, learnt = ({k: np.zeros(len(v) + 1, dtype=np.int64) for k, v in names.items()} for _ in range(2))
    for k, g in sums.groupby("kind"):
        every[k][g["place"]], learnt[k][g["place"]] = g["every"], g["learnt"]
    total = int(every["word"][-1])
    limit = max(share * total, 1.0)
    out: dict = {"positions": int(learnt["word"][-1]), "limit": limit, "estimated": estimated}
    for kind in KINDS[:2]:
        keep = every[kind][:-1] >= max(hot * total, hot_least)
        name, n = names[kind][keep], learnt[kind][:-1][keep]
        part, after = (found[found["kind"] == k].sort_values("name", key=lambda c: c.to_numpy().astype(U)) for k in (kind, f"after {kind}"))
        of, times = after["context"].to_numpy().astype(U), learnt[f"after {kind}"][:-1]
        there, place = _found(name, of)
        listed = there & (times >= limit)
        left = n.copy()
        np.subtract.at(left, place[listed], times[listed])
        out[kind] = {"name": name, "n": n, "left": left, "after": names[f"after {kind}"][listed], "times": times[listed]}
        # By places: the context of each next word, and the word that ends a pair; by name: a next word's suffix.
        out[kind] |= {"of": place[listed], "suffix": after["suffix"].to_numpy().astype(U)[listed], "word": _found(out["word"]["name"], part["suffix"].to_numpy().astype(U)[keep])[1]}
    return out


def questions(rows: DataFrame, buckets: int, shared) -> DataFrame:
    """Next words of hot contexts that aren't listed, a row for each bucket that asks for them (``sender``), dealt by the
    last word and the next one: ``target, sender, context, following, n``.

    A context is the place of a hot word, or of a hot pair behind all words; ``n`` are learning positions of the sender.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        words = len(hot["word"]["name"])
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            target, sender, context, following, n = (np.concatenate([h[i] for h in held]) for i in range(5))
            held.clear()
            order = np.lexsort((following, context, sender, target))
            target, sender, context, following, n = (x[order] for x in (target, sender, context, following, n))
            new = np.concatenate(([True], (np.diff(target) != 0) | (np.diff(sender) != 0) | (np.diff(context) != 0) | (following[1:] != following[:-1])))
            at = np.flatnonzero(new)
            columns = [target[at], sender[at], context[at], following[at], np.add.reduceat(n, at)]
            out = [(b, _planes(s), _planes(c), _planes(f, 5), _planes(k)) for b, (s, c, f, k) in dealt(columns[0], columns[1:])]
            blobs = [pa.array([o[i] for o in out], pa.binary()) for i in range(1, 5)]
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), *blobs], names=["target", "sender", "context", "following", "n"])

        for uid, out, text in _texts(batches):
            before, last, following = positions(text)
            is_hot, word = _found(hot["word"]["name"], last)
            if not is_hot.any():
                continue
            before, last, following, word = before[is_hot], last[is_hot], following[is_hot], word[is_hot]
            pair, name = paired(before, last), paired(last, following)
            hot_pair, place = _found(hot["pair"]["name"], pair)
            sender = (mixed(np.where(hot_pair, U(uid & 0xFFFFFFFFFFFFFFFF), pair)) % U(buckets)).astype(np.int64)
            target = (mixed(name) % U(buckets)).astype(np.int64)
            for ask, context in (
                (~_found(hot["word"]["after"], name)[0], word), (hot_pair & ~_found(hot["pair"]["after"], joint(pair, following))[0], words + place)
            ):
                held.append((target[ask], sender[ask], context[ask], following[ask] & _NEXT, np.full(int(ask.sum()), int(not out))))
                size += len(held[-1][0])
            if size >= FLUSH:
                yield flush()
                size = 0
        if size:
            yield flush()

    return rows.select("uid", "text", "held_out").mapInArrow(run, "target int, sender binary, context binary, following binary, n binary")


def answers(asked: DataFrame, shared) -> DataFrame:
    """For each ``bucket`` that asked the learning counts of next words (``name, times``); for each ``context`` the number of
    its next words that were asked for and learnt (``kinds``), and of a pair's their part of ``gain`` and ``taken``.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hot = shared.value
        words = len(hot["word"]["name"])
        sender, context, n = (np.concatenate([_from_planes(x) for x in pdf[c]]).astype(np.int64) for c in ("sender", "context", "n"))
        following = np.concatenate([_from_planes(x, 5) for x in pdf["following"]])
        is_pair = context >= words
        place = np.where(is_pair, context - words, 0)
        word = np.where(is_pair, hot["pair"]["word"][place], context) if is_pair.any() else context
        after = paired(hot["word"]["name"][word], following)
        name = np.where(is_pair, joint(hot["pair"]["name"][place], following), after) if is_pair.any() else after
        order, at = _groups(name)
        times = _sums(n, order, at)
        first = order[at]
        first = first[times[first] > 0]
        ending = first[is_pair[first]]
        known, counts = np.concatenate((name[first], hot["word"]["after"])), np.concatenate((times[first], hot["word"]["times"]))
        by_name = np.argsort(known)
        there, where = _found(known[by_name], after[ending])
        gain, taken = np.zeros(len(name)), np.zeros(len(name))
        taken[ending] = counts[by_name][where]
        gain[ending] = times[ending] * np.log(times[ending] / taken[ending])
        sums = [np.bincount(context[first], x, minlength=1) for x in (None, gain[first], taken[first])]
        order = np.lexsort((name, sender))
        sender, name, times = (x[order] for x in (sender, name, times))
        new = np.concatenate(([True], (np.diff(sender) != 0) | (name[1:] != name[:-1])))
        rows = [(b, _sorted_ids(x), _planes(t), None, 0, 0.0, 0.0) for b, (x, t) in dealt(sender[new], [name[new], times[new]])]
        rows += [(None, None, None, int(c), int(sums[0][c]), float(sums[1][c]), float(sums[2][c])) for c in np.flatnonzero(sums[0])]
        columns = ["bucket", "name", "times", "context", "kinds", "gain", "taken"]
        return pd.DataFrame(rows, columns=columns).astype({"bucket": "Int32", "context": "Int32"})

    return asked.groupBy("target").applyInPandas(run, "bucket int, name binary, times binary, context int, kinds long, gain double, taken double")


def settled(known: dict, found: DataFrame) -> dict:
    """``known`` with the number of kinds of next words of each hot context, and of pairs the whole ``gain`` and ``taken``."""
    sums = found.filter("context IS NOT NULL").groupBy("context").agg(*[F.sum(c).alias(c) for c in ("kinds", "gain", "taken")]).toPandas()
    word, pair = known["word"], known["pair"]
    words, pairs = len(word["name"]), len(pair["name"])
    kinds, gain, taken = np.zeros(words + pairs, dtype=np.int64), np.zeros(words + pairs), np.zeros(words + pairs)
    at = sums["context"].to_numpy(dtype=np.int64)
    kinds[at], gain[at], taken[at] = (sums[c] for c in ("kinds", "gain", "taken"))
    np.add.at(kinds, np.concatenate((word["of"], words + pair["of"])), 1)
    # A pair's frequent next word is as frequent after its last word.
    times = word["times"][_found(word["after"], pair["suffix"])[1]] if len(pair["after"]) else np.zeros(0)
    np.add.at(gain, words + pair["of"], pair["times"] * np.log(pair["times"] / times))
    np.add.at(taken, words + pair["of"], times)
    size = (word["n"] + kinds[:words])[pair["word"]]
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = gain[words:] + np.where(pair["n"] > 0, pair["n"] * np.log(size / pair["n"]), 0.0)
        share = np.minimum(taken[words:] / size, 1 - 1e-9)
    return known | {"word": word | {"kinds": kinds[:words]}, "pair": pair | {"kinds": kinds[words:], "gain": whole, "taken": share}}


# ---- the tree ------------------------------------------------------------------------------------------------------


def position_entries(rows: DataFrame, buckets: int, shared) -> DataFrame:
    """Distinct positions of each row, by their last words, each with the number of its positions: ``bucket, words, n``.

    A position has ``before`` and ``following``, the place ``which`` of its row among ``uids`` and ``times`` (doubled, plus 1
    if held out).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            held.sort(key=lambda h: h[4] & 0xFFFFFFFFFFFFFFFF)
            last, before, following, times = (np.concatenate([h[i] for h in held]) for i in range(4))
            row = np.repeat(np.arange(len(held)), [len(h[0]) for h in held])
            uids = np.array([h[4] for h in held], dtype=np.int64)
            held.clear()
            pair = paired(before, last)
            key = np.where(_found(hot["word"]["name"], last)[0], pair, last)
            key = np.where(_found(hot["pair"]["name"], pair)[0], uids[row].astype(U), key)
            order = np.argsort(last, kind="stable")
            out = []
            for b, (x, p, w, r, t) in dealt((mixed(key) % U(buckets)).astype(np.int64)[order], [c[order] for c in (last, before, following, row, times)]):
                _, at = _groups(x)
                rows_here, which = np.unique(r, return_inverse=True)
                out.append(
                    (b, _sorted_ids(x[at]), _planes(np.diff(np.append(at, len(x)))), p.astype("<u4").tobytes(), _planes(w, 5), _sorted_ids(uids[rows_here]), _planes(which), _planes(t))
                )
            blobs = [pa.array([o[i] for o in out], pa.binary()) for i in range(1, 8)]
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), *blobs], names=["bucket", "words", "n", "before", "following", "uids", "which", "times"])

        for uid, out, words in _texts(batches):
            before, last, following = positions(words)
            _, first, n = np.unique(joint(paired(before, last), following), return_index=True, return_counts=True)
            held.append((last[first], before[first], following[first], n * 2 + out, uid))
            size += len(n)
            if size >= FLUSH:
                yield flush()
                size = 0
        if held:
            yield flush()

    return rows.select("uid", "text", "held_out").mapInArrow(run, "bucket int, words binary, n binary, before binary, following binary, uids binary, which binary, times binary")


def context_scores(last: np.ndarray, before: np.ndarray, following: np.ndarray, n: np.ndarray, held: np.ndarray, hot: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each position the log10 of its probability, whether that of the next word alone is a further factor, and the
    learning count of the last word.

    All learning positions of a context that isn't hot must be among those given.  Of hot ones ``hot`` has the counts, unless
    they are estimated.
    """
    learnt = np.where(held, 0, n).astype(np.int64)
    penalty = 0.5 * math.log(max(hot["positions"], 2))
    pair = paired(before, last)
    # Without a context a word's own probability is all there is.
    log, root = np.zeros(len(n)), np.ones(len(n), dtype=bool)
    # Where a hot suffix has no share of its own for the word, what it can be at most.
    ceiling = np.zeros(len(n))
    count = learnt
    with np.errstate(divide="ignore", invalid="ignore"):
        for kind, context, name in (("word", last, paired(last, following)), ("pair", pair, joint(pair, following))):
            in_context = _groups(context)
            order, at = _groups(name)
            every, times = _sums(learnt, *in_context), _sums(learnt, order, at)
            is_hot, place = _found(hot[kind]["name"], context)
            settled_here = is_hot.any() and not hot["estimated"]
            listed, where = _found(hot[kind]["after"], name)
            # One row of each next word speaks for all.
            speaks = np.zeros(len(n), dtype=bool)
            speaks[order[at]] = True
            speaks &= times > 0
            kinds = _sums(speaks.astype(np.int64), *in_context)
            if settled_here:
                every, kinds = (np.where(is_hot, hot[kind][c][place], x) for c, x in (("n", every), ("kinds", kinds)))
                times = np.where(is_hot, np.where(listed, hot[kind]["times"][where], 0) if listed.any() else 0, times)
                there, where_told = _found(hot["told"][0], name)
                times = np.where(is_hot & there & ~listed, hot["told"][1][where_told], times) if there.any() else times
            retained, taken = every >= LEAST, np.zeros(len(n))
            if kind == "pair":
                suffix = np.where(root, ceiling, log)
                gain = np.where(speaks, times * (np.log(times / every) - suffix * math.log(10)), 0.0)
                gain = _sums(gain, *in_context)
                taken = np.minimum(_sums(np.where(speaks & ~root, 10.0**log, 0.0), *in_context), 1 - 1e-9)
                if settled_here:
                    gain, taken = (np.where(is_hot, hot[kind][c][place], x) for c, x in (("gain", gain), ("taken", taken)))
                retained &= gain > penalty * kinds
            seen = times > 0
            own = np.log10(times / (every + kinds))
            other = log + np.log10(kinds / (every + kinds)) - np.log10(1 - taken)
            now, now_root = np.where(retained, np.where(seen, own, other), log), root & ~(retained & seen)
            if kind == "word":
                count = every
            if is_hot.any() and hot["estimated"]:
                total, left = (np.where(is_hot, hot[kind][c][place], 0) for c in ("n", "left"))
                listed &= is_hot
                share = np.zeros(len(n))
                share[listed] = np.log10(hot[kind]["times"][where[listed]] / (total[listed] + 1))
                now = np.where(listed, share, np.where(is_hot, log + np.log10((left + 1) / (total + 1)), now))
                now_root = np.where(is_hot, root & ~listed, now_root)
                if kind == "word":
                    count = np.where(is_hot, total, every)
                    ceiling = np.where(is_hot, np.minimum(np.log10(hot["limit"] / (total + 1)), 0.0), 0.0)
            log, root = now, now_root
    return log, root, count


FOUND = "target int, uid binary, score binary, roots binary, base binary, unknown binary, tokens binary, kinds long"


def found_in_buckets(entries: DataFrame, buckets: int, shared, told: DataFrame | None = None) -> DataFrame:
    """What each bucket finds for a row, dealt by ``uid``; beyond ``buckets``, single words to look up, dealt by the word.

    A row for words has the ids of those who ask, the words and how often they are asked for (``uid, score, roots``), and
    words with their learning counts (``base, unknown``).  ``told`` are the answers to what the buckets asked.
    """

    def run(pdf: pd.DataFrame, told: pd.DataFrame | None = None) -> pd.DataFrame:
        hot = shared.value | {"told": (np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64))}
        if told is not None and len(told):
            name = np.concatenate([_from_sorted(x) for x in told["name"]])
            order = np.argsort(name)
            hot["told"] = name[order], np.concatenate([_from_planes(x) for x in told["times"]]).astype(np.int64)[order]
        last = np.concatenate([np.repeat(_from_sorted(w), _from_planes(n).astype(np.int64)) for w, n in zip(pdf["words"], pdf["n"])])
        ids = [_from_sorted(u).astype(np.int64) for u in pdf["uids"]]
        begin = np.cumsum([0, *(len(u) for u in ids)])
        ids, row = np.concatenate(ids), np.concatenate([(_from_planes(w) + U(b)).astype("<u4") for b, w in zip(begin.tolist(), pdf["which"])])
        before = np.concatenate([np.frombuffer(x, dtype="<u4") for x in pdf["before"]])
        following = np.concatenate([_from_planes(x, 5) for x in pdf["following"]])
        times = np.concatenate([_from_planes(x).astype("<u4") for x in pdf["times"]])
        sums, asks, tells = [], [], []
        # A part of the contexts at a time, to bound what stands in memory.
        portion = ((last >> U(40)) % U(PARTS)).astype(np.uint8)
        for i in range(PARTS):
            part = np.flatnonzero(portion == i)
            if not len(part):
                continue
            t = times[part].astype(np.int64)
            n, held, u, following_here = t >> 1, (t & 1).astype(bool), ids[row[part]], following[part]
            log, root, count = context_scores(last[part], before[part].astype(U), following_here, n, held, hot)
            order, at = _groups(u)
            sums.append((u[order][at], *(np.add.reduceat(x[order], at) for x in (n * log, n * root, n * np.log10(count + 1.0), n * (count == 0), n))))
            asks.append((u[root], following_here[root], n[root]))
            order, at = _groups(last[part])
            words, counts = last[part][order][at], count[order][at]
            new = (counts > 0) & ~_found(hot["word"]["name"], words)[0]
            tells.append((words[new] & _NEXT, counts[new]))
        uids, *own = (np.concatenate(x) for x in zip(*sums))
        order, at = _groups(uids)
        uids, own = uids[order][at], [np.add.reduceat(x[order], at) for x in own]
        out = [
            (b, _planes(np.diff(u, prepend=np.int64(0)), 8), s.astype("<f4").tobytes(), _planes(r), _planes(np.rint(x * BASE_UNIT).astype(np.int64), 7), _planes(k), _planes(t), 0)
            for b, (u, s, r, x, k, t) in dealt((mixed(uids.astype(U)) % U(buckets)).astype(np.int64), [uids, *own])
        ]
        ask_uid, ask_word, ask_n = (np.concatenate(x) for x in zip(*asks))
        tell_word, tell_count = (np.concatenate(x) for x in zip(*tells))
        out[0] = (*out[0][:-1], len(tell_word))
        asked = dict(dealt((mixed(ask_word) % U(buckets)).astype(np.int64), [ask_uid, ask_word, ask_n]))
        told = dict(dealt((mixed(tell_word) % U(buckets)).astype(np.int64), [tell_word, tell_count]))
        for b in asked.keys() | told.keys():
            u, w, t = asked.get(b, [np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)])
            v, c = told.get(b, [np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)])
            out.append((buckets + b, _planes(np.diff(u, prepend=np.int64(0)), 8), _planes(w, 5), _planes(t), _planes(v, 5), _planes(c, 8), b"", 0))
        return pd.DataFrame(out, columns=["target", "uid", "score", "roots", "base", "unknown", "tokens", "kinds"])

    if told is None:
        return entries.groupBy("bucket").applyInPandas(lambda pdf: run(pdf), FOUND)
    return entries.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInPandas(lambda pdf, told: run(pdf, told), FOUND)


def row_sums(found: DataFrame, buckets: int, shared) -> DataFrame:
    """Sums of each ``uid``: ``score, roots, base, known, tokens``; and ``kinds``, distinct words, to be summed over all."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        def numbers(column: str, width: int = 4) -> np.ndarray:
            return np.concatenate([_from_planes(x, width) for x in pdf[column]]).astype(np.int64)

        uid = np.concatenate([np.cumsum(_from_planes(x, 8).astype(np.int64)) for x in pdf["uid"]])
        if pdf["target"].iloc[0] < buckets:
            score, base = np.concatenate([np.frombuffer(x, dtype="<f4") for x in pdf["score"]]), numbers("base", 7) / BASE_UNIT
            roots, tokens = numbers("roots"), numbers("tokens")
            known = tokens - numbers("unknown")
        else:
            asked, times, word, count = numbers("score", 5).astype(U), numbers("roots"), numbers("base", 5).astype(U), numbers("unknown", 8)
            hot = shared.value["word"]
            word, count = np.concatenate((word, hot["name"] & _NEXT)), np.concatenate((count, hot["n"]))
            order = np.argsort(word)
            there, place = _found(word[order], asked)
            score = times * np.log10(np.where(there, count[order][place] if len(word) else 0, 0) + 1.0)
            roots = known = tokens = np.zeros(len(uid), dtype=np.int64)
            base = np.zeros(len(uid))
        order, at = _groups(uid)
        if not len(at):
            return pd.DataFrame({c: [] for c in ("uid", "score", "roots", "base", "known", "tokens", "kinds")})
        out = pd.DataFrame({"uid": uid[order][at], **{k: np.add.reduceat(v[order].astype(float if k in ("score", "base") else np.int64), at) for k, v in (("score", score), ("roots", roots), ("base", base), ("known", known), ("tokens", tokens))}})
        out["kinds"] = 0
        out.loc[0, "kinds"] = pdf["kinds"].sum()
        return out

    sums = found.groupBy("target").applyInPandas(run, "uid long, score double, roots long, base double, known long, tokens long, kinds long")
    return sums.groupBy("uid").agg(*[F.sum(c).alias(c) for c in ("score", "roots", "base", "known", "tokens", "kinds")])


def scored(
    docs: DataFrame, modulus: int = 7, held: int = 2, id_column: str = "doc_id", text_column: str = "text", hot: float = HOT, hot_least: int = HOT_LEAST, share: float | None = None,
) -> DataFrame:
    """Each row's ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Rows whose crc32 of the id, modulo ``modulus``, is ``held`` are not learnt from.  A null or empty text has its end
    as only token.  Rows with equal ids or texts count each for itself, in learning too.  Extra columns are ignored; an
    empty table gives an empty result, and without learning rows every word has probability one, as the base has it.
    Scores don't depend on ``hot`` and ``hot_least``, but with a ``share`` next words of hot contexts are estimated.
    """
    buckets = bucket_count(docs, text_column, BUCKET_MB)
    rows = learning_rows(docs, id_column, text_column, modulus, held)
    known = hot_contexts(rows, hot, hot_least, share)
    broadcast, told = docs.sparkSession.sparkContext.broadcast, None
    if share is None and len(known["word"]["name"]):
        first = broadcast(known)
        found = stored(answers(questions(rows, buckets, first), first))
        known, told = settled(known, found), found.filter("bucket IS NOT NULL").select("bucket", "name", "times")
    shared = broadcast(known)
    sums = stored(row_sums(found_in_buckets(position_entries(rows, buckets, shared), buckets, shared, told), buckets, shared))
    n = known["positions"]
    kinds = (sums.agg(F.sum("kinds")).first()[0] or 0) + int((known["word"]["n"] > 0).sum())
    out = rows.select("doc_id", "uid", "held_out")
    # Rows alike in id and text have added up under one uid.
    copies = out.groupBy("uid").agg(F.count("*").alias("copies"))
    each = sums.drop("kinds").join(copies, "uid")
    all_words = math.log10(n + kinds + 1)
    return out.join(each, "uid").select(
        "doc_id", "held_out", (F.col("tokens") / F.col("copies")).cast("long").alias("n_tokens"), (F.col("known") / F.col("copies")).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), ((F.col("base") - F.col("tokens") * all_words) / F.col("copies")).alias("base_score"),
        ((F.col("score") - F.col("roots") * all_words) / F.col("copies")).alias("score"),
    )
