"""Exact removal of repeated byte strings by bucket-pointer refinement of suffixes (after Schuermann and Stoye, 2007).

A string of ``WINDOW`` bytes is repeated if it also starts in a document with a smaller id.  Three steps:

1. *q-gram buckets.*  Every window has an anchor: of its ``Q``-grams, the leftmost with the smallest hash.  Equal windows
   have equal anchors at equal places, so suffixes are dealt by their anchor's q-gram, about one entry for 18 bytes.  An
   entry stands for the run of windows that share the anchor, and holds the hash of the run's text.  In a bucket of one
   q-gram, runs with equal text are settled at once: all but those of the smallest document repeat.
2. *Refinement.*  Where a bucket has runs of different texts, it is refined by the identifiers of the longer strings at
   either side of the anchor.  What is then left together is cut from the documents, and all its suffixes are sorted: by their first 8 bytes, then by pairs of bucket identifiers at offsets 8, 16 and 18, each pass
   using the identifiers the pass before has left, until a bucket is one string of 50 bytes.  Every task settles what
   repeats among its own runs; the first of each string goes on to a grouping by its hash.
3. *Spans.*  The windows found are merged per document into spans of bytes.

Results are exact up to collisions of 64-bit hashes.  No step holds a document whole but the one that cuts it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from adlumen.llm.common import U, bucket_count, dealt, mixed, packed_ids, prefix_hash, range_hash, stored, unpacked_ids

WINDOW, Q = 50, 16
# Windows that start at least HALF + 1 bytes before their anchor hold the bytes from there to the end of its q-gram,
# the others hold Q + HALF bytes from the anchor on.
HALF = (WINDOW - Q) // 2
SIDE = (1 << 24) - 1
PIECE = 1 << 18
BLOCK = 1 << 19
PLACE = 20
FLUSH = 700_000
NOBODY = np.iinfo(np.int64).max
# Spans and runs of documents are sent to all tasks up to this many bytes, else joined by shuffle.
BROADCAST_BYTES = 48 << 20
_ENTRY = "bucket int, gram binary, text binary, left binary, right binary, doc binary, uid binary, start binary, run binary"
_FOUND = "ubucket int, uid binary, start binary, run binary"


def runs_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in pieces laid end to end.

    First window, windows, hash of the anchor's q-gram, hash of the text, and 24-bit identifiers of the longer strings to
    the left and right of the anchor that some of the windows hold (0: none does).
    """
    n = len(data)
    if n < WINDOW:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=U),) * 4
    words = np.ndarray(shape=(n - 7,), dtype="<u8", buffer=data, strides=(1,))
    gram = mixed(mixed(words[: n - Q + 1]) + words[8 : n - Q + 9])
    key = (gram & ~U((1 << PLACE) - 1)) | np.arange(len(gram), dtype=U)
    least, width, wanted = key, 1, WINDOW - Q + 1
    while 2 * width <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = wanted - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    starts = np.concatenate(([0], ends[:-1]))
    inside = np.zeros(n + 1, dtype=np.int32)
    long = ends - starts >= WINDOW
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - WINDOW + 1, -1)
    window = np.flatnonzero(np.cumsum(inside)[: len(least)])
    if not len(window):
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=U),) * 4
    anchor = (least[window] & U((1 << PLACE) - 1)).astype(np.int64)
    at = np.flatnonzero(np.diff(anchor, prepend=-1))
    first, count, anchor = window[at], np.diff(np.append(at, len(window))), anchor[at]
    prefix = prefix_hash(data)
    text = range_hash(prefix, first, first + count - 1 + WINDOW)
    to_left, to_right = anchor - first > HALF, anchor - (first + count - 1) <= HALF
    left = range_hash(prefix, np.maximum(anchor - HALF - 1, 0), anchor + Q) % U(SIDE) + U(1)
    right = range_hash(prefix, anchor, np.minimum(anchor + Q + HALF, n)) % U(SIDE) + U(1)
    text = mixed(text + (anchor - first).astype(U) * U(0x9E3779B97F4A7C15))
    return first, count, gram[anchor], text, np.where(to_left, left, U(0)), np.where(to_right, right, U(0))


def packed_sides(x: np.ndarray) -> bytes:
    return x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def unpacked_sides(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 3, 4), dtype=np.uint8)
    out[:, :3] = np.frombuffer(blob, dtype=np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel().astype(U)


def pieces(text: bytes) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of pieces that hold each window of the text once."""
    for at in range(0, max(len(text) - WINDOW + 1, 0), PIECE):
        yield at, text[at : at + PIECE + WINDOW - 1]


def _rows(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``doc`` orders documents (a null id is the largest); ``uid`` names a row's id and text."""
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    doc = F.col(id_column).cast("long")
    return docs.select(F.coalesce(doc, F.lit(NOBODY)).alias("doc"), F.xxhash64(doc, text).alias("uid"), text.alias("text"))


def _entries(rows: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        block: list[tuple[int, int, int, bytes]] = []
        size = count = 0

        def settle() -> int:
            data = np.frombuffer(b"".join(b for *_, b in block), dtype=np.uint8)
            ends = np.cumsum([len(b) for *_, b in block])
            first, windows, gram, text, left, right = runs_of(data, ends)
            which = np.searchsorted(ends, first, side="right")
            doc, uid, place = (np.array([b[i] for b in block], dtype=np.int64)[which] for i in range(3))
            base = np.concatenate(([0], ends[:-1]))[which]
            held.append((gram, text, left, right, doc, uid, first - base + place, windows))
            block.clear()
            return len(first)

        def flush() -> pa.RecordBatch:
            gram, text, left, right, doc, uid, start, windows = (np.concatenate(x) for x in zip(*held))
            held.clear()
            bucket = (gram % U(buckets)).astype(np.int64)
            rows = [
                (b, g.astype("<u4").tobytes(), t.tobytes(), packed_sides(x), packed_sides(y), packed_ids(d), packed_ids(u), packed_ids(s), w.astype(np.uint8).tobytes())
                for b, (g, t, x, y, d, u, s, w) in dealt(bucket, [gram >> U(32), text, left, right, doc, uid, start, windows])
            ]
            kinds = [pa.int32()] + [pa.binary()] * 8
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                names=["bucket", "gram", "text", "left", "right", "doc", "uid", "start", "run"],
            )

        for batch in batches:
            docs, uids = (batch.column(i).to_pylist() for i in (0, 1))
            for doc, uid, text in zip(docs, uids, batch.column(2)):
                for place, piece in pieces(text.as_buffer().to_pybytes()):
                    block.append((doc, uid, place, piece))
                    size += len(piece)
                    if size >= BLOCK:
                        count += settle()
                        size = 0
                        if count >= FLUSH:
                            yield flush()
                            count = 0
        if block:
            settle()
        if held:
            yield flush()

    return rows.mapInArrow(run, _ENTRY)


def _least(group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The smallest document of each row's group; groups follow each other."""
    at = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    return np.repeat(np.minimum.reduceat(doc, at), np.diff(np.append(at, len(group)))) if len(group) else doc


def _found(uid: np.ndarray, start: np.ndarray, run: np.ndarray, buckets: int) -> pd.DataFrame:
    order = np.lexsort((start, uid))
    uid, start, run = uid[order], start[order], run[order]
    rows = [
        (b, packed_ids(u), packed_ids(s), w.astype(np.uint8).tobytes())
        for b, (u, s, w) in dealt((mixed(uid.astype(U)) % U(buckets)).astype(np.int64), [uid, start, run])
    ]
    return pd.DataFrame(rows, columns=["ubucket", "uid", "start", "run"]).astype({"ubucket": "int32"})


def _settled(entries: DataFrame, buckets: int) -> DataFrame:
    """Per bucket: what repeats (``_FOUND``; runs under ubucket of the document), and with ``ubucket`` as ``-1 - ubucket``
    the runs to be refined."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        gram, text = (np.concatenate([np.frombuffer(x, dtype=k) for x in pdf[c]]) for c, k in (("gram", "<u4"), ("text", "<u8")))
        several = np.zeros(0, dtype=bool)
        if len(gram):
            order = np.argsort(gram)
            same = np.diff(gram[order]) == 0
            several = np.zeros(len(gram), dtype=bool)
            several[order] = np.concatenate((same, [False])) | np.concatenate(([False], same))
        doc, uid, start = (np.concatenate([unpacked_ids(x) for x in pdf[c]])[several] for c in ("doc", "uid", "start"))
        windows = np.concatenate([np.frombuffer(x, dtype=np.uint8) for x in pdf["run"]])[several]
        left, right = (np.concatenate([unpacked_sides(x) for x in pdf[c]])[several] for c in ("left", "right"))
        gram, text = gram[several], text[several]
        order = np.lexsort((doc, text, gram))
        gram, text, left, right, doc, uid, start, windows = (x[order] for x in (gram, text, left, right, doc, uid, start, windows))
        repeats = doc > _least(text, doc)
        out = [_found(uid[repeats], start[repeats], windows[repeats], buckets)]
        # The buckets are refined by the identifiers on either side of the anchor.  What is still in one bucket with
        # another text of another document is to be refined to the full length.
        gram, text, left, right, doc, uid, start, windows = (x[~repeats] for x in (gram, text, left, right, doc, uid, start, windows))
        apart = np.zeros(len(gram), dtype=bool)
        for side in (left, right):
            finer = gram.astype(U) << U(24) | side
            order = np.argsort(finer)
            f, t, d = finer[order], text[order], doc[order]
            apart[order] |= (side[order] > 0) & (_least(f, t) != ~_least(f, ~t)) & (_least(f, d) != -_least(f, -d))
        more = _found(uid[apart], start[apart], windows[apart], buckets)
        more["ubucket"] = -1 - more["ubucket"]
        return pd.concat([*out, more], ignore_index=True)

    return entries.groupBy("bucket").applyInPandas(run, _FOUND)


def _per_row(found: DataFrame, merge: bool) -> DataFrame:
    """``uid, starts, counts`` per document; merged: spans of bytes (start, end) instead of runs of windows."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        uid, start = (np.concatenate([unpacked_ids(x) for x in pdf[c]]) for c in ("uid", "start"))
        count = np.concatenate([np.frombuffer(x, dtype=np.uint8) for x in pdf["run"]]).astype(np.int64)
        order = np.lexsort((start, uid))
        uid, start, count = uid[order], start[order], count[order]
        if merge and len(uid):
            end = start + count - 1 + WINDOW
            new = np.flatnonzero(np.diff(uid, prepend=uid[0] - 1))
            owner = np.searchsorted(new, np.arange(len(uid)), side="right")
            span = int(end.max()) + 1
            reach = np.maximum.accumulate(end + owner * span) - owner * span
            fresh = np.concatenate(([True], (owner[1:] != owner[:-1]) | (start[1:] > reach[:-1])))
            at = np.flatnonzero(fresh)
            uid, start, count = uid[at], start[at], np.maximum.reduceat(end, at)
        at = np.flatnonzero(np.concatenate(([True], uid[1:] != uid[:-1]))) if len(uid) else np.zeros(0, dtype=int)
        return pd.DataFrame(
            {"uid": uid[at], "starts": [x.astype("<i8").tobytes() for x in np.split(start, at[1:])] if len(at) else [],
             "counts": [x.astype("<i8").tobytes() for x in np.split(count, at[1:])] if len(at) else []}
        )

    return found.groupBy("ubucket").applyInPandas(run, "uid long, starts binary, counts binary")


def refine(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, bucket of the string of WINDOW bytes there) of all windows of the texts laid end to end.

    Bucket-pointer refinement: the first identifiers come from 8 bytes, later ones from pairs of identifiers.
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(8, dtype=np.uint8)))
    pointer = np.unique(np.ndarray(shape=(n,), dtype="<u8", buffer=padded, strides=(1,)), return_inverse=True)[1].astype(U)
    width = 8
    for step in (8, 16, WINDOW - 32):
        later = np.zeros(n, dtype=U)
        later[: max(n - step, 0)] = pointer[step:]
        pair = pointer << U(32) | later
        # Identifiers of strings that run over an end mean nothing; no window asks for them.
        pointer = np.unique(pair, return_inverse=True)[1].astype(U)
        width += step
    starts = np.concatenate(([0], ends[:-1]))
    inside = np.zeros(n + 1, dtype=np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends - WINDOW + 1, -1)
    place = np.flatnonzero(np.cumsum(inside)[:n])
    return place, pointer[place]


def _refined(cut: DataFrame, buckets: int) -> DataFrame:
    """What repeats among the runs (``_FOUND``).

    A task settles what repeats among its own; of each string, only the places in its smallest document go on, dealt by
    the string's hash, so a string that a third of all documents hold comes from each task once.
    """

    kinds = [pa.int32()] + [pa.binary()] * 5
    names = ["bucket", "uid", "start", "run", "string", "doc"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        size = 0

        def settle() -> Iterator[pa.RecordBatch]:
            data = np.frombuffer(b"".join(h[3] for h in held), dtype=np.uint8)
            ends = np.cumsum([len(h[3]) for h in held])
            place, bucket = refine(data, ends)
            which = np.searchsorted(ends, place, side="right")
            doc, uid, start = (np.array([h[i] for h in held], dtype=np.int64)[which] for i in range(3))
            start = start + place - np.concatenate(([0], ends[:-1]))[which]
            string = range_hash(prefix_hash(data), place, place + WINDOW).astype(np.int64)
            held.clear()
            order = np.lexsort((doc, bucket))
            bucket, doc, uid, start, string = (x[order] for x in (bucket, doc, uid, start, string))
            repeats = doc > _least(bucket, doc)
            found = _found(uid[repeats], start[repeats], np.ones(int(repeats.sum()), dtype=np.int64), buckets)
            rows = [(*r, None, None) for r in found.itertuples(index=False, name=None)]
            rest = [x[~repeats] for x in (string, doc, uid, start)]
            for b, (x, d, u, s) in dealt((rest[0].astype(U) % U(buckets)).astype(np.int64), rest):
                rows.append((b, packed_ids(u), packed_ids(s), None, x.tobytes(), packed_ids(d)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            for doc, uid, text, starts, counts in zip(*(batch.column(i).to_pylist() for i in range(5))):
                data = (text or "").encode()
                for s, c in zip(np.frombuffer(starts, dtype="<i8").tolist(), np.frombuffer(counts, dtype="<i8").tolist()):
                    held.append((doc, uid, s, data[s : s + c - 1 + WINDOW]))
                    size += c - 1 + WINDOW
                    if size >= BLOCK:
                        yield from settle()
                        size = 0
        if held:
            yield from settle()

    def later(pdf: pd.DataFrame) -> pd.DataFrame:
        rest = pdf["string"].notna()
        known = pdf.loc[~rest, ["bucket", "uid", "start", "run"]].rename(columns={"bucket": "ubucket"})
        if not rest.any():
            return known
        string = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in pdf["string"][rest]])
        doc, uid, start = (np.concatenate([unpacked_ids(x) for x in pdf[c][rest]]) for c in ("doc", "uid", "start"))
        order = np.lexsort((doc, string))
        string, doc, uid, start = (x[order] for x in (string, doc, uid, start))
        repeats = doc > _least(string, doc)
        return pd.concat([known, _found(uid[repeats], start[repeats], np.ones(int(repeats.sum()), dtype=np.int64), buckets)], ignore_index=True)

    made = cut.mapInArrow(run, "bucket int, uid binary, start binary, run binary, string binary, doc binary")
    return made.groupBy("bucket").applyInPandas(later, _FOUND)


def _light(df: DataFrame) -> DataFrame:
    """Broadcast a stored frame of ``uid, starts, counts`` after measuring it, else leave it to a shuffle."""
    size = df.agg(F.sum(F.octet_length("starts") * 2 + 64).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def repeated_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``uid, starts, counts`` (little-endian longs: starts and ends of the spans) of the rows that repeat something."""
    rows = _rows(docs, id_column, text_column)
    buckets = bucket_count(docs, text_column)
    settled = stored(_settled(_entries(rows, buckets), buckets))
    wanted = stored(_per_row(settled.filter("ubucket < 0"), merge=False))
    refined = _refined(rows.join(_light(wanted), "uid").select("doc", "uid", "text", "starts", "counts"), buckets)
    every = settled.filter("ubucket >= 0").unionByName(refined)
    return stored(_per_row(every, merge=True))


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Every row of ``docs`` as ``doc_id, n_bytes, n_removed, n_spans, kept`` (binary, as a cut may split a character).

    A null text counts as empty; texts under 50 bytes lose nothing.  Rows with equal ids never repeat each other, and
    a null id counts as larger than all others.  Extra columns are ignored, an empty table gives an empty result.
    """
    spans = repeated_spans(docs, id_column, text_column)
    rows = _rows(docs, id_column, text_column).join(_light(spans), "uid", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text, starts, ends in zip(*(batch.column(i).to_pylist() for i in range(4))):
                data = text.encode()
                s, e = (np.frombuffer(x or b"", dtype="<i8").tolist() for x in (starts, ends))
                kept = b"".join(data[a:b] for a, b in zip([0, *e], [*s, len(data)]))
                out.append((None if doc == NOBODY else doc, len(data), len(data) - len(kept), len(s), kept))
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
            )

    return rows.select("doc", "text", "starts", "counts").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    )
