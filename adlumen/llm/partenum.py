"""Jaccard join of word shingle sets by PartEnum signatures (Arasu, Ganti and Kaushik, 2006).

Two sets with J >= g differ in D <= (1-g)/(1+g) * (a+b) elements.  Sizes are banded by powers of two; a band hashes
the feature domain into ``n1`` first-level partitions of ``N2`` parts each, and a signature is the content of a set in
one of the subsets of ``N2 - K2`` parts of one partition.  Differences that touch at most ``K2`` parts of a partition
leave one of its subsets equal in both sets.

Empty contents are never signatures (they would be one huge group); what this costs is counted.  With three parts and
subsets of two, a difference spoils at most two signatures of a partition, and a second one the last.  So a set with
more signatures than the largest D its size allows can spoil shares one with every partner, and the surplus is the
least number it shares.  A set without surplus (small or unlucky ones) is *exposed* and has each element as a
signature besides: two exposed partners share an element, an exposed and a safe one share a signature by the safe
one's surplus.  A set at the lower end of a band also signs with the partitions of the band below, so no pair across
bands is lost.  The join is exact up to collisions of 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from adlumen.llm.common import U, bucket_count, components, dealt, fresh, gram_hashes, mixed, packed_ids, scratch, stored, unpacked_ids, word_hashes

N2, K2 = 3, 1
ELEMENTS = -1
FLUSH = 600_000
# Classes of which texts are fetched by a broadcast list; beyond, the list is joined by shuffle.
LISTED = 200_000
# Elements of sets a task keeps between pairs: 16 MB.
HELD_ELEMENTS = 2_000_000
# Times that neighbours in a random order of each group are tried before all members are compared.
TRIES = 1
# Cells of a sketch; members of a group that one task compares with as many others; pairs judged at once.
CELLS, BLOCK_MEMBERS, PAIRS = 256, 1024, 8192


def band_of(size: int) -> int:
    return max(int(size).bit_length() - 1, 0)


@cache
def most_different(size: int, largest: int, threshold: Fraction) -> int:
    """The largest symmetric difference with a partner of at most ``largest`` elements."""
    return int((1 - threshold) / (1 + threshold) * (size + min(int(size / threshold), largest)))


@cache
def partitions_of(band: int, threshold: Fraction) -> int:
    """First-level partitions of a band: enough for its largest sets, with a margin for empty parts."""
    top = (2 << band) - 1
    return int(1.15 * (most_different(top, int(top / threshold), threshold) + 1) / (K2 + 1)) + 2


def signatures(elements: np.ndarray, threshold: Fraction) -> list[tuple[int, np.ndarray, int]]:
    """(band, signatures, the least number of them shared with any partner, at least 1) for each band a set signs in."""
    size = len(elements)
    own = band_of(size)
    bands = [(own, int(size / threshold))]
    if own and size * threshold < (1 << own):
        bands.append((own - 1, (1 << own) - 1))
    out, exposed, value = [], False, mixed(elements, 0xABCDEF)
    for band, largest in bands:
        n1 = partitions_of(band, threshold)
        part = mixed(elements, 0x1234567 + band) % U(n1 * N2)
        order = np.argsort(part.astype(np.uint16) if n1 * N2 < 65536 else part, kind="stable")
        here = part[order].astype(np.int64)
        at = np.flatnonzero(np.concatenate(([True], here[1:] != here[:-1])))
        content = np.zeros(n1 * N2, dtype=U)
        content[here[at]] = np.add.reduceat(value[order], at)
        filled = np.zeros(n1 * N2, dtype=bool)
        filled[here[at]] = True
        content, filled = content.reshape(n1, N2), filled.reshape(n1, N2)
        parts = filled.sum(axis=1)
        some, several = int((parts > 0).sum()), int((parts > 1).sum())
        differ = most_different(size, largest, threshold)
        found = []
        for j, chosen in enumerate(combinations(range(N2), N2 - K2)):
            total = np.zeros(n1, dtype=U)
            for c in chosen:
                total += np.where(filled[:, c], content[:, c] * U(2 * c + 3), U(0))
            keep = filled[:, list(chosen)].any(axis=1)
            tag = np.arange(n1, dtype=U) * U(64) + U(j)
            found.append(mixed(total + mixed(tag, band + 1))[keep])
        sigs = np.concatenate(found)
        # A first difference in a partition spoils two of its subsets at most, a second one the last.
        least = len(sigs) - 2 * min(differ, some) - min(max(differ - some, 0), several)
        out.append((band, sigs, max(1, least)))
        exposed |= least <= 0
    if exposed:
        out.append((ELEMENTS, mixed(elements, 0x777), max(1, -int(-size * threshold // 1))))
    return out


def shingle_sets(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    return [np.unique(gram_hashes(w, words)) for w in word_hashes(texts)]


def set_id(elements: np.ndarray) -> int:
    """One id for equal sets: a signed 64-bit hash."""
    return int(mixed(np.array([mixed(elements, 0xFACE).sum(dtype=U)]), len(elements))[0].astype(np.int64)) if len(elements) else 0


def sketch(elements: np.ndarray) -> bytes:
    """How many elements fall in each of ``CELLS`` cells, two to a byte; empty where a cell has more than 15.

    Two sets can't share more than the sum of the lesser counts of all cells.
    """
    counts = np.bincount((mixed(elements, 0x5EED) % U(CELLS)).astype(np.int64), minlength=CELLS).astype(np.uint8)
    return (counts[: CELLS // 2] | counts[CELLS // 2 :] << 4).tobytes() if counts.max(initial=0) < 16 else b""


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist()


def _uid(docs: DataFrame, id_column: str, text_column: str) -> Column:
    return F.xxhash64(docs[id_column].cast("long"), F.coalesce(docs[text_column].cast("string"), F.lit("")))


def shingled(docs: DataFrame, words: int = 5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, uid, n_shingles, class_id`` per row; equal sets have one class, the empty set has class null.

    ``uid`` names a row's id and text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = shingle_sets(_texts(part.column(2)), words)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())],
                    names=["doc_id", "uid", "n_shingles", "class_id"],
                )

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), _uid(docs, id_column, text_column).alias("uid"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, uid long, n_shingles long, class_id long")


def signed(docs: DataFrame, words: int, threshold: Fraction, buckets: int, text_column: str) -> DataFrame:
    """Signatures of all classes dealt to buckets: ``bucket, blob...``; a class signs once for each flush of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int, int, int, int]] = []
        seen: set[int] = set()
        size = 0

        def flush() -> pa.RecordBatch:
            lengths = [len(s) for s, *_ in held]
            sigs = np.concatenate([s for s, *_ in held])
            ids, bands, least, sizes = (np.repeat(np.array([h[i] for h in held], dtype=np.int64), lengths) for i in (1, 2, 3, 4))
            rows = [
                (b, s.tobytes(), packed_ids(i), packed_ids((d + 1) << 40 | n << 20 | m))
                for b, (s, i, d, m, n) in dealt((sigs % U(buckets)).astype(np.int64), [sigs, ids, bands, least, sizes])
            ]
            held.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[j] for r in rows], pa.binary()) for j in (1, 2, 3))],
                names=["bucket", "sigs", "ids", "facts"],
            )

        for batch in batches:
            texts = _texts(batch.column(0))
            for at in range(0, len(texts), 512):
                for s in shingle_sets(texts[at : at + 512], words):
                    c = set_id(s)
                    if len(s) and c not in seen:
                        seen.add(c)
                        for band, sigs, least in signatures(s, threshold):
                            held.append((sigs, c, band, min(least, (1 << 20) - 1), min(len(s), (1 << 20) - 1)))
                            size += len(sigs)
                if size >= FLUSH:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    rows = docs.select(F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, "bucket int, sigs binary, ids binary, facts binary")


def shared(blobs: DataFrame) -> DataFrame:
    """Signatures of two classes or more: ``group_id, weight, size, band, member, least, n_elements`` a row per member.

    Signatures with the same members count as one group of that weight.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        sigs = np.concatenate([np.frombuffer(x, dtype="<u8") for x in pdf["sigs"]])
        ids = np.concatenate([unpacked_ids(x) for x in pdf["ids"]])
        facts = np.concatenate([unpacked_ids(x) for x in pdf["facts"]])
        order = np.argsort(sigs)
        sigs, ids, facts = sigs[order], ids[order], facts[order]
        at = np.flatnonzero(np.concatenate(([True], sigs[1:] != sigs[:-1])))
        several = np.diff(np.append(at, len(sigs))) > 1
        groups: dict[bytes, list] = {}
        for a, b in zip(at[several], np.append(at, len(sigs))[1:][several]):
            members, first = np.unique(ids[a:b], return_index=True)
            if len(members) > 1:
                # The band is in the facts, so groups of different bands never fold together.
                held = groups.setdefault(members.tobytes() + bytes([(int(facts[a]) >> 40) & 0xFF]), [0, members, facts[a:b][first]])
                held[0] += 1
        lengths = [len(m) for _, m, _ in groups.values()]
        fact = np.concatenate([f for *_, f in groups.values()]) if groups else np.zeros(0, dtype=np.int64)
        return pd.DataFrame(
            {
                "group_id": np.repeat((bucket << 32) + np.arange(len(groups)), lengths),
                "weight": np.repeat([w for w, *_ in groups.values()] or np.zeros(0, dtype=np.int64), lengths).astype(np.int64),
                "size": np.repeat(lengths or np.zeros(0, dtype=np.int64), lengths).astype(np.int64),
                "band": ((fact >> 40) - 1).astype(np.int32),
                "member": np.concatenate([m for _, m, _ in groups.values()]) if groups else np.zeros(0, dtype=np.int64),
                "least": fact & 0xFFFFF,
                "n_elements": fact >> 20 & 0xFFFFF,
            }
        )

    return blobs.groupBy("bucket").applyInPandas(run, "group_id long, weight long, size long, band int, member long, least long, n_elements long")


def linked(pairs: DataFrame, texts: DataFrame, words: int, threshold: Fraction) -> DataFrame:
    """The pairs ``a, b`` of classes whose sets are similar enough, each checked on its whole texts."""
    up, down = threshold.numerator, threshold.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                # A class stands in many pairs; those of one task often follow each other.
                if sum(map(len, sets.values())) > HELD_ELEMENTS:
                    sets.clear()
                for i in (0, 1):
                    ids = part.column(i).to_pylist()
                    new = {c: j for j, c in enumerate(ids) if c not in sets}
                    sets.update(zip(new, shingle_sets([part.column(i + 2)[j].as_buffer().to_pybytes() for j in new.values()], words)))
                keep = []
                for x, y in ((sets[a], sets[b]) for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist())):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(down * both >= up * (len(x) + len(y) - both))
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left = texts.select(F.col("class_id").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("class_id").alias("b"), F.col("text").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _listed(ids: DataFrame) -> DataFrame:
    """Broadcast a list of ids after counting it, else leave the join to a shuffle."""
    return F.broadcast(ids) if ids.limit(LISTED + 1).count() <= LISTED else ids


def class_texts(classes: DataFrame, needed: DataFrame, docs: DataFrame, id_column: str, text_column: str, words: int) -> DataFrame:
    """``class_id, text, sketch`` of one document of each needed class."""
    wanted = stored(classes.join(needed, "class_id", "left_semi").groupBy("class_id").agg(F.min("doc_id").alias("doc_id")))
    listed = _listed(wanted.select("doc_id").distinct())
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    rows = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(0))).join(
        listed.select(F.coalesce("doc_id", F.lit(0)).alias("doc_id")), "doc_id", "left_semi"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = shingle_sets(_texts(part.column(0)), words)
                ids, sketches = pa.array([set_id(s) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([ids, part.column(0), sketches], names=["class_id", "text", "sketch"])

    # Rows that repeat a doc_id may bring a text of another class, or the same one again.
    found = rows.select("text").mapInArrow(run, "class_id long, text string, sketch binary")
    return found.join(wanted.select("class_id"), "class_id", "left_semi").dropDuplicates(["class_id"])


def _torn(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """The entries, with the ``root`` of each member, of groups that more than one component shares."""
    placed = entries.join(roots.withColumnRenamed("node", "member"), "member", "left").withColumn("root", F.coalesce("root", "member"))
    torn = placed.groupBy("group_id").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("group_id")
    return placed.join(torn, "group_id", "left_semi")


def _merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``node, root`` after further links ``a, b``; a node that isn't there is its own root."""
    ends = edges.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(
        roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left"
    )
    across = components(ends.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    moved = roots.join(across.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return moved.unionByName(across.join(roots, "node", "left_anti").select("node", "root"))


class _Members:
    """Rows of a table of group members as arrays."""

    def __init__(self, table: pa.Table, threshold: Fraction):
        self.up, self.down = threshold.numerator, threshold.denominator
        self.key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("group_id", "x", "y")])
        self.member, self.root, self.size = (table.column(c).to_numpy().astype(np.int64) for c in ("member", "root", "n_elements"))
        self.first = table.column("first").to_numpy(zero_copy_only=False).astype(bool)
        blobs = table.column("sketch").to_pylist()
        self.some = np.array([len(b) > 0 for b in blobs], dtype=bool)
        halves = np.frombuffer(b"".join(b or bytes(CELLS // 2) for b in blobs), dtype=np.uint8).reshape(-1, CELLS // 2)
        self.sketches = np.concatenate((halves & 15, halves >> 4), axis=1)

    def alike(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of pairs of rows of different components those that neither sizes nor sketches rule out, by their classes."""
        lo, hi = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j])
        unknown = hi == (1 << 20) - 1  # over the field's range
        near = (self.root[i] != self.root[j]) & ((lo * self.down >= hi * self.up) | unknown)
        i, j, unknown, out = i[near], j[near], unknown[near], []
        for at in range(0, len(i), PAIRS):
            p, q = i[at : at + PAIRS], j[at : at + PAIRS]
            most = np.minimum(self.sketches[p], self.sketches[q]).sum(axis=1, dtype=np.int64)
            may = (most * (self.up + self.down) >= self.up * (self.size[p] + self.size[q])) | ~(self.some[p] & self.some[q]) | unknown[at : at + PAIRS]
            a, b = self.member[p[may]], self.member[q[may]]
            out.append(np.stack((np.minimum(a, b), np.maximum(a, b)), axis=1))
        return np.unique(np.concatenate(out), axis=0) if out else np.zeros((0, 2), dtype=np.int64)

    def neighbours(self) -> np.ndarray:
        """Pairs of rows that follow each other in a group."""
        i = np.flatnonzero((self.key[:, 1:] == self.key[:, :-1]).all(axis=0))
        return self.alike(i, i + 1)

    def every(self) -> np.ndarray:
        """All pairs of a group, across its two sides where it has two."""
        at = np.append(np.flatnonzero(np.concatenate(([True], (self.key[:, 1:] != self.key[:, :-1]).any(axis=0)))), len(self.member))
        found, held, number = [], [], 0
        for lo, hi in zip(at, at[1:]):
            first = self.first[lo:hi]
            left, right = (np.flatnonzero(first), np.flatnonzero(~first)) if first.any() and not first.all() else (None, None)
            if left is None:
                i, j = np.triu_indices(hi - lo, 1)
            else:
                i, j = np.repeat(left, len(right)), np.tile(right, len(left))
            held.append((lo + i, lo + j))
            number += len(i)
            if number >= 1 << 20:
                found.append(self.alike(*(np.concatenate(h) for h in zip(*held))))
                held, number = [], 0
        if held:
            found.append(self.alike(*(np.concatenate(h) for h in zip(*held))))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), dtype=np.int64)


def candidates(placed: DataFrame, texts: DataFrame, threshold: Fraction, salt: int | None = None) -> DataFrame:
    """Distinct pairs ``a, b`` of classes that share a group, are in different components and may be alike.

    The members of a group meet in one task, those of a large one in blocks of about ``BLOCK_MEMBERS``, each with each.
    Groups with the same smallest member go to the same task, so a pair that shares many groups mostly leaves it once; as
    a class has a bounded number of signatures, so has a task of rows.  Pairs are formed and judged there, by their sizes
    and sketches; only those that may be alike leave it.  With a
    ``salt`` only neighbours in a random order of each block are paired, which costs no more than the members.
    """
    sizes = placed.groupBy("group_id").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("blocks"), F.min("member").alias("lead"))
    sketched = placed.join(texts.select(F.col("class_id").alias("member"), "sketch"), "member").join(sizes, "group_id")
    own = F.pmod(F.xxhash64("member", F.lit(salt or 0)), F.col("blocks")).cast("int")
    order = F.xxhash64(F.lit(salt), "member") if salt is not None else F.lit(0)
    dealt = sketched.withColumns({"own": own, "rank": order})
    dealt = dealt.withColumn("other", F.col("own") if salt is not None else F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select(
        "group_id", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), (F.col("own") <= F.col("other")).alias("first"),
        "lead", "rank", "member", "root", "n_elements", "sketch",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        found: list[np.ndarray] = []

        def judge(table: pa.Table) -> None:
            members = _Members(table, threshold)
            found.append(members.every() if salt is None else members.neighbours())

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = (table if rest is None else pa.concat_tables([rest, table])).combine_chunks()
            # The last group may go on in the next batch.
            key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("group_id", "x", "y")])
            ended = np.flatnonzero((key != key[:, -1:]).any(axis=0))
            whole = int(ended[-1]) + 1 if len(ended) else 0
            if whole:
                judge(table.slice(0, whole).combine_chunks())
            rest = table.slice(whole).combine_chunks()
            if sum(map(len, found)) > 1_000_000:
                found[:] = [np.unique(np.concatenate(found), axis=0)]
                if len(found[0]) > 500_000:
                    pairs = found.pop()
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])
        if rest is not None and rest.num_rows:
            judge(rest)
        if found:
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    by_group = dealt.repartition("lead", "x", "y").sortWithinPartitions("group_id", "x", "y", "rank", "member")
    return by_group.mapInArrow(run, "a long, b long").distinct()


def jaccard_components(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row: see :func:`joined`."""
    return joined(docs, **options).select("doc_id", "n_shingles", "component_id")


def joined(
    docs: DataFrame, words: int = 5, threshold: Fraction = Fraction(3, 4), id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``doc_id, uid, n_shingles, root, component_id`` for every row: components of documents linked by J >= ``threshold``.

    ``root`` names the component (null without words), ``component_id`` is its smallest ``doc_id``.

    A row without words has an empty set, no link and itself as component.  Rows with equal ids count as documents of
    their own, each with its text; a null id is kept, and never is the smallest of a component that has another.
    Extra columns are ignored, an empty table gives an empty result.

    Two steps lead to the pairs that are verified.  A class shares at least ``least`` signatures with any partner: one
    that shares fewer with all others is dropped, and of the rest each may pass over its ``least - 1`` commonest ones, as
    one that is left is still shared (prefix filter; the order by group size is the same for all).  So what many
    documents have in common by a passage or a line brings no pairs.  Then each class is checked against the smallest
    class it still shares a signature with, next ``TRIES`` times against neighbours of other components in a random order,
    and after that every two classes that share one, are not in the same component yet and whose sizes and sketches allow
    it (see :func:`candidates`); a family of thousands of near copies that are mostly alike costs a few pairs for each member.
    """
    buckets = bucket_count(docs, text_column)
    classes = stored(shingled(docs, words, id_column, text_column))
    groups = stored(shared(signed(docs, words, threshold, buckets, text_column)))
    mine = Window.partitionBy("member", "band")
    before = mine.orderBy("size", "group_id").rowsBetween(Window.unboundedPreceding, -1)
    counted = groups.withColumn("n", F.sum("weight").over(mine)).withColumn("before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    left = stored(counted.filter("n >= least and before <= n - least").select("group_id", "member", "n_elements"))
    lead = left.groupBy("group_id").agg(F.min("member").alias("lead"))
    first = stored(
        left.join(lead, "group_id").groupBy("member").agg(F.min("lead").alias("a")).filter("a != member").select("a", F.col("member").alias("b"))
    )
    texts = stored(class_texts(classes, left.select(F.col("member").alias("class_id")).distinct(), docs, id_column, text_column, words))
    sure = stored(linked(first, texts, words, threshold))
    roots = stored(components(sure))
    placed = stored(_torn(left, roots))
    # What is left apart tries a few members of other components first, others each time.
    tried = first
    for salt in range(TRIES):
        pairs = stored(candidates(placed, texts, threshold, salt).join(tried, ["a", "b"], "left_anti"))
        tried = tried.unionByName(pairs)
        roots = stored(_merged(roots, stored(linked(pairs, texts, words, threshold))))
        placed = stored(_torn(left, roots))
    rest = stored(candidates(placed, texts, threshold).join(tried, ["a", "b"], "left_anti"))
    roots = stored(_merged(roots, stored(linked(rest, texts, words, threshold))))
    final = stored(
        classes.filter("class_id is not null").groupBy("class_id").agg(F.min("doc_id").alias("least"))
        .join(roots.select(F.col("node").alias("class_id"), F.col("root").alias("r")), "class_id", "left")
        .withColumn("r", F.coalesce("r", "class_id"))
    )
    smallest = final.groupBy("r").agg(F.min("least").alias("component_id"))
    by_class = final.join(smallest, "r").select("class_id", F.col("r").alias("root"), "component_id")
    out = classes.join(by_class, "class_id", "left")
    return out.select("doc_id", "uid", "n_shingles", "root", F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each group of near duplicates: that with the smallest id.

    Rows without words are in no group and all stay.  Of rows alike in id and text one stays; of rows that share the
    smallest id with different texts, the one with the smaller hash.  A null id is the largest.  Other columns may have any
    names; an empty table gives an empty result.
    """
    found = stored(joined(docs, **options).filter("root is not null"))
    rank = F.struct(F.coalesce("doc_id", F.lit(np.iinfo(np.int64).max)).alias("doc_id"), "uid")
    first = found.groupBy("root").agg(F.min(rank).alias("first")).select("root", F.col("first.uid").alias("first"))
    name = fresh("uid", docs.columns)
    gone = stored(found.join(first, "root").filter("uid != first").select(F.col("uid").alias(name)).distinct())
    again = stored(found.groupBy("uid").count().filter("count > 1").select(F.col("uid").alias(name)))
    named = docs.withColumn(name, _uid(docs, options.get("id_column", "doc_id"), options.get("text_column", "text")))
    rows = named.join(_listed(gone), name, "left_anti")
    if again.isEmpty():
        return rows.select(*[named[c] for c in docs.columns])
    alike = rows.join(_listed(again), name, "left_semi").dropDuplicates([name])
    return rows.join(_listed(again), name, "left_anti").unionByName(alike).drop(name).select(*[F.col(f"`{c}`") for c in docs.columns])
