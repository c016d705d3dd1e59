"""Ranked lexical search, a hybrid of term-at-a-time and document-at-a-time evaluation over an inverted index.

:func:`indexed` reads every whole text once and writes the index: one row per block of documents with the postings of
all its terms, sorted by a 64-bit hash of the term.  :func:`ranked` takes the queries in packs of bounded size.  For each
pack it counts document frequencies over the whole index, then searches it block by block.  For a query the short lists
of a block are summed term at a time into accumulators, and these act as one more iterator whose bound is their largest
sum.  That one and the long lists are walked document at a time: runs of documents, and then single ones, are skipped
where the bounds of what is still unread can't bring them among the best found so far.  A task keeps the best documents
of every query across its blocks, and the tasks' best are ranked at the end, so nothing but these is shuffled.

Scores are whole numbers and the same whatever the blocks; terms are told apart by their 64-bit hash.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from adlumen.llm.common import BLOCK, U, prefix_hash, range_hash, small_batches, stored

TOP = 20
BLOCK_TEXT, BLOCK_DOCS = 8 << 20, 65_535
# Queries, and terms of queries, that one pass over the index serves.
PACK_ITEMS, PACK_TERMS = 1_024, 1 << 17
# A list is short where it holds at most one document in so many of its block.
SHORT = 16
# Documents that are skipped or opened together.
RUN = 128
NO_ID = np.iinfo(np.int64).max

_GAP = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TERM = np.ones(256, dtype=bool)
_TERM[:128] = False
_TERM[48:58] = _TERM[65:91] = _TERM[97:123] = True


def terms_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every term and the number of its text, in their order; temporary arrays are bounded by a block."""
    data = b"\n".join(texts) + b"\n"
    ends = np.cumsum([len(t) + 1 for t in texts])
    hashes, owners, at = [], [], 0
    while at < len(data):
        gap = _GAP.search(data, min(at + BLOCK, len(data) - 1))
        until = gap.end()
        piece = _LOWER[np.frombuffer(data, dtype=np.uint8, count=until - at, offset=at)]
        edge = np.flatnonzero(np.diff(_TERM[piece], prepend=False, append=False))
        start, end = edge[0::2], edge[1::2]
        hashes.append(range_hash(prefix_hash(piece), start, end))
        owners.append(np.searchsorted(ends, at + start, side="right"))
        at = until
    return np.concatenate(hashes), np.concatenate(owners)


def postings(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms in order, the sizes of their lists, and documents and frequencies of the lists one after another."""
    order = np.argsort(hashes, kind="stable")
    h, d = hashes[order], owners[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    terms, first = np.unique(h[at], return_index=True)
    return terms, np.diff(first, append=len(at)), d[at], np.diff(at, append=len(h))


def _narrow(values: np.ndarray) -> bytes:
    """Whole numbers at the least width that holds them, which the first byte tells."""
    most = int(values.max()) if len(values) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def _wide(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype=f"<u{blob[0]}", offset=1).astype(np.int64)


INDEX_SCHEMA = "n_docs long, n_terms long, ids binary, lengths binary, terms binary, sizes binary, docs binary, tfs binary"


def indexed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The inverted index: a row per block of documents, ``n_docs`` counting those with a term.

    Null and empty texts, and texts without a term, are left out: they match nothing and don't count.  Rows with equal
    ids are documents of their own.  Extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        texts: list[bytes] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            hashes, owners = terms_of(texts)
            n = np.bincount(owners, minlength=len(texts))
            there = np.flatnonzero(n)
            if len(there):
                place = np.cumsum(n > 0) - 1
                terms, sizes, doc, tf = postings(hashes, place[owners])
                row = (np.array(ids, dtype="<i8")[there].tobytes(), _narrow(n[there]), terms.astype("<u8").tobytes(), _narrow(sizes), _narrow(doc), _narrow(tf))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([len(there)], pa.int64()), pa.array([len(hashes)], pa.int64()), *(pa.array([x], pa.binary()) for x in row)],
                    names=[c.split()[0] for c in INDEX_SCHEMA.split(", ")],
                )
            ids.clear()
            texts.clear()

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist()):
                if text:
                    ids.append(NO_ID if i is None else i)
                    texts.append(text)
                    size += len(text)
                    if size >= BLOCK_TEXT or len(texts) >= BLOCK_DOCS:
                        yield from flush()
                        size = 0
        if texts:
            yield from flush()

    small_batches(docs.sparkSession)
    return docs.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")).toDF("doc_id", "text").mapInArrow(run, INDEX_SCHEMA)


@dataclass
class Pack:
    """Queries of one pass: for each its terms, as places in the sorted ``vocabulary``, and their repeats."""

    vocabulary: np.ndarray
    items: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list[tuple[bytes, bytes]]) -> Pack:
        lists = [(np.frombuffer(t, dtype="<u8"), _wide(c)) for t, c in rows]
        vocabulary = np.unique(np.concatenate([t for t, _ in lists]))
        return cls(vocabulary, [(np.searchsorted(vocabulary, t), c) for t, c in lists])

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Where each term of the vocabulary stands in the sorted ``terms``, -1 where it doesn't."""
        at = np.searchsorted(terms, self.vocabulary)
        at[at == len(terms)] = 0
        return np.where(terms[at] == self.vocabulary, at, -1)


def document_frequencies(index: DataFrame, pack: Pack) -> np.ndarray:
    """In how many documents of the whole index each term of the pack stands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(pack.vocabulary), dtype=np.int64)
        for batch in batches:
            for terms, sizes in zip(*(c.to_pylist() for c in batch.columns)):
                at = pack.places(np.frombuffer(terms, dtype="<u8"))
                found[at >= 0] += _wide(sizes)[at[at >= 0]]
        some = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(found[some], pa.int64())], names=["term", "df"])

    out = np.zeros(len(pack.vocabulary), dtype=np.int64)
    counts = index.select("terms", "sizes").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for r in counts.collect():  # at most one row per term of the pack
        out[r["term"]] = r["df"]
    return out


class Block:
    """What a block holds of a pack's terms, with the score of every posting before its weight."""

    def __init__(self, pack: Pack, row: dict, n_docs: int, n_terms: int):
        self.ids = np.frombuffer(row["ids"], dtype="<i8")
        sizes = _wide(row["sizes"])
        start = np.cumsum(sizes) - sizes
        place = pack.places(np.frombuffer(row["terms"], dtype="<u8"))
        self.size = np.where(place >= 0, sizes[place], 0)
        first = np.where(place >= 0, start[place], 0)
        self.at = np.cumsum(self.size) - self.size
        wanted = np.repeat(first - self.at, self.size) + np.arange(int(self.size.sum()))
        self.docs, tf = _wide(row["docs"])[wanted], _wide(row["tfs"])[wanted]
        m = 75 + 25 * _wide(row["lengths"]) * n_docs // n_terms
        self.gain = 1_000_000_000 * tf // (1_000 * tf + 12 * m[self.docs])
        self.most = np.zeros(len(self.size), dtype=np.int64)
        some = self.size > 0
        if some.any():
            self.most[some] = np.maximum.reduceat(self.gain, self.at[some])
        self._by_run: dict[int, np.ndarray] = {}

    def list(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        lo = self.at[term]
        return self.docs[lo : lo + self.size[term]], self.gain[lo : lo + self.size[term]]

    def by_run(self, term: int) -> np.ndarray:
        """The list's largest score in each run of documents."""
        if term not in self._by_run:
            docs, gain = self.list(term)
            run = docs // RUN
            new = np.flatnonzero(np.diff(run, prepend=-1))
            out = np.zeros(-(-len(self.ids) // RUN), dtype=np.int64)
            out[run[new]] = np.maximum.reduceat(gain, new)
            self._by_run[term] = out
        return self._by_run[term]


class Best:
    """The best documents of one query so far."""

    def __init__(self, top: int):
        self.top, self.score, self.doc = top, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    @property
    def least(self) -> int:
        """What a further document must reach to matter; the smaller id of equal ones may still be to come."""
        return int(self.score[-1]) if len(self.score) == self.top else 1

    def add(self, score: np.ndarray, doc: np.ndarray) -> None:
        score, doc = np.concatenate((self.score, score)), np.concatenate((self.doc, doc))
        order = np.lexsort((doc, -score))[: self.top]
        self.score, self.doc = score[order], doc[order]


def search(block: Block, terms: np.ndarray, weights: np.ndarray, best: Best) -> None:
    """Bring the best documents of a query up to date with a block; ``weights`` hold the repeats."""
    some = (block.size[terms] > 0) & (weights > 0)
    terms, weights = terms[some], weights[some]
    if not len(terms):
        return
    n = len(block.ids)
    long = block.size[terms] * SHORT > n
    sums = np.zeros(n, dtype=np.int64)
    for t, w in zip(terms[~long].tolist(), weights[~long].tolist()):
        docs, gain = block.list(t)
        sums[docs] += w * gain
    # The long lists from the one that can add most on, and what those from each on can add together.
    bounds = block.most[terms[long]] * weights[long]
    order = np.argsort(-bounds, kind="stable")
    walked = list(zip(terms[long][order].tolist(), weights[long][order].tolist()))
    unread = np.append(np.cumsum(bounds[order][::-1])[::-1], 0)
    if int(sums.max()) + int(unread[0]) < best.least:
        return
    edges = np.arange(0, n, RUN)
    reach = np.maximum.reduceat(sums, edges)
    for t, w in walked:
        reach = reach + w * block.by_run(t)

    def opened(runs: np.ndarray) -> None:
        docs = (edges[runs][:, None] + np.arange(RUN)).ravel()
        docs = docs[docs < n]
        score = sums[docs]
        for (t, w), rest in zip(walked, unread):
            near = score + rest >= best.least
            docs, score = docs[near], score[near]
            if not len(docs):
                return
            there, gain = block.list(t)
            at = np.searchsorted(there, docs)
            at[at == len(there)] = 0
            score = score + np.where(there[at] == docs, w * gain[at], 0)
        good = score >= best.least
        best.add(score[good], block.ids[docs[good]])

    # The most promising run sets the mark for all others.
    first = int(reach.argmax())
    opened(np.array([first]))
    others = np.flatnonzero(reach >= best.least)
    others = np.sort(others[others != first])
    if len(others):
        opened(others)


def _packs(spark: SparkSession, items: DataFrame, id_column: str, text_column: str) -> Iterator[tuple[list[int | None], Pack]]:
    """The queries with a term, in packs: their ids and their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(terms_of([t])[0], return_counts=True) for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t, _ in found], pa.int64()), pa.array([t.astype("<u8").tobytes() for t, _ in found], pa.binary()), pa.array([_narrow(c) for _, c in found], pa.binary())],
                names=["item_id", "size", "terms", "counts"],
            )

    rows = items.select(F.col(id_column).cast("long"), F.col(text_column).cast("string")).toDF("item_id", "text").filter("text is not null").distinct()
    found = stored(rows.mapInArrow(run, "item_id long, size long, terms binary, counts binary").filter("size > 0"))
    total = found.agg(F.count("*"), F.sum("size")).first()
    packs = max(1, math.ceil(total[0] / PACK_ITEMS), math.ceil((total[1] or 0) / PACK_TERMS))
    for k in range(packs if total[0] else 0):
        part = found.filter(F.pmod(F.xxhash64("item_id", "terms"), F.lit(packs)) == k).orderBy("item_id", F.md5("terms"), F.md5("counts"))
        if members := part.collect():
            yield [r["item_id"] for r in members], Pack.of([(r["terms"], r["counts"]) for r in members])


def ranked(
    docs: DataFrame, items: DataFrame, top: int = TOP, id_column: str = "doc_id", text_column: str = "text", item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of the highest score above 0 for each item.

    Equal scores go to the smaller ``doc_id``, a null one last; rows that repeat an id are documents of their own, ranked
    one after the other.  Equal items count once; items that share an id with other texts are ranked each.  An item without terms (null or
    empty text too) has no row, nor has any where no document has a term; empty tables give an empty result.  Extra
    columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    schema = "item_id long, rank int, doc_id long, score long"
    index = stored(indexed(docs, id_column, text_column))
    n_docs, n_terms = index.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    out = spark.createDataFrame([], schema)
    if not n_terms:
        return out
    for ids, pack in _packs(spark, items, item_id, item_text):
        df = document_frequencies(index, pack)
        # Python's logarithm, as one in a thousandth more or less would move every score.
        weight = np.array([math.floor(1_000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], dtype=np.int64)

        def run(batches: Iterator[pa.RecordBatch], pack=pack, weight=weight) -> Iterator[pa.RecordBatch]:
            best = [Best(top) for _ in pack.items]
            for batch in batches:
                for row in batch.to_pylist():
                    block = Block(pack, row, n_docs, n_terms)
                    for b, (terms, repeats) in zip(best, pack.items):
                        search(block, terms, weight[terms] * repeats, b)
            sizes = [len(b.doc) for b in best]
            doc, score = (np.concatenate([getattr(b, x) for b in best]) for x in ("doc", "score"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(np.arange(len(best)), sizes), pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())],
                names=["item", "doc_id", "score"],
            )

        found = index.select("ids", "lengths", "terms", "sizes", "docs", "tfs").mapInArrow(run, "item int, doc_id long, score long")
        order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
        placed = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
        names = F.broadcast(spark.createDataFrame(list(enumerate(ids)), "item int, item_id long"))  # at most a pack
        out = out.unionByName(
            placed.join(names, "item").select("item_id", "rank", F.when(F.col("doc_id") != int(NO_ID), F.col("doc_id")).alias("doc_id"), "score")
        )
    return out
