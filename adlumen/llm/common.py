"""Helpers shared by the operators: intermediate tables, hashing of words, blobs dealt to buckets, components."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

U = np.uint64
WHITE = re.compile(rb"[\x20\x09-\x0d]")
BLOCK = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_power: list[np.ndarray] = [np.ones(1, dtype=U), np.ones(1, dtype=U)]


# ---- intermediate tables -------------------------------------------------------------------------------------------


def scratch(spark: SparkSession) -> str:
    """A new folder in the one the session names for checkpoints; a temporary one only in local mode without a name."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="adlumen-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/adlumen-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write the frame as Parquet in the shared folder and go on from the files: nothing upstream is computed again."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def released(df: DataFrame) -> DataFrame:
    """A stored frame, after the shuffles it was made by are let go: Spark removes their files once the driver has collected them."""
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def fresh(name: str, columns: list[str]) -> str:
    """A column name that isn't there yet, whatever the case of letters."""
    there = {c.lower() for c in columns}
    while name.lower() in there:
        name = f"_{name}"
    return name


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a size fit for long texts; by default a batch has 10,000 rows however long they are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def bucket_count(df: DataFrame, column: str, mb: int = 8) -> int:
    """Buckets of about ``mb`` MB of text, at least one for each shuffle partition."""
    small_batches(df.sparkSession)
    total = df.agg(F.sum(F.octet_length(column)).alias("n")).first()["n"] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / (mb << 20)))


# ---- hashing -------------------------------------------------------------------------------------------------------


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    h = h ^ U(salt & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if len(_power[0]) < n:
        size = max(n, 2 * len(_power[0]), BLOCK + 4096)
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=U)
            steps[0] = 1
            _power[i] = np.multiply.accumulate(steps)
    return _power[0][:n], _power[1][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial over bytes; see :func:`range_hash`."""
    out = np.zeros(len(data) + 1, dtype=U)
    np.cumsum((data.astype(U) + U(1)) * powers(len(data))[0], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte range; equal ranges give equal values wherever they stand."""
    return mixed((prefix[end] - prefix[start]) * powers(len(prefix))[1][start] + (end - start).astype(U))


def _pieces(data: bytes) -> Iterator[bytes]:
    """The text cut at white space into blocks, so that temporary arrays stay small however long it is."""
    at = 0
    while at < len(data):
        end = at + BLOCK
        if end < len(data):
            m = WHITE.search(data, end)
            end = m.start() if m else len(data)
        yield data[at:end]
        at = end


def _block_hashes(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = _LOWER[np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)]
    space = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    ends = np.cumsum([len(p) + 1 for p in parts])
    return range_hash(prefix_hash(data), start, end), np.diff(np.searchsorted(start, ends), prepend=0)


def word_hashes(texts: list[bytes | None]) -> list[np.ndarray]:
    """A hash for every word (A-Z lower-cased, split at ASCII white space) of every text; null counts as empty."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    parts: list[bytes] = []
    owner: list[int] = []
    size = 0

    def flush() -> None:
        if parts:
            hashes, counts = _block_hashes(parts)
            for i, h in zip(owner, np.split(hashes, np.cumsum(counts)[:-1])):
                out[i].append(h)
        parts.clear()
        owner.clear()

    for i, text in enumerate(texts):
        for piece in _pieces(text or b""):
            parts.append(piece)
            owner.append(i)
            size += len(piece)
            if size >= BLOCK:
                flush()
                size = 0
    flush()
    return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.zeros(0, dtype=U) for x in out]


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash for every run of ``k`` words; a shorter text has one run, of all its words; one without words none."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    out = np.full(n - width + 1, width, dtype=U)
    for j in range(width):
        out = out * U(0x9FB21C651E98DF25) + words[j : j + n - width + 1]
    return mixed(out, 0x5DEECE66D)


# ---- blobs ---------------------------------------------------------------------------------------------------------


def dealt(bucket: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The rows of each bucket, in their order."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 65536 else bucket, kind="stable")
    there, at = np.unique(bucket[order], return_index=True)
    parts = [np.split(c[order], at[1:]) for c in columns]
    for i, b in enumerate(there):
        yield int(b), [p[i] for p in parts]


def packed_ids(ids: np.ndarray) -> bytes:
    """Ids in their order as differences, which compress well where equal ids follow each other."""
    return np.diff(ids, prepend=np.int64(0)).astype("<i8").tobytes()


def unpacked_ids(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(blob, dtype="<i8"))


# ---- components ----------------------------------------------------------------------------------------------------


class Forest:
    """Union-find over the integers 0..n-1, with the smallest member as root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: int, b: int) -> None:
        a, b = self.find(int(a)), self.find(int(b))
        if a != b:
            self.up[max(a, b)] = min(a, b)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``a, b`` (long): each vertex once as ``node``, with the smallest one it reaches as ``root``.

    Alternates large-star and small-star steps (Kiveris and others, 2014): every vertex links its larger neighbours,
    then its smaller ones, to its smallest.  The number of edges never grows, a step joins on a pre-aggregated minimum
    of each vertex, and a vertex with very many neighbours is dealt over tasks by the skewed join of adaptive
    execution.  Null ends and loops count as no edge.
    """
    e = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (
            both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a")
            .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .filter("a > b")
            .distinct()
        )
        e = stored(small)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if now == before or now[0] == 0:
            break
        before = now
    roots = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
