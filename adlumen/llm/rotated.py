"""Nearest neighbours by cosine with randomly rotated one-bit codes (RaBitQ: Gao and Long, 2024).

Vectors are scaled to length 1 and dealt to the nearest of a few centres, fitted on a bounded sample.  A vector is stored
as the signs of its rotated offset from its centre, one bit a dimension, with three correction scalars: the length of the
offset, its product with the centre and its product with its own code.  A query's rotated offset is cut into ``PLANES``
bit planes, so the product of code and query is a weighted count of common bits; the scalars turn it into an estimate of
the cosine and a bound of its error.  Only vectors whose estimate plus bound reaches the best found so far are compared
in double precision, and a centre's vectors are not read at all for a query that their covering radius keeps too far
away.  The first centres of a query set its mark; then every other centre that may hold something better is scanned.

Equal vectors are one class with its ``TOP + 1`` smallest ids, which are all that an answer can name, and equal queries
are answered once.  The index is cut into tiles and the queries into chunks of bounded size; a task holds one of each, so
neither a hot vector nor a large cell gathers in one place.

An estimate fails its bound with a probability of about 0.1 % (``ERRORS`` deviations), which is all that keeps the result
from being exact; tests measure the recall against brute force.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from adlumen.llm.common import small_batches, stored

TOP, EVERY = 5, 50
# Centres at most, and vectors (and bytes of them) they are fitted on.
CENTRES, SAMPLE, SAMPLE_BYTES, ROUNDS = 256, 16_384, 16 << 20, 5
TILE_ROWS, CHUNK_ROWS = 4_096, 16_384
# Centres that set a query's mark.
FIRST = 3
PLANES, ERRORS = 6, 3.0
# Pairs of a query and a code estimated at once.
PAIRS = 1 << 17
# What single precision may be off.
SLACK = 1e-5
NOTHING = -2.0


# ---- vectors -------------------------------------------------------------------------------------------------------


def vectors(df: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id, key, x``: the rows that take part; ``key`` is a 128-bit hash of the numbers, ``x`` holds them as doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, numbers = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or not v or None in v:
                    continue
                # Adding 0 makes -0 the same number as 0.
                x = np.array(v, dtype=np.float64) + 0.0
                with np.errstate(over="ignore"):
                    norm = float(x @ x)
                if np.isfinite(x).all() and 0 < norm < math.inf:
                    ids.append(i)
                    numbers.append(x.astype("<f8").tobytes())
                    keys.append(hashlib.blake2b(numbers[-1], digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(numbers, pa.binary())], names=["vec_id", "key", "x"])

    rows = df.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "vec_id long, key binary, x binary")


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=-1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``x`` with that of ``y``, summed from the first number on: the same for a pair anywhere."""
    dot, a, b = (np.zeros(len(x)) for _ in range(3))
    for d in range(x.shape[1]):
        p, q = x[:, d], y[:, d]
        dot += p * q
        a += p * p
        b += q * q
    return np.clip(dot / np.sqrt(a * b), -1, 1)


# ---- centres -------------------------------------------------------------------------------------------------------


def fit_centres(sample: np.ndarray, wanted: int) -> np.ndarray:
    """Spherical k-means on a sample of unit vectors of one length."""
    centres = sample[:: max(1, len(sample) // wanted)][:wanted].copy()
    for _ in range(ROUNDS):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        length = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(length[:, None] > SLACK, sums / np.maximum(length, SLACK)[:, None], centres)
    return centres


class Cells:
    """The centres by length of vector.  A length that the sample has not has one cell around 0."""

    def __init__(self, sample: list[np.ndarray], wanted: int):
        self.centres: dict[int, np.ndarray] = {}
        self.base: dict[int, int] = {}
        for n in sorted({len(x) for x in sample}):
            rows = unit(np.array([x for x in sample if len(x) == n]))
            self.base[n] = sum(len(c) for c in self.centres.values())
            self.centres[n] = fit_centres(rows, max(1, min(len(rows), round(wanted * len(rows) / len(sample)))))

    def of(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Cell numbers and centres for vectors of this length."""
        if length not in self.centres:
            return np.array([-length]), np.zeros((1, length))
        return self.base[length] + np.arange(len(self.centres[length])), self.centres[length]


def rotation(length: int) -> np.ndarray:
    """A random rotation, the same for every task."""
    q, r = np.linalg.qr(np.random.default_rng(length).normal(size=(length, length)))
    return q * np.sign(np.diag(r))


# ---- codes ---------------------------------------------------------------------------------------------------------


class Codes:
    """One cell's unit vectors ``u`` as packed signs of their rotated offsets, and the correction scalars.

    ``far``: length of the offset; ``along``: product of vector and centre; ``own``: product of the offset's direction
    and its code.
    """

    def __init__(self, u: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        offset = u - centre
        turned = offset @ turn
        self.far = np.sqrt((offset * offset).sum(axis=1))
        self.along = u @ centre
        self.own = np.abs(turned).sum(axis=1) / np.maximum(self.far, SLACK) / math.sqrt(u.shape[1])
        self.words = packed(turned > 0)
        self.ones = np.bitwise_count(self.words).sum(axis=1).astype(np.int64)

    def reaches(self, q: np.ndarray, centre: np.ndarray, turn: np.ndarray, errors: float = ERRORS) -> np.ndarray:
        """For unit queries ``q``: estimates of all cosines plus ``errors`` bounds of their errors, a row per query.

        The sum over common bits is the only term of rank above one; all others are one product of narrow matrices.
        """
        length = q.shape[1]
        offset = q - centre
        turned = offset @ turn
        low = turned.min(axis=1)
        step = np.maximum((turned.max(axis=1) - low) / ((1 << PLANES) - 1), 1e-12)
        level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.int64)
        rounded = np.abs(turned - (low[:, None] + step[:, None] * level)).sum(axis=1)
        common = np.zeros((len(q), len(self.far)), dtype=np.uint16 if length < 1024 else np.uint32)
        for p in range(PLANES):
            plane = packed((level >> p & 1).astype(bool))
            for w in range(plane.shape[1]):
                both = np.bitwise_count(plane[:, w][:, None] & self.words[:, w][None, :])
                common += np.left_shift(both, p, dtype=common.dtype)
        own = np.maximum(self.own, 0.05)
        scale = self.far / (own * math.sqrt(length))
        spread = self.far * np.sqrt(np.maximum(1 - own * own, 0)) / own / math.sqrt(max(length - 1, 1))
        # Product with the signs: twice what the set bits add, less all.
        whole = step * level.sum(axis=1) + length * low
        ones = np.ones(len(q))
        by_query = (2 * low, (rounded if errors else 0) - whole, ones, q @ centre - centre @ centre + (SLACK if errors else 0), errors * np.sqrt((offset * offset).sum(axis=1)))
        by_code = (scale * self.ones, scale, self.along, np.ones(len(scale)), spread)
        out = np.stack(by_query, axis=1).astype(np.float32) @ np.stack(by_code).astype(np.float32)
        return out + common * ((2 * step).astype(np.float32)[:, None] * scale.astype(np.float32)[None, :])


def packed(bits: np.ndarray) -> np.ndarray:
    out = np.zeros((len(bits), -(-bits.shape[1] // 64)), dtype="<u8")
    out.view(np.uint8).reshape(len(bits), -1)[:, : -(-bits.shape[1] // 8)] = np.packbits(bits, axis=1, bitorder="little")
    return out


# ---- search --------------------------------------------------------------------------------------------------------


class Answers:
    """The best ids of each query of a chunk, at most ``keep``."""

    def __init__(self, keep: int, mark: np.ndarray):
        self.keep, self.mark = keep, mark.copy()
        self.row, self.score, self.id = np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64)

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        row, score, ids = (np.concatenate(x) for x in ((self.row, row), (self.score, score), (self.id, ids)))
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        new = np.flatnonzero(np.diff(row, prepend=-1))
        place = np.arange(len(row)) - np.repeat(new, np.diff(new, append=len(row)))
        kept = place < self.keep
        self.row, self.score, self.id = row[kept], score[kept], ids[kept]
        full = place == self.keep - 1
        self.mark[row[full]] = np.maximum(self.mark[row[full]], score[full])


def scan(answers: Answers, q: np.ndarray, rows: np.ndarray, x: np.ndarray, ids: np.ndarray, sizes: np.ndarray, codes: Codes, centre: np.ndarray, turn: np.ndarray) -> None:
    """Bring the answers of the queries ``rows`` (places in ``q``) up to date with a cell's classes.

    ``ids`` holds ``sizes`` ids of each class, one class after another.
    """
    u, found = unit(x), []
    step = max(1, PAIRS // max(len(x), 1))
    for at in range(0, len(rows), step):
        part = rows[at : at + step]
        uq, mark = unit(q[part]), answers.mark[part]

        def compared(i: np.ndarray, j: np.ndarray, part=part, uq=uq, mark=mark) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """The pairs that reach the mark, with their cosines; a product of unit vectors rules most others out."""
            near = np.einsum("pd,pd->p", uq[i], u[j]) >= mark[i] - SLACK
            i, j = i[near], j[near]
            score = cosines(q[part[i]], x[j])
            good = score >= mark[i]
            return i[good], j[good], score[good]

        reach = codes.reaches(uq, centre, turn)
        if (mark == NOTHING).any():
            # The best estimates give a first mark.
            some = min(answers.keep, len(x))
            ahead = np.argpartition(-codes.reaches(uq, centre, turn, 0.0), some - 1, axis=1)[:, :some]
            i = np.repeat(np.arange(len(part)), some)
            score = np.full((len(part), some), NOTHING)
            if some == answers.keep:
                score = np.einsum("pd,pd->p", uq[i], u[ahead.ravel()]).reshape(len(part), some)
            mark[:] = np.maximum(mark, score.min(axis=1) - SLACK)
        i, j = np.nonzero(reach >= mark[:, None])
        i, j, score = compared(i, j)
        found.append((part[i], j, score))
    row, j, score = (np.concatenate(f) for f in zip(*found))
    first, n = np.cumsum(sizes) - sizes, sizes[j]
    wanted = np.repeat(first[j] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    answers.add(np.repeat(row, n), np.repeat(score, n), ids[wanted])


def nearest(
    df: DataFrame, top: int = TOP, every: int = EVERY, id_column: str = "vec_id", vector_column: str = "embedding", probes: int | None = None
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` vectors of the largest cosine for each row whose id ``every`` divides.

    A vector that is null, empty or zero, holds a null or a number that is not finite, or has no id takes no part; vectors
    of other lengths are no candidates of each other.  A row that is there more than once counts once; rows that share an id with other
    vectors are queries of their own and not each other's candidates.  Equal scores go to the smaller id; a query with
    fewer candidates gets them all.  With ``probes`` a query scans so many centres at most, for tables on which all that may
    matter are too many; by default it scans them all.  Extra columns are ignored, an empty table gives an empty result.
    """
    spark = df.sparkSession
    small_batches(spark)
    keep = top + 1
    rows = stored(vectors(df, id_column, vector_column).distinct())
    by_key = Window.partitionBy("key").orderBy("vec_id")
    # Ids of a class: an answer names ``top`` others than the query's own at most.  The rank's limit holds before the shuffle.
    few = rows.withColumn("place", F.row_number().over(by_key)).filter(F.col("place") <= keep)
    asked = F.max((F.col("vec_id") % every == 0).cast("int"))
    # Whether any id of a class asks is counted over all of them.
    asking = rows.groupBy("key").agg(asked.alias("asks"))
    classes = few.groupBy("key").agg(F.first("x").alias("x"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = stored(classes.join(asking, "key"))

    counted = classes.agg(F.count("*").alias("n"), F.sum("asks").alias("asks"), F.max(F.octet_length("x")).alias("bytes")).first()
    if not counted["n"] or not counted["asks"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # A bounded sample in the order of the keys, which are hashes.
    sample = [np.frombuffer(r["x"]) for r in classes.select("key", "x").orderBy("key").limit(max(1, min(SAMPLE, SAMPLE_BYTES // counted["bytes"]))).collect()]
    cells = Cells(sample, min(CENTRES, max(1, math.ceil(math.sqrt(counted["n"]) / 2))))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Classes with their cells: ``cell, far`` in place of the key and the question."""
        for batch in batches:
            lists = [np.frombuffer(b) for b in batch.column(0).to_pylist()]
            cell, far = np.zeros(len(lists), dtype=np.int64), np.zeros(len(lists))
            lengths = np.array([len(x) for x in lists])
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                numbers, centres = cells.of(int(n))
                u = unit(np.array([lists[i] for i in at]))
                near = (u @ centres.T).argmax(axis=1)
                cell[at], far[at] = numbers[near], np.sqrt(((u - centres[near]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(far), *batch.columns], names=["cell", "far", "x", "ids"])

    placed = stored(classes.select("x", "ids").mapInArrow(dealt, "cell long, far double, x binary, ids array<long>"))
    # One row per cell: at most CENTRES, and one per length of vector that the sample has not.
    sizes = {r["cell"]: (r["n"], r["radius"]) for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()}
    # A cell larger than a tile has several; small ones share a tile.
    tiles: dict[int, tuple[int, int]] = {}
    filled = number = 0
    for c in sorted(sizes):
        if filled and filled + sizes[c][0] > TILE_ROWS:
            number, filled = number + 1, 0
        tiles[c] = (number, max(1, math.ceil(sizes[c][0] / TILE_ROWS)))
        filled += sizes[c][0]
        if tiles[c][1] > 1:
            number, filled = number + tiles[c][1], 0
    chunks = max(1, math.ceil(counted["asks"] / CHUNK_ROWS))

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = batch.column(0).to_pylist()
            split = [int.from_bytes(hashlib.blake2b(b, digest_size=4).digest()) for b in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([tiles[c][0] + s % tiles[c][1] for c, s in zip(cell, split)], pa.int64()), *batch.columns], names=["tile", "cell", "far", "x", "ids"]
            )

    def routed(first: bool):
        """A query's row for each tile it has to see, with the cells to scan there."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out: list[tuple] = []
                for key, b, mark in zip(*(c.to_pylist() for c in batch.columns)):
                    x = np.frombuffer(b)
                    numbers, centres = cells.of(len(x))
                    there = np.array([c in sizes for c in numbers.tolist()])
                    numbers, centres = numbers[there], centres[there]
                    # The nearest a vector of the cell can be, by the triangle inequality on the unit sphere.
                    gap = np.sqrt(np.maximum(((unit(x) - centres) ** 2).sum(axis=1), 0))
                    order = np.argsort(gap, kind="stable")
                    if first:
                        chosen = order[:FIRST]
                    else:
                        near = np.maximum(gap - np.array([sizes[c][1] for c in numbers.tolist()]), 0)
                        chosen = order[FIRST:probes]
                        chosen = chosen[1 - near[chosen] ** 2 / 2 >= mark - SLACK]
                    by_tile: dict[int, list[int]] = {}
                    for c in numbers[chosen].tolist():
                        for t in range(tiles[c][1]):
                            by_tile.setdefault(tiles[c][0] + t, []).append(c)
                    chunk = int.from_bytes(key[:4]) % chunks
                    out += [(t, chunk, key, b, mark, cs) for t, cs in by_tile.items()]
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.float64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["tile", "chunk", "key", "x", "mark", "cells"])

        return run

    def compared(queries: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        out = []
        lengths = queries["x"].map(len)
        for n in lengths.unique() if len(there) else []:
            asked = queries[lengths == n]
            q = np.frombuffer(b"".join(asked["x"])).reshape(len(asked), -1)
            answers = Answers(keep, asked["mark"].to_numpy())
            wanted: dict[int, list[int]] = {}
            for i, cs in enumerate(asked["cells"]):
                for c in cs:
                    wanted.setdefault(int(c), []).append(i)
            numbers, centres = cells.of(n // 8)
            turn = rotation(n // 8)
            for c, members in there.groupby("cell", sort=True):
                if c in wanted:
                    centre = centres[list(numbers).index(c)]
                    x = np.frombuffer(b"".join(members["x"])).reshape(len(members), -1)
                    ids, held = np.concatenate(members["ids"].tolist()), members["ids"].map(len).to_numpy()
                    scan(answers, q, np.array(wanted[c]), x, ids, held, Codes(unit(x), centre, turn), centre, turn)
            out.append(pd.DataFrame({"key": asked["key"].to_numpy()[answers.row], "score": answers.score, "vec_id": answers.id}))
        return pd.concat(out) if out else pd.DataFrame({"key": [], "score": [], "vec_id": []})

    index = stored(placed.mapInArrow(tiled, "tile long, cell long, far double, x binary, ids array<long>"))
    copies = index.select("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"), "cell", "x", "ids")
    questions = classes.filter("asks = 1").select("key", "x")
    shape = "tile long, chunk long, key binary, x binary, mark double, cells array<long>"
    by_score = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")

    def found(marked: DataFrame, first: bool) -> DataFrame:
        sent = marked.select("key", "x", "mark").mapInArrow(routed(first), shape)
        return sent.groupBy("tile", "chunk").cogroup(copies.groupBy("tile", "chunk")).applyInPandas(compared, "key binary, score double, vec_id long")

    near = stored(found(questions.withColumn("mark", F.lit(NOTHING)), True))
    best = near.withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= keep)
    marks = best.filter(F.col("place") == keep).select("key", F.col("score").alias("mark"))
    marked = stored(questions.join(marks, "key", "left").withColumn("mark", F.coalesce("mark", F.lit(NOTHING))))
    both = best.select("key", "score", "vec_id").unionByName(found(marked, False))
    kept = both.withColumn("place", F.row_number().over(by_score)).filter(F.col("place") <= keep)
    answer = F.sort_array(F.collect_list(F.struct("place", "vec_id", "score")))
    answered = stored(kept.groupBy("key").agg(answer.alias("found")))
    asking = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "key")
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, top)
    out = asking.join(answered, "key").select("query_id", F.posexplode(others).alias("i", "f"))
    return out.select("query_id", (F.col("i") + 1).cast("int").alias("rank"), "f.vec_id", "f.score")
