"""The n-gram join against all pairs."""

import random
from fractions import Fraction

import numpy as np
import pytest

from adlumen.llm import partenum
from adlumen.llm.common import Forest

SCHEMA = "doc_id long, text string, n_shingles string, class_id string"


def brute(rows):
    sets = [partenum.shingle_sets([(t or "").encode()], 5)[0] for _, t in rows]
    forest = Forest(len(rows))
    for i, x in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(x, sets[j]))
            if len(x) and len(sets[j]) and 100 * both >= 75 * (len(x) + len(sets[j]) - both):
                forest.join(i, j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(forest.find(i), []).append(rows[i][0])
    least = {r: min([d for d in ids if d is not None], default=None) for r, ids in groups.items()}
    return [(rows[i][0], len(sets[i]), least[forest.find(i)] if len(sets[i]) else rows[i][0]) for i in range(len(rows))]


def family(seed):
    r = random.Random(seed)
    rows = []
    for base in range(24):
        words = [f"w{r.randrange(400)}" for _ in range(r.choice([1, 2, 4, 5, 6, 7, 9, 13, 20, 40, 90, 300]))]
        for _ in range(r.randrange(1, 7)):
            copy = list(words)
            for _ in range(r.randrange(0, 1 + len(copy) // 25)):
                at = r.randrange(len(copy))
                copy[at : at + 1] = r.choice([[], ["new"], [f"x{r.random()}"], [copy[at], "more"]])
            rows.append(" ".join(copy))
    r.shuffle(rows)
    rows += ["", None, " \n", "A b", "a B", rows[0]]
    return [(i if i != 3 else None, t) for i, t in enumerate(rows)] + [(1, "repeated id one"), (1, "repeated id two")]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_all_pairs(spark, seed):
    rows = family(seed)
    df = spark.createDataFrame([(*r, "x", None) for r in rows], SCHEMA)
    got = [tuple(r) for r in partenum.jaccard_components(df).collect()]
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_signatures_are_shared():
    """Every two sets at the threshold share a signature, and no fewer than ``least`` of a band both are in."""
    rng, g = np.random.default_rng(3), Fraction(3, 4)
    for _ in range(3000):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 2**62, n).astype(np.uint64))
        keep = a[: max(1, int(np.ceil(len(a) * rng.uniform(0.72, 1))))]
        b = np.unique(np.concatenate((keep, rng.integers(0, 2**62, int(rng.integers(0, max(1, n // 4) + 1))).astype(np.uint64))))
        both = len(np.intersect1d(a, b))
        if 4 * both < 3 * (len(a) + len(b) - both):
            continue
        x, y = ({band: (set(s.tolist()), least) for band, s, least in partenum.signatures(v, g)} for v in (a, b))
        common = {band: len(x[band][0] & y[band][0]) for band in x.keys() & y.keys()}
        assert any(n >= max(x[band][1], y[band][1]) for band, n in common.items()), (len(a), len(b), common)


def test_keep_one(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near = text.replace("w30", "other")
    rows = [(5, text), (2, near), (9, "different words here"), (9, "different words here"), (7, None), (8, ""), (None, text), (2, "unlike")]
    kept = partenum.keep_one(spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=str) == sorted(
        [(2, near), (9, "different words here"), (7, None), (8, ""), (2, "unlike")], key=str
    )
    assert partenum.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0
    assert partenum.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0


def test_other_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1, 2, 3), (2, "a b c d e f", 4, 5, 6), (2, "a b c d e f", 4, 5, 6)], "doc_id long, text string, _uid int, uid int, UID_ int")
    out = partenum.keep_one(df)
    assert out.columns == df.columns and [tuple(r) for r in out.collect()] == [(1, "a b c d e f", 1, 2, 3)]


@pytest.mark.parametrize("block", [1024, 5])
def test_candidates_miss_no_pair(spark, monkeypatch, block):
    """All pairs of a group that are alike, in one block or dealt to several; a sketch never rules out a similar pair."""
    monkeypatch.setattr(partenum, "BLOCK_MEMBERS", block)
    r = random.Random(9)
    base = [f"w{i}" for i in range(80)]
    texts = [" ".join(w if r.random() > x else f"v{r.random()}" for w in base) for x in (0, 0.01, 0.02, 0.05, 0.3) for _ in range(8)] + ["x " * 700_000, "tiny"]
    sets = [partenum.shingle_sets([t.encode()], 5)[0] for t in texts]
    placed = spark.createDataFrame([(g, i, i % 7, len(sets[i])) for g in (3, 4) for i in range(len(texts))], "group_id long, member long, root long, n_elements long").repartition(3)
    held = spark.createDataFrame([(i, bytearray(partenum.sketch(s))) for i, s in enumerate(sets)], "class_id long, sketch binary")
    got = {(p["a"], p["b"]) for p in partenum.candidates(placed, held, Fraction(3, 4)).collect()}
    assert got <= {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if i % 7 != j % 7}
    for i in range(len(texts)):
        for j in range(i + 1, len(texts)):
            both = len(np.intersect1d(sets[i], sets[j]))
            if i % 7 != j % 7 and 4 * both >= 3 * (len(sets[i]) + len(sets[j]) - both):
                assert (i, j) in got
    few = {(p["a"], p["b"]) for p in partenum.candidates(placed, held, Fraction(3, 4), 1).collect()}
    assert few <= got and len(got) < 500


def test_very_long_text(spark):
    long = " ".join(f"w{i}" for i in range(150_000))
    rows = [(1, long), (2, long + " more"), (3, "short text of a few words here"), (4, "y " * 400_000)]
    got = {r["doc_id"]: r["component_id"] for r in partenum.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}
