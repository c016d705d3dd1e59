"""Nearest neighbours against brute force."""

import math

import numpy as np
import pytest

from adlumen.llm import rotated

SCHEMA = "vec_id long, embedding array<float>, key string, x string, ids int, tile string"


def cosine(x, y):
    dot = a = b = 0.0
    for p, q in zip(x, y):
        dot, a, b = dot + p * q, a + p * p, b + q * q
    return max(-1.0, min(1.0, dot / math.sqrt(a * b)))


def brute(rows, top=5, every=50):
    good = [
        (i, tuple(float(np.float32(c)) for c in v)) for i, v in rows
        if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)
    ]
    good = list(dict.fromkeys(good))
    out = []
    for i, v in good:
        if i % every == 0:
            found = sorted((-cosine(v, w), j) for j, w in good if j != i and len(w) == len(v))[:top]
            out += [(i, k + 1, j, -s) for k, (s, j) in enumerate(found)]
    return out


def table(seed, width, groups, loose):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        base = rng.normal(size=width)
        rows += [(base + rng.normal(size=width) * rng.choice([0.0, 0.05, 0.4])).astype(np.float32).tolist() for _ in range(int(rng.integers(1, 9)))]
    rows += rng.normal(size=(loose, width)).astype(np.float32).tolist()
    rows += [rows[0]] * 130 + [(2 * np.array(rows[3])).tolist()] * 3
    rng.shuffle(rows)
    return rows


def ran(spark, rows, **options):
    df = spark.createDataFrame([(*r, "a", "b", 3, "c") for r in rows], SCHEMA).repartition(3)
    return [tuple(r) for r in rotated.nearest(df, **options).collect()]


@pytest.mark.parametrize("width,every,tile,chunk,pairs", [(64, 10, 16_384, 16_384, 1 << 20), (24, 7, 100, 11, 500), (100, 50, 300, 5, 4000)])
def test_against_brute_force(spark, monkeypatch, width, every, tile, chunk, pairs):
    for name, value in (("TILE_ROWS", tile), ("CHUNK_ROWS", chunk), ("PAIRS", pairs), ("SAMPLE", 200)):
        monkeypatch.setattr(rotated, name, value)
    rows = list(enumerate(table(width, width, 60, 700)))
    got, want = ran(spark, rows, every=every), brute(rows, every=every)
    assert len(got) == len(want)
    assert len(set(got) & set(want)) >= 0.99 * len(want)


def test_odd_rows(spark):
    """Nulls, zeros, not finite numbers, other lengths, repeated ids and rows, few candidates."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(160)]
    rows += [(None, rows[0][1]), (200, None), (250, []), (300, [0.0] * 6), (350, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (400, [float("nan")] * 6)]
    rows += [(450, [float("inf")] * 6), (500, [1.0, 2.0]), (501, [2.0, 4.0]), (502, [2.0, 1.0]), (550, [1.0, 1.0, 1.0]), (-50, rows[7][1])]
    rows += [rows[50], rows[50], (100, rows[3][1]), (100, rows[4][1]), (600, [-0.0, 1.0] + [0.0] * 4), (601, [0.0, 1.0] + [0.0] * 4)]
    assert sorted(ran(spark, rows)) == sorted(brute(rows))


def test_estimates_hold_their_bounds():
    rng = np.random.default_rng(2)
    x, q = (rotated.unit(rng.normal(size=(n, 96)) + 1.5) for n in (4000, 50))
    centre, turn = rotated.unit(x.mean(axis=0)), rotated.rotation(96)
    assert np.allclose(turn @ turn.T, np.eye(96))
    codes = rotated.Codes(x, centre, turn)
    estimate, most, true = codes.reaches(q, centre, turn, 0.0), codes.reaches(q, centre, turn), q @ x.T
    assert (true <= most).mean() > 0.995
    assert (most - estimate).max() < 0.5 and np.corrcoef(estimate.ravel(), true.ravel())[0, 1] > 0.8


def test_given_vectors(spark):
    """Recall over the small given table, all queries."""
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    got, want = [tuple(r) for r in rotated.nearest(df).collect()], brute(rows)
    assert len(got) == len(want) and len(set(got) & set(want)) >= 0.98 * len(want)


def test_empty(spark):
    assert ran(spark, []) == [] and ran(spark, [(1, [1.0, 2.0])]) == [] and ran(spark, [(50, [1.0, 2.0])]) == []
