"""Repeated strings against a brute-force version."""

import random

import pytest

from adlumen.llm import bucketsort

SCHEMA = "doc_id long, text string, doc string, uid string, kept string"
LAST = 2**63 - 1


def brute(rows):
    seen, out = {}, []
    for i, t in rows:
        data, doc = (t or "").encode(), LAST if i is None else i
        for p in range(len(data) - 49):
            w = data[p : p + 50]
            seen[w] = min(seen.get(w, LAST), doc)
    for i, t in rows:
        data, doc = (t or "").encode(), LAST if i is None else i
        gone = bytearray(len(data))
        for p in range(len(data) - 49):
            if seen[data[p : p + 50]] < doc:
                gone[p : p + 50] = b"\1" * 50
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(data), sum(gone), runs, bytes(b for b, g in zip(data, gone) if not g)))
    return out


def corpus(seed):
    r = random.Random(seed)
    parts = ["".join(r.choice("abcdé \n") for _ in range(r.choice([10, 45, 50, 60, 120, 400]))) for _ in range(12)]
    rows = []
    for i in range(60):
        text = "".join(r.choice(parts) if r.random() < 0.7 else str(r.random()) for _ in range(r.randrange(0, 6)))
        if r.random() < 0.3 and text:
            at = r.randrange(len(text))
            text = text[:at] + "#" + text[at + 1 :]
        rows.append((i, text))
    rows += [(100, "ab" * 100), (101, "ab" * 90), (102, "a" * 300), (103, "a" * 49), (104, "a" * 50), (105, None), (106, ""), (None, parts[5]), (None, "nobody" * 20)]
    rows += [rows[3], (7, "the same id with another text, which repeats nothing at all, 7"), (200, "x" * 30 + parts[-1]), (0, "ab" * 80)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "x", "y", None) for r in rows], SCHEMA).repartition(3)
    got = [(r[0], r[1], r[2], r[3], bytes(r[4])) for r in bucketsort.without_repeats(df).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_long_text_in_pieces(spark, monkeypatch):
    r = random.Random(9)
    long = "".join(r.choice("abcdefgh ") for _ in range(700_000))
    rows = [(1, long), (2, "start " + long[262_100:262_200] + " end"), (3, long[:60] + "!" + long[-55:])]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"]) for r in bucketsort.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0, 0), 2: (100, 1), 3: (115, 2)}


def test_empty(spark):
    assert bucketsort.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_refinement_tells_windows_apart():
    import numpy as np

    data = np.frombuffer(b"a" * 120 + b"b" + b"a" * 60, dtype=np.uint8)
    place, bucket = bucketsort.refine(data, np.array([121, 181]))
    strings = {}
    for p, b in zip(place.tolist(), bucket.tolist()):
        assert strings.setdefault(b, data[p : p + 50].tobytes()) == data[p : p + 50].tobytes()
    assert len(strings) == len(set(strings.values()))
