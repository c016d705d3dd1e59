"""Word hashes, ranges and components."""

import random
from types import SimpleNamespace

import numpy as np

from adlumen.llm import common
from plain import words


def test_word_hashes(monkeypatch):
    monkeypatch.setattr(common, "BLOCK", 64)
    r, seen = random.Random(1), {}
    for _ in range(100):
        texts = ["".join(r.choice(["A", "b", " ", "\n", "é", "zz", "\x0b"]) for _ in range(r.randrange(0, 300))) for _ in range(5)] + [None]
        for text, hashes in zip(texts, common.word_hashes([t and t.encode() for t in texts])):
            assert len(hashes) == len(words(text))
            for w, h in zip(words(text), hashes.tolist()):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_gram_hashes():
    h = common.word_hashes([b"a b c d e f", b"b c d e f", b"a b", b""])
    grams = [common.gram_hashes(x, 5) for x in h]
    assert [len(g) for g in grams] == [2, 1, 1, 0] and grams[0][1] == grams[1][0]


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000, i) for i in range(1001, 1400)] + [(i, i + 1) for i in range(2000, 2060)]
    edges += [(5, 5), (None, 3)]
    forest = common.Forest(3000)
    for a, b in edges:
        if a is not None and a != b:
            forest.join(a, b)
    got = {x["node"]: x["root"] for x in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    ends = {v for e in edges if None not in e and e[0] != e[1] for v in e}
    assert got == {v: int(forest.find(v)) for v in ends}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_scratch_is_in_the_named_folder():
    named = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: {"spark.checkpoint.dir": "store://a/b/"}.get(key, default)))
    assert common.scratch(named).startswith("store://a/b/adlumen-")


def test_ids_round_trip():
    ids = np.array([5, 5, -3, 2**62, -(2**62)], dtype=np.int64)
    assert (common.unpacked_ids(common.packed_ids(ids)) == ids).all()
