"""Ranked search against scores computed for every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from adlumen.llm import lexical

SCHEMA = "doc_id long, text string, item string, rank string, score string, term int, ids string"
ITEM_SCHEMA = "item_id long, text string, doc_id string, score int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, top=20):
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item_id, text in dict.fromkeys(items):
        scores = []
        for i, bag in bags:
            m = 100 - 25 + 25 * sum(bag.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 12 * m)) for t in terms(text))
            if s > 0:
                scores.append((-s, i is None, i if i is not None else 0))
        out += [(item_id, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:top])]
    return out


def corpus():
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(60)] + ["Été", "naïve", "日本", "x1", "A"]
    share = 1 / np.arange(1, len(words) + 1)
    text = lambda k: " ".join(rng.choice(words, size=k, p=share / share.sum()))
    docs = [(i, text(int(k))) for i, k in enumerate(rng.integers(1, 80, size=700))]
    docs += [(1000 + i, docs[3][1]) for i in range(60)] + [(None, docs[3][1]), (5, docs[9][1]), (5, docs[9][1])]
    docs += [(2000, None), (2001, ""), (2002, " .,;"), (2003, text(40_000)), (2004, "w" * 30_000), (-7, docs[3][1])]
    items = [(i, text(int(k))) for i, k in enumerate(rng.integers(1, 40, size=30))]
    items += [(90, docs[3][1]), (91, None), (92, ""), (93, "?!"), (94, "unheard of"), (95, "w0 W0 w0 w59"), (96, "w0"), (96, "w1"), (90, docs[3][1]), (None, "w58 w2")]
    return docs, items


@pytest.mark.parametrize("block,run,short", [(8 << 20, 128, 16), (3000, 4, 3), (20_000, 16, 1000)])
def test_against_all_scores(spark, monkeypatch, block, run, short):
    monkeypatch.setattr(lexical, "BLOCK_TEXT", block)
    monkeypatch.setattr(lexical, "RUN", run)
    monkeypatch.setattr(lexical, "SHORT", short)
    docs, items = corpus()
    df = spark.createDataFrame([(*d, "a", "b", "c", 1, "d") for d in docs], SCHEMA).repartition(3)
    got = lexical.ranked(df, spark.createDataFrame([(*i, "x", 2) for i in items], ITEM_SCHEMA))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(brute(docs, items), key=str)


def test_packs(spark, monkeypatch):
    monkeypatch.setattr(lexical, "PACK_ITEMS", 7)
    docs, items = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = lexical.ranked(df, spark.createDataFrame(items, "item_id long, text string"), top=3)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(brute(docs, items, 3), key=str)


def test_pieces(monkeypatch):
    """Terms don't depend on where the texts are cut for hashing."""
    texts = [t.encode() for _, t in corpus()[0] if t]
    whole = lexical.terms_of(texts)
    monkeypatch.setattr(lexical, "BLOCK", 50)
    assert all((a == b).all() for a, b in zip(whole, lexical.terms_of(texts)))


def test_empty(spark):
    none, docs, items = spark.createDataFrame([], SCHEMA), corpus()[0], spark.createDataFrame([(1, "w0", "x", 2)], ITEM_SCHEMA)
    assert lexical.ranked(none, items).count() == 0
    assert lexical.ranked(spark.createDataFrame(docs, "doc_id long, text string"), items.filter("item_id > 1")).count() == 0
    assert lexical.ranked(spark.createDataFrame([(1, "..."), (2, None)], "doc_id long, text string"), items).count() == 0
