"""Fill-in-the-middle against a regular expression, and the wavelet matrix against plain counts."""

import hashlib
import re

import numpy as np
import pytest

from adlumen.llm import middle

SCHEMA = "doc_id long, text string, n string, form string, output string, draws int"


def plain(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = np.random.default_rng(3)
    letters = list("abcXYZ  \n\t.,09<>PSM|é中😀 \x00")
    out = ["".join(rng.choice(letters, size=int(k))) for k in rng.integers(0, 60, size=400)]
    out += [None, "", "a", "abc", "中", "😀", " ", "<P>", "x <S> y", "<M", "<", "a<", "word " * 20_000, "é" * 5_000, "z" * 100_000]
    return out + out[:20]


@pytest.mark.parametrize("block", [middle.BLOCK_BYTES, 200])
def test_against_regex(spark, monkeypatch, block):
    monkeypatch.setattr(middle, "BLOCK_BYTES", block)
    rows = [(i if i % 97 else None, t) for i, t in enumerate(texts())] + [(7, "one id twice"), (7, "one id twice")]
    df = spark.createDataFrame([(*r, "a", "b", "c", 4) for r in rows], SCHEMA).repartition(3)
    out = middle.transformed(df)
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=str) == sorted((plain(*r) for r in rows), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_restored(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame([(*r, "a", "b", "c", 4) for r in rows], SCHEMA)
    got = {r["doc_id"]: r for r in middle.checked(df).collect()}
    for i, t in rows:
        assert got[i]["restored_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        assert got[i]["output_sha256"] == hashlib.sha256(plain(i, t)[5].encode()).hexdigest()


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1000])
def test_ranks(size):
    symbols = np.random.default_rng(size).integers(0, 7, size=size).astype(np.uint8)
    matrix = middle.WaveletMatrix(symbols)
    at = np.arange(size + 1)
    for c in range(8):
        assert (matrix.rank(c, at) == np.concatenate(([0], np.cumsum(symbols == c)))).all()


def test_empty(spark):
    assert middle.checked(spark.createDataFrame([], SCHEMA)).count() == 0
