"""Packing: exact round trips of token ids."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from adlumen.llm import packing

public = pytest.importorskip("public_tokenizers")
FILES = (public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
SCHEMA = "doc_id long, text string, deal string, length string"


def test_both_libraries_agree():
    quick, plain = packing.Encoder(*FILES), packing.Encoder(FILES[0])
    letters = [chr(c) for c in range(0x2030) if not packing._OTHER_CHARACTER.search(chr(c))]
    r = random.Random(3)
    for _ in range(4000):
        text = "".join(r.choice(letters if r.random() < 0.4 else ["a", "B", " ", " ", "\n", "'s", "'LL", "1", "!", "é", "  "]) for _ in range(r.randrange(0, 14)))
        assert quick(text) == plain(text)
    assert quick("中文 <|endoftext|>") == plain("中文 <|endoftext|>")
    dealt = Tokenizer.from_file(FILES[0])
    for text in ("a <|endoftext|> b", "<|endoftext|>", "plain text", "<|endoftext|"):
        assert np.frombuffer(quick(text), dtype="<u4").tolist() == dealt.encode(text, add_special_tokens=False).ids
    assert 50256 in np.frombuffer(quick("a <|endoftext|> b"), dtype="<u4")


def test_round_trip(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "née", "中文", "42"]) for _ in range(r.choice([0, 1, 30, 900, 6000])))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "no id"), (5, "same id"), (5, "same id"), (102, "x" * 40_000)]
    df = spark.createDataFrame([(*x, "a", "b") for x in rows], SCHEMA).repartition(3)
    got = packing.packed(df, FILES, with_ids=True).toPandas()
    encode = packing.Encoder(FILES[0])
    want = sorted(zlib.crc32(encode(t or "") + np.array([1], dtype="<u4").tobytes()) for _, t in rows)
    # Every document once: put pieces of each (id, tokens) together in the order of their starts.
    whole = []
    for _, part in got.groupby(["doc_id", "doc_tokens"], dropna=False):
        for copy in range((part["start"] == 0).sum()):
            mine = part.sort_values(["start", "sequence_id", "offset"]).groupby("start").nth(copy).sort_values("start")
            whole.append(zlib.crc32(b"".join(mine["ids"])))
            assert (mine["start"].to_numpy() == np.concatenate(([0], mine["length"].cumsum()[:-1]))).all()
    assert sorted(whole) == want
    assert (got["ids"].map(zlib.crc32) == got["ids_crc32"]).all() and (got["ids"].map(len) == 4 * got["length"]).all()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert (s["offset"].to_numpy() == np.concatenate(([0], s["length"].cumsum()[:-1]))).all() and s["length"].sum() <= 2048
        used = int(s["length"].sum())
        assert set(s["sequence_tokens"]) == {used} and set(s["padded_to"]) == {used if used & (used - 1) == 0 else 2048}


def test_first_fit_is_first_fit():
    rng = np.random.default_rng(2)
    for _ in range(50):
        lengths = np.sort(rng.integers(1, 101, rng.integers(0, 60)))[::-1]
        room, want = [], []
        for n in lengths:
            b = next((i for i, c in enumerate(room) if c >= n), len(room))
            room[b : b + 1] = [(room[b] if b < len(room) else 100) - n]
            want.append(b)
        assert packing.first_fit(lengths, 100).tolist() == want


def test_empty(spark):
    assert packing.packed(spark.createDataFrame([], SCHEMA), FILES).count() == 0
