"""Archives: round trips, revisits, damaged files."""

import io
import os

import pytest
from pyspark.sql import functions as F

from adlumen.llm import warc

SCHEMA = "page_id long, url string, html string, records string"


def test_round_trip(spark):
    long = "é<p>x</p>" * 60_000
    rows = [
        (1, "u1", "same", "x"), (7, "u7", "same", "x"), (3, None, "same", None), (4, "a\r\nb", None, None), (5, "u", "", ""),
        (6, "u", long, None), (8, "u", "alone", None), (None, "u", "same", None), (None, "u", "nobody", None), (9, "u", "twice", ""), (9, "u", "twice", ""),
    ]
    got = warc.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) >= len(rows) and all(r["verified"] for r in got)
    seen = sorted(
        ((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=lambda r: (r[0] or 0, r[2])
    )
    want = []
    for page, _, html, _ in rows:
        data = (html or "").encode()
        last = {"same": 7, "": 5, None: 5}.get(html, page)
        want.append((page, len(data), warc.base32_sha1(data), "response" if page == last else "revisit", None if page == last else last))
    assert seen == sorted(want, key=lambda r: (r[0] or 0, r[2]))


def test_least_bytes(spark):
    df = spark.createDataFrame([(1, "u", "ab", ""), (2, "u", "ab", ""), (3, "u", "abcd", ""), (4, "u", "abcd", "")], SCHEMA)
    got = {r["page_id"]: r["record_type"] for r in warc.round_trip(df, least_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_payloads_come_back(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "é" * 100_000, ""), (2, "u", "b", "")], SCHEMA)
    manifest = warc.written(df, f"file://{tmp_path}/w")
    assert manifest.agg(F.sum("records")).first()[0] == 2
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read(manifest, f"file://{tmp_path}/w", with_payload=True).collect()}
    assert got == {1: "é" * 100_000, 2: "b"}


@pytest.mark.parametrize("size", [1, 7, 1 << 16])
def test_damage(size, monkeypatch):
    monkeypatch.setattr(warc, "CHUNK", size)
    good = [warc.page_member(i, "u", os.urandom(200), None, False) for i in range(4)]
    bad = bytearray(good[1])
    bad[60] ^= 0xFF
    rows = list(warc.records(io.BytesIO(good[0] + bytes(bad) + good[2] + good[3][:-9]), "p"))
    fine = [r[5] for r in rows if r[-2] is None]
    assert fine == [0, 2] and sum(r[-2] is not None for r in rows) >= 2
    liar = warc.member([("WARC-Type", "response"), ("WARC-Payload-Digest", "sha1:AAAA")], b"text")
    short = warc.member([("WARC-Type", "response")], b"text").__class__
    assert short is bytes
    (row,) = list(warc.records(io.BytesIO(liar), "p"))
    assert row[-3] is False and row[-2] == "digest differs"
    framed = warc.zlib.compressobj(6, warc.zlib.DEFLATED, 31)
    data = framed.compress(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n") + framed.flush()
    rows = list(warc.records(io.BytesIO(data + good[0]), "p"))
    assert rows[0][-2] is not None and rows[1][-2] is None
