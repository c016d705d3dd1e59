"""Every stage of the pipeline against the result of a plain version, and the rows it must keep."""

import random

import pytest

import corpus_pipeline
from adlumen.llm import packing, sanitize
from adlumen.llm.queries import QUERIES, SQL, public_tokenizer
from test_partenum import brute as groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "extra"]


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    r = random.Random(1)
    good = lambda: ". ".join(" ".join(r.choice(["sun", "moon", "river", "walks", "under", "stone"]) + str(r.randrange(40)) for _ in range(9)) for _ in range(r.randrange(2, 20))) + "."
    bad = lambda: " | ".join(r.choice(["BUY!!", "click###", "x$$$"]) for _ in range(r.randrange(20, 90)))
    rows = [(i, good() if i % 4 else bad()) for i in range(240)]
    item = " ".join(f"answer{i}" for i in range(30))
    rows += [(300, rows[1][1]), (301, rows[1][1] + " tail"), (302, good() + " " + item), (303, good() + " write to x@y.zz"), (304, None), (305, "")]
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(*x, "en", "s", 1, None) for x in rows], "doc_id long, text string, lang string, source string, n_chars long, extra string")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, dict(rows)


def test_stages(spark, given):
    folder, texts = given
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "packing"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).cache()
        assert docs.columns == COLUMNS, name
        kept.append({r["doc_id"]: r["text"] for r in docs.collect()})
    quality, single, clean, private = kept
    assert {i for i in texts if i < 240 and i % 4} <= quality.keys() and not {i for i in range(0, 240, 4)} & quality.keys()
    assert set(single) == {d for d, n, c in groups(list(quality.items())) if n == 0 or d == c}
    assert set(clean) == set(single) - {302} and 300 not in single and 301 not in single
    assert set(private) == set(clean) and private[303].endswith("write to [EMAIL]")
    assert all(private[i] == clean[i] for i in clean if i != 303)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    encode = packing.Encoder(*public_tokenizer())
    assert {r["doc_id"]: r["doc_tokens"] for r in last} == {i: len(encode(t or "")) // 4 + 1 for i, t in private.items()}


def test_run(spark, given):
    out = corpus_pipeline.run(spark, given[0])
    assert out.columns[:2] == ["doc_id", "start"] and out.count() > 150


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11)) and set(SQL) <= set(QUERIES)
    assert sanitize.KINDS[:4] == ("email", "ip", "card", "phone")
