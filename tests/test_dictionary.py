"""Keyword tables joined with names, against the expression that tries each keyword."""

import random
import re

import pytest
from pyspark.sql import functions as F

from adlumen.functions import classify as kw
from adlumen.operators import joins
from adlumen.operators.dictionary import classify_names

WORDS = ["shop", "home", "bank", "real", "estate", "ab", "x", "co.", "a&b", "(uk)", "50%", "|shop", "café", "sh", "op ho"]


def names(n):
    rng = random.Random(n)
    out = [rng.choice(["", "|", " "]) + rng.choice([" ", "-", "  ", ""]).join(rng.choices(WORDS, k=rng.randint(1, 5))) for _ in range(n)]
    return out + [None, "", "|", "shop", "hot name"] + ["hot name"] * 50


def mapping():
    rng = random.Random(5)
    out = [(rng.choice([" ", ""]).join(rng.choices(WORDS, k=rng.randint(1, 3))), f"t{i % 7}") for i in range(60)]
    return out + [("HOT", "upper"), (" name ", "trimmed"), ("shop", "t9"), ("zzz", "never")]


@pytest.mark.parametrize("mode", ["prefix", "word", "substring"])
def test_equals_the_expression(spark, mode):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names(400))], "id int, name string").repartition(5)
    table = kw.mapping_frame(spark, mapping())
    got = classify_names(df, F.col("name"), table, "label", mode)
    assert got.columns == ["id", "name", "label"]
    want = df.withColumn("label", F.coalesce(kw.classify(F.col("name"), mapping(), mode), F.lit("unknown")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert len({r["label"] for r in got.collect()}) > 4


def test_empty_keyword_and_tables(spark):
    df = spark.createDataFrame([("a b",), (None,)], "name string")
    table = spark.createDataFrame([("", "any", 2), ("b", "b", 1), (None, "none", 0)], "keyword string, business_type string, priority int")
    for mode, want in (("prefix", "any"), ("word", "b"), ("substring", "b")):
        assert {r["name"]: r["l"] for r in classify_names(df, F.col("name"), table, "l", mode).collect()} == {"a b": want, None: "unknown"}
    assert classify_names(df, F.col("name"), table.limit(0), "l", default=None).filter("l IS NULL").count() == 2
    assert classify_names(df.limit(0), F.col("name"), table, "l").count() == 0
    with pytest.raises(ValueError, match="unknown matching mode"):
        classify_names(df, F.col("name"), table, "l", "fuzzy")


@pytest.mark.parametrize("mode", ["prefix", "word", "substring"])
def test_fifty_thousand_keywords(spark, mode):
    rng = random.Random(1)
    token = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 6)))
    keywords = list(dict.fromkeys(" ".join(token() for _ in range(rng.randint(1, 2))) for _ in range(50_000)))
    texts = [" ".join([rng.choice(keywords), token()] if rng.random() < 0.5 else [token(), token(), token()]) for _ in range(300)]
    table = spark.createDataFrame([(k, f"t{i}", i) for i, k in enumerate(keywords)], "keyword string, business_type string, priority int")
    assert kw.load_mapping(table) is table
    df = spark.createDataFrame([(t,) for t in texts], "name string")
    got = {r["name"]: r["l"] for r in joins.label_distinct(df, F.col("name"), table, "l", mode).collect()}
    hit = {"prefix": str.startswith, "substring": str.__contains__, "word": lambda t, k: k in t and re.search(rf"\b{re.escape(k)}\b", t) is not None}[mode]
    assert got == {t: next((f"t{i}" for i, k in enumerate(keywords) if hit(t, k)), "unknown") for t in texts}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_keywords_are_not_broadcast(spark):
    from adlumen.operators import dictionary
    from adlumen.sources.session import small_side

    names_ = spark.createDataFrame([("shop 7",), ("shop 100000",)], "_name string")
    rank = F.struct(F.col("id").alias("priority"), F.lit("t").alias("label")).alias("rank")
    many = spark.range(100_001).select(F.concat(F.lit("shop "), F.col("id").cast("string")).alias("k"), rank)
    for found in (dictionary._prefixes(names_, many), dictionary._words(names_, many)):
        assert "Broadcast" not in plan(found)
        assert {r["_name"] for r in found.collect()} == {"shop 7", "shop 100000"}
    assert "Broadcast" not in plan(spark.range(9).join(small_side(spark.range(9), 5), "id"))
    assert "BroadcastHashJoin" in plan(spark.range(9).join(small_side(spark.range(9), 9), "id"))
