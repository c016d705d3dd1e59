"""The quality classifier: held-out accuracy and edge cases."""

import random

import numpy as np

from adlumen.llm import quality

SCHEMA = "doc_id long, text string, score string, held_out string"


def corpus(n=600):
    r = random.Random(1)
    good = lambda: ". ".join(" ".join(r.choice(["sun", "moon", "river", "walks", "under"]) for _ in range(9)).capitalize() for _ in range(r.randrange(2, 30))) + "."
    bad = lambda: " | ".join(r.choice(["BUY!!", "click###", "x$$$", "now"]) for _ in range(r.randrange(5, 90)))
    rows = [(i, good() if i % 3 else bad()) for i in range(n)]
    return rows, [(i, int(i % 3 > 0)) for i in range(n)]


def test_held_out_accuracy(spark):
    rows, labels = corpus()
    rows += [(9000, None), (9001, ""), (None, "no id"), (4, rows[4][1])]
    labels += [(1, None), (None, 1), (2, 1), (777_777, 0)]
    docs = spark.createDataFrame([(*x, "a", "b") for x in rows], SCHEMA).repartition(3)
    got = quality.scored(docs, spark.createDataFrame(labels, "doc_id long, quality int")).toPandas()
    assert len(got) == len(rows) and got["score"].between(0, 1).all()
    truth = dict(labels[:600])
    held = got[got["held_out"] & got["doc_id"].isin(truth)]
    assert 100 < len(held) and (held["predicted"] == held["doc_id"].map(truth)).mean() > 0.97
    assert ((got["score"] >= 0.7).astype(int) == got["predicted"]).all()
    kept = quality.accepted(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert kept.columns == docs.columns and kept.count() == int(got["predicted"].sum())


def test_labels_of_held_out_rows_do_not_matter(spark):
    rows, labels = corpus(120)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    held = {r["doc_id"] for r in table.filter(quality.held_out(table["doc_id"])).collect()}
    flipped = spark.createDataFrame([(i, 1 - q if i in held else q) for i, q in labels], "doc_id long, quality int")
    a, b = (sorted(map(tuple, quality.scored(docs, x).collect())) for x in (table, flipped))
    assert a == b and held


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "some text", "", "")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r["score"] for r in quality.scored(docs, none).collect()] == [0.5]
    assert quality.scored(docs.limit(0), none).count() == 0


def test_trees_fit_a_step():
    x = np.linspace(0, 1, 400)[:, None]
    y = (x[:, 0] > 0.6).astype(float)
    p = quality.predict(quality.fit(x, y), x)
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.98
    assert len(set(quality.predict(quality.fit(x, np.ones(400)), x))) == 1
