import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from adlumen.operators import ranking, scale, split


def test_quantiles_by_narrowing(spark):
    rng = np.random.default_rng(1)
    groups = {"a": np.round(rng.lognormal(8, 3, 3000), 2), None: -rng.random(50), "one": np.array([4.0]), "hot": np.r_[np.zeros(2000), rng.random(999)]}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    for small in (0, 10**6):
        got = {(r["g"], r["prob"]): r["value"] for r in ranking.quantiles(df, ["v"], probs, ["g"], small=small).collect()}
        assert len(got) == len(groups) * len(probs)
        for g, vs in groups.items():
            for p in probs:
                assert got[g, p] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-12)


def test_infinities_and_nan_end_and_agree(spark):
    rows = [(g, float(v)) for g, vs in {"inf": [*range(50), "inf"], "nan": [*range(50), "nan"], "both": ["-inf", "inf", "nan", "nan", 1, 5e-324, 0, -3]}.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.3, 0.5, 0.97, 1.0]
    a, b = ({(r["g"], r["prob"]): str(r["value"]) for r in ranking.quantiles(df, ["v"], probs, ["g"], small=small).collect()} for small in (0, 10**6))
    assert a == b and len(a) == 15
    assert a["inf", 1.0] == "inf" and a["nan", 1.0] == "nan" and a["both", 0.0] == "-inf"


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), min_size=1, max_size=40))
def test_any_rank_of_any_doubles(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ranks = spark.range(-1, len(values) + 1).select(F.col("id").alias("rank"))
    got = {r["rank"]: r["value"] for r in ranking.values_at_ranks(df, "v", ranks, sort_rows=0).collect()}
    assert got == {i: v for i, v in enumerate(sorted(values))}


def test_integer_ranks(spark):
    rng = np.random.default_rng(3)
    values = np.sort(np.r_[rng.integers(0, 2**60, 5000), np.full(2500, 7)])
    df = spark.createDataFrame([(int(v),) for v in values], "v long")
    wanted = [0, 1000, 2499, 2500, 6000, 7499]
    found = ranking.values_at_ranks(df, "v", spark.createDataFrame([(r,) for r in wanted], "rank long"), sort_rows=0)
    assert {r["rank"]: r["value"] for r in found.collect()} == {r: int(values[r]) for r in wanted}


def test_hashes_at_ranks(spark):
    """Even hashes by their brackets; equal keys, which no bracket holds, by narrowing."""
    df = spark.range(6000).select((F.col("id") % 3).alias("g"), ranking.hash_number(F.col("id")).alias("h"))
    values = {g: sorted(r["h"] for r in df.filter(F.col("g") == g).collect()) for g in range(3)}
    wanted = [(g, r, 2000) for g in range(3) for r in (-1, 0, 7, 900, 1998, 1999, 2000)]
    found = ranking.hashes_at_ranks(df, spark.createDataFrame(wanted, "g long, rank long, n long"), "h", ["g"])
    assert {(r["g"], r["rank"]): r["value"] for r in found.collect()} == {(g, r): values[g][r] for g, r, _ in wanted if 0 <= r < 2000}
    same = df.withColumn("h", F.when(F.col("g") == 1, F.lit(5)).otherwise(F.col("h")))
    again = ranking.hashes_at_ranks(same, spark.createDataFrame([(1, 1500, 2000), (2, 900, 2000)], "g long, rank long, n long"), "h", ["g"])
    assert {(r["g"], r["value"]) for r in again.collect()} == {(1, 5), (2, values[2][900])}


def test_places_of_ranks(spark):
    rng = np.random.default_rng(8)
    values = np.sort(np.r_[np.round(rng.lognormal(3, 2, 4000), 1), np.zeros(2500), [-5.0, 1e300]])
    df = spark.createDataFrame([(float(v),) for v in rng.permutation(values)] + [(None,), (float("nan"),)], "v double")
    ranks = [0, 1, 2499, 2500, 2501, 3000, 5000, len(values) - 1]
    want = {r: (values[r], int((values < values[r]).sum()), int((values == values[r]).sum())) for r in ranks}
    assert ranking.places_of_ranks(df, "v", ranks) == want
    assert ranking.places_of_ranks(df.filter("v is null"), "v", ranks) == {}


def test_quantiles_of_many_columns_and_no_rows(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 4))
    df = spark.createDataFrame([(str(i % 2), *map(float, r), None) for i, r in enumerate(x)], "g string, `a b` double, b double, c double, d double, e double")
    for small in (0, 10**6):
        got = {(r["g"], r["column"], r["prob"]): r["value"] for r in ranking.quantiles(df, ["a b", "c", "e"], [0.1, 0.5], ["g"], small=small).collect()}
        want = {(str(g), c, p): np.quantile(x[g::2, k], p) for g in (0, 1) for c, k in (("a b", 0), ("c", 2)) for p in (0.1, 0.5)}
        assert got == pytest.approx(want)
        assert ranking.quantiles(df.filter("false"), ["b"], [0.5], small=small).count() == 0


def test_exact_sample(spark):
    df = spark.range(5000).withColumn("k", F.col("id").cast("string"))
    a = {r["id"] for r in split.exact_sample(df, 700, "k").collect()}
    assert len(a) == 700 and a == {r["id"] for r in split.exact_sample(df.repartition(7), 700, "k").collect()}
    assert split.exact_sample(df, 9999, "k").count() == 5000


def test_hash_split_is_a_partition(spark):
    df = split.hash_split(spark.range(4000), "id")
    counts = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    assert sum(counts.values()) == 4000 and abs(counts["test"] - 600) < 90 and abs(counts["val"] - 600) < 90


def test_bins_with_ties(spark):
    rows = [(str(i), 0.0 if i < 40 else float(i)) for i in range(101)]
    df = spark.createDataFrame(rows, "k string, cost double")
    sizes = {r["cost_bin"]: r["count"] for r in split.cost_bins(df, "k", 4).groupBy("cost_bin").count().collect()}
    assert sizes == {1: 26, 2: 25, 3: 25, 4: 25}  # ranks cut at 26, 51, 76


def test_strata_fall_back(spark):
    few = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0), ("c", "y", 3.0), ("d", "y", 4.0)], "k string, business_type string, cost double")
    _, q = split.safe_strata(few, "k")
    assert q == 2
    lone = few.filter("k != 'd'")
    rows, q = split.safe_strata(lone, "k")
    assert q is None and rows.select("stratum").distinct().count() == 1
    mixed = few.withColumn("cost", F.when(F.col("k").isin("a", "c"), 1.0).otherwise(9.0))
    assert split.safe_strata(mixed, "k")[1] == 1


def test_strata_are_counted_by_place(spark):
    """A row isn't repeated for every number of bins; sizes equal those of every row's own bin, ties and nulls included."""
    rows = [("ab"[i % 7 == 0], [1.0, 2.0, 2.0, 3.5, -0.0, 0.0, float("nan"), None, float("inf")][i % 9], i * 37 % 101) for i in range(300)]
    df = spark.createDataFrame(rows, "label string, cost double, t long")
    edges = {1: [], **split._upper_edges(df, "cost", "t", 6)}
    got = split._smallest_strata(df, "cost", "t", edges)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [label" in plan[plan.index("Generate explode"):]
    want = {
        q: df.groupBy("label", (split._bin(F.col("cost"), F.col("t"), e) if e else F.lit(1)).alias("bin")).count().agg(F.min("count")).first()[0]
        for q, e in edges.items()
    }
    assert {r["q"]: r["smallest"] for r in got.collect()} == want and len(want) == 6


def test_stratified_split_shares(spark):
    rows = [(str(i), "hot" if i % 3 else f"t{i % 5}", float(i % 17)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, business_type string, cost double")
    out = split.stratified_split(df, "k").collect()
    assert len(out) == 900 and len({r["k"] for r in out}) == 900
    n = {s: sum(r["split"] == s for r in out) for s in ("train", "val", "test")}
    assert abs(n["test"] - 90) <= 25 and abs(n["val"] - 90) <= 25 and n["train"] > 650


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0, "g"), (2.0, 5.0, "g"), (None, 5.0, "g"), (9.0, None, "h")], "x double, c double, g string")
    moments = scale.fit_standard(df, ["x", "c"])
    assert set(moments) == {"x"}
    assert scale.moments_from_table(scale.moments_table(spark, moments)) == moments
    z = [r["x"] for r in scale.apply_standard(df, moments).collect() if r["x"] is not None]
    assert np.mean(z) == pytest.approx(0) and np.std(z, ddof=1) == pytest.approx(1)
    filled = scale.median_impute(df, ["x", "c"], ["g"]).orderBy("g", "x").collect()
    assert [(r["x"], r["c"]) for r in filled] == [(1.0, 5.0), (1.5, 5.0), (2.0, 5.0), (9.0, 0.0)]
    robust = scale.robust_scale(df.fillna(0.0, ["x"]), ["x", "c"]).collect()
    assert sorted(r["x"] for r in robust) == pytest.approx(sorted((np.array([1, 2, 0, 9]) - 1.5) / 3.0))
    assert {r["c"] for r in robust} == {0.0, None}  # no spread counts as 1
