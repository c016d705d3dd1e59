from datetime import date

import pytest
from pyspark.sql import functions as F

from adlumen import names
from adlumen.operators import columns, dedupe, masks, metrics, profile, rollup
from adlumen.plans import campaign, features, reports


def test_alias_rename(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "`Campaign ID` int, adset_id int, spend int, other int")
    assert columns.rename_by_alias(df).columns == ["campaign_id", "ad_group_id", "cost", "other"]
    # The first listed alias wins over a later one.
    df = spark.createDataFrame([(1, 2)], "spend int, cost int")
    assert columns.rename_by_alias(df).columns == ["spend", "cost"]
    with pytest.raises(ValueError, match="ad_group_id"):
        columns.require_columns(df, ["ad_group_id"])


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, "x", None)], "a int, b string, c double")
    kept, missing = columns.keep_present(df, ["b", "z"])
    assert kept.columns == ["b"] and missing == ["z"]
    assert columns.reorder(df, ["c"], ["a"]).columns == ["c", "b"]
    assert columns.complete_rows(df, ["c"]).count() == 0
    assert columns.fill_to_features(df, ["c", "n", "a"]).first().asDict() == {"c": None, "n": 0.0, "a": 1.0}
    # Nulls and neighbours do not blur row identity.
    keys = spark.createDataFrame([("a|b", None), ("a", "b"), (None, "a|b")], "x string, y string").select(columns.row_key(["x", "y"]))
    assert keys.distinct().count() == 3


def test_dedupe(spark):
    rows = [("k", None, 3), ("k", None, 1), ("k", 2.0, 9), (None, None, 5), (None, None, 4)]
    df = spark.createDataFrame(rows, "id string, v double, o int")
    out = dedupe.first_per_key(df, ["id", "v"])
    assert {tuple(r) for r in out.collect()} == {("k", None, 1), ("k", 2.0, 9), (None, None, 4)}
    assert dedupe.first_per_key(out, ["id", "v"]).count() == 3
    twice = df.unionByName(df)
    assert dedupe.distinct_rows(twice).count() == 5
    assert tuple(dedupe.dedupe_report(twice, df.columns).first()) == (10, 5, 5, 0.5)
    assert tuple(dedupe.dedupe_report(df.limit(0), df.columns).first()) == (0, 0, 0, None)


def test_first_per_key_limits_before_the_shuffle(spark):
    plan = dedupe.first_per_key(spark.range(10).selectExpr("id % 2 AS k", "id AS v"), ["k"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


MAPPING = [("shop", "retail"), ("home", "estate")]


def ad(campaign_id, ad_group, profile, cost, start=date(2025, 1, 1), end=date(2025, 1, 11)):
    return (campaign_id, ad_group, profile, cost, start, end)


AD_SCHEMA = "campaign_id string, ad_group_id string, profile string, cost double, campaign_start date, campaign_end date"


def test_rollup_rules(spark):
    rows = [
        ad("a", "1", "The  Shop", 1.0), ad("a", "1", "the shop", 2.0), ad("a", None, "home", 4.0), ad("a", "2", None, None),
        ad("b", "1", "Home x", None), ad("b", "2", "A Shop", None, None, None),
        ad("c", "1", None, 1.0, date(2025, 2, 1), date(2025, 1, 1)), ad(None, "1", "shop", 3.0),
    ]
    out = {r["campaign_id"]: r for r in rollup.campaign_rollup(spark.createDataFrame(rows, AD_SCHEMA), MAPPING).collect()}
    a, b, c, none = out["a"], out["b"], out["c"], out[None]
    assert (a["num_ads"], a["cost"], a["campaign_duration"]) == (3, 7.0, 10)  # a null ad group counts
    assert (a["business_type"], a["btype_confidence"]) == ("retail", 0.5)
    assert (b["cost"], b["business_type"], b["btype_confidence"]) == (0.0, "retail", 0.5)  # tie: smallest name
    assert (c["business_type"], c["btype_confidence"], c["campaign_duration"]) == ("unknown", 1.0, 0)
    # A missing id matches nothing, so it has no type.
    assert (none["business_type"], none["btype_confidence"], none["num_ads"]) == ("unknown", 0.0, 1)


def test_rollup_without_dates_or_profile(spark):
    df = spark.createDataFrame([("a", "1", 2.0)], "campaign_id string, ad_group_id string, cost double")
    assert rollup.campaign_rollup(df, MAPPING).first().asDict() == {
        "campaign_id": "a", "campaign_duration": 0, "num_ads": 1, "cost": 2.0, "business_type": "unknown", "btype_confidence": 0.0}
    assert "campaign_id" not in rollup.campaign_rollup(df, MAPPING, keep_id=False).columns


def test_text_dates(spark):
    df = spark.createDataFrame([("a", "1", "2025-01-01", "2025-01-05 23:00:00")], "campaign_id string, adset_id string, campaign_start string, campaign_end string")
    assert campaign.campaign_table(df, []).first()["campaign_duration"] == 4


def test_distinct_count_is_spread_by_ad_group(spark):
    """A campaign with most rows must not be counted by one task."""
    df = spark.createDataFrame([ad("a", "1", "x", 1.0)], AD_SCHEMA)
    plan = rollup.campaign_metrics(df)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(campaign_id" in plan and "ad_group_id" in plan.split("hashpartitioning(campaign_id")[1][:40] or plan.count("Exchange hashpartitioning") == 2


def test_feature_table_has_no_shuffle(spark):
    raw = spark.createDataFrame([], "cost string, impressions string, clicks string, actions string, conversion_value string, profile string, "
                                    "campaign_start_date date, ad_group_start_date date")
    out = features.ad_features(raw, MAPPING)
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    assert len(out.columns) == 92 + 4  # no objective, call to action, device or reach given
    with pytest.raises(ValueError, match="clicks"):
        features.ad_features(raw.drop("clicks"), MAPPING)


def test_labels_by_distinct_name(spark):
    from adlumen.functions.classify import classify
    from adlumen.operators.joins import label_distinct

    df = spark.createDataFrame([(i, n) for i, n in enumerate(["my shop", "home", None, "shopping", "my shop"])], "i int, p string")
    want = {tuple(r) for r in df.select("i", classify(F.col("p"), MAPPING).alias("t")).collect()}
    for bound in (100, 2):
        got = label_distinct(df, F.col("p"), MAPPING, "t", max_names=bound)
        assert {(r["i"], r["t"]) for r in got.collect()} == want
        assert "SortMergeJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_masks(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    first = spark.createDataFrame([(1, True), (2, False)], "id int, is_outlier_gw boolean")
    second = spark.createDataFrame([(2, True)], "id int, is_outlier_global boolean")
    out = {r["id"]: r["is_outlier_combined"] for r in masks.combine_masks(ids, first, second, "id").collect()}
    assert out == {1: True, 2: True, 3: False}


def test_profile_tables(spark):
    df = spark.createDataFrame([(1.0, "a"), (None, "b"), (3.0, "a"), (11.0, None)], "x double, s string")
    assert {r["column"]: r["nulls"] for r in profile.null_counts(df).collect()} == {"x": 1, "s": 1}
    assert [tuple(r) for r in profile.category_distribution(df, "s").collect()] == [("a", 2), ("b", 1), (None, 1)]
    bins = {r["bin"]: r["n"] for r in profile.histogram(df, ["x"], 10).collect()}
    assert bins == {0: 1, 2: 1, 9: 1}
    constant = profile.histogram(spark.createDataFrame([(2.0,), (2.0,)], "x double"), ["x"], 5).collect()
    assert [(r["bin"], r["n"]) for r in constant] == [(2, 2)]
    p = profile.table_profile(df).first()
    assert (p["n_rows"], p["n_columns"]) == (4, 2) and p["estimated_mb"] > 0


def test_metrics_edges(spark):
    rows = [("a", 0.0, 0.0), ("a", 0.0, 0.0), ("b", 5.0, 4.0), (None, 1.0, 2.0), (None, 3.0, 3.0)]
    df = spark.createDataFrame(rows, "business_type string, t_true double, t_pred double")
    out = {r["group"]: r for r in metrics.metrics_by_segment(df, ["t"]).collect()}
    assert set(out) == {"ALL", "bt=a", "bt=b", "bt=None"}
    assert (out["bt=a"]["r2"], out["bt=a"]["wape"], out["bt=a"]["smape"]) == (1.0, None, 0.0)
    assert out["bt=b"]["r2"] is None and out["bt=None"]["r2"] == pytest.approx(0.5)
    assert out["ALL"]["n"] == 5 and out["ALL"]["mae"] == pytest.approx(0.4)


def test_report_tables(spark):
    def row(t, m, k, r2):
        return (t, m, k, "val", "log", 0.1, 0.1, r2, 0.1, 0.1)

    rows = [row("x", "ridge", "individual", 0.5), row("x", "gbt", "individual", 0.5), row("x", "ensemble_voting", "ensemble", 0.6),
            row("y", "ridge", "individual", 0.0), row("y", "ensemble_voting", "ensemble", 0.3), row("z", "ridge", "individual", 0.2)]
    df = spark.createDataFrame(rows, reports.METRICS_SCHEMA)
    delta = {r["target"]: r for r in reports.ensemble_delta(df).collect()}
    assert set(delta) == {"x", "y"} and delta["y"]["improvement_pct"] == 0.0
    assert delta["x"]["improvement_pct"] == pytest.approx(20.0) and delta["x"]["best_individual_name"] == "gbt"
    assert [tuple(r) for r in reports.winner_counts(df).collect()] == [("ensemble_voting", 2), ("ridge", 1)]
    assert reports.best_summary(df).first()["test_r2"] is None
    info = reports.feature_info(spark, names.FEATURES, names.LOG_TARGETS, ["voting"]).first()
    assert (info["total_features"], info["total_targets"]) == (95, 5)
