"""How often whole tables are computed, and how wide line items travel."""

import pytest
from pyspark.sql import functions as F

from adlumen.operators import dedupe, encode, scale, split
from adlumen.sources.adapters import ad_rows, ad_rows_with_copies

STEPS = {
    "take_share": lambda df: split.take_share(df, "k", 0.1, ["g"], "taken"),
    "safe_strata": lambda df: split.safe_strata(df, "k", "g")[0],
    "cost_bins": lambda df: split.cost_bins(df, "k").select("cost_bin", "g"),
    "stratified_split": lambda df: split.stratified_split(df, "k", "g"),
    "median_impute": lambda df: scale.median_impute(df, ["cost"], ["g"]),
    "robust_scale": lambda df: scale.robust_scale(df, ["cost"], ["g"]),
    "feature_matrix": lambda df: scale.feature_matrix(df, ["cost"], [], ["g"], ["k"])[0],
    "dummies": lambda df: encode.dummies(df, "g", "g_"),
}


@pytest.mark.parametrize("step", STEPS)
def test_input_is_computed_once(spark, step):
    met = spark.sparkContext.accumulator(0)

    def group(k):
        met.add(1)
        return f"g{k % 3}"

    rows = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 97).cast("double").alias("cost"))
    out = STEPS[step](rows.withColumn("g", F.udf(group)("k")))
    assert len(out.collect()) == 300
    assert met.value == 300


def test_line_key_is_made_before_the_joins(spark):
    rows = ad_rows(spark, "/root/testdata/sf0.001").select("row_key", "profile")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    joins = [i for i, line in enumerate(plan.splitlines()) if "Join Inner" in line]
    made = [i for i, line in enumerate(plan.splitlines()) if "unhex(md5" in line]
    assert len(joins) == 3 and made and min(made) > min(joins)
    assert all(len(r["row_key"]) == 32 for r in rows.limit(5).collect())


def test_distinct_rows_need_no_shuffle_after_the_join(spark):
    def deals(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    rows = ad_rows_with_copies(spark, "/root/testdata/sf0.001")
    assert deals(dedupe.distinct_rows(rows)) == deals(rows)
    assert dedupe.distinct_rows(rows).count() < rows.count()
