"""Both jobs from raw rows to saved models, with small settings."""

import os

import pytest
from pyspark.sql import functions as F

from adlumen import names
from adlumen.operators import models, scale
from adlumen.operators.boosting import TreeSettings
from adlumen.operators.linear import Penalty
from adlumen.plans import ads, jobs, training
from adlumen.sources import artifacts
from adlumen.sources.adapters import SEGMENT_MAPPING, ad_rows, ad_rows_with_copies
from adlumen.sources.stages import StageStore

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_ads_job(spark, tmp_path, monkeypatch):
    raw = ad_rows(spark, SF).filter("line_number <= 2")
    small = {"ridge": Penalty(l2_sum=1.0), "boosted_depth": TreeSettings(rounds=3, depth=2, step=0.5)}
    options = {"clean": {"fit_rows": 500, "n_trees": 10}, "settings": small}
    run = jobs.ads_job(StageStore(spark, str(tmp_path)), raw.unionByName(raw), SEGMENT_MAPPING, **options)
    assert set(run.fitted) == {t.removesuffix("_log1p") for t in names.LOG_TARGETS}
    assert run.rows.select(jobs.KEY).distinct().count() == run.rows.count()
    assert run.errors.filter("split = 'test' and scale = 'log' and model = 'ridge'").count() == 5
    # Run again, everything is read: no model is fitted.
    monkeypatch.setattr(training, "train_all", None)
    again = jobs.ads_job(StageStore(spark, str(tmp_path)), raw.unionByName(raw), SEGMENT_MAPPING, **options)
    rows = models.assemble(run.rows, run.features)
    first, second = (training.predict_targets(rows, {f"p_{t}": f for t, f in r.fitted.items()}).agg(*[F.sum(f"p_{t}") for t in run.fitted]).first() for r in (run, again))
    assert first == second and again.errors.count() == run.errors.count()


def test_campaign_job(spark, tmp_path):
    settings = TreeSettings(rounds=6, depth=2, step=0.5, patience=3, row_share=0.9)
    run = jobs.campaign_job(ad_rows_with_copies(spark, SF), SEGMENT_MAPPING, str(tmp_path), min_group=30, n_trees=20, settings=settings)
    summary = {r["business_type"]: r for r in run.group_summary.collect()}
    assert sum(r["size"] for r in summary.values()) >= run.predicted.count() > 100
    assert {r["note"] for r in summary.values()} <= {"", "skipped_too_small"}
    assert {(r["split"], r["scale"]) for r in run.errors.collect()} == {(s, k) for s in ("val", "test") for k in ("log", "orig")}
    loaded = artifacts.load_campaign_models(spark, str(tmp_path))
    again = training.campaign_predictions(run.predicted.drop(*[f"{t}_{k}" for t in loaded for k in ("pred", "log", "true")]), run.features, loaded)
    same = again.select("campaign_id", F.col("clicks_pred").alias("a")).join(run.predicted.select("campaign_id", "clicks_pred"), "campaign_id")
    assert same.count() == run.predicted.count() and same.filter("a != clicks_pred").count() == 0


def test_no_numeric_feature(spark):
    """Without a number no forest is grown: nothing is an outlier, and the summary says why."""
    df = spark.createDataFrame([(str(i), "ab"[i % 2]) for i in range(20)], "k string, business_type string")
    mask, kept = ads.two_pass_outliers(df, "k", min_group=5)
    assert kept.count() == 20 and mask.filter("is_outlier_combined").count() == 0
    assert {r["note"] for r in ads.two_pass_summary(mask, df, 5).collect()} == {"no_numeric_features"} and scale.outlier_columns(df) == []
