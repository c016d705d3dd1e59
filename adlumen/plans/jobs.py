"""Both jobs end to end, from raw ad rows to fitted models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from adlumen import names
from adlumen.functions import classify as kw
from adlumen.operators import columns, models, scale, split
from adlumen.plans import ads, campaign, training
from adlumen.sources import artifacts
from adlumen.sources.session import checkpointed
from adlumen.sources.stages import StageStore

KEY = "_row"


@dataclass
class CampaignRun:
    """What a campaign job leaves: outliers per business type, predictions of all split rows, models and their errors."""

    group_summary: DataFrame
    predicted: DataFrame
    features: list[str]
    fitted: dict[str, models.LogTrees]
    errors: DataFrame


def campaign_job(
    raw: DataFrame, mapping: kw.Mapping, model_root: str | None = None, min_group: int = 150, n_trees: int = 400, settings: models.TreeSettings = models.CAMPAIGN_TREES,
    targets: list[str] = names.CAMPAIGN_TARGETS, seed: int = 42,
) -> CampaignRun:
    """Roll up, remove outliers per type and overall, split by strata, fit log trees, judge them, and save them under ``model_root``.

    A type under ``min_group`` rows passes the first forest as it is.
    """
    table = checkpointed(campaign.campaign_table(raw, mapping))
    mask, kept = ads.two_pass_outliers(table, "campaign_id", min_group=min_group, n_trees=n_trees, seed=seed)
    summary = ads.two_pass_summary(mask, table, min_group)
    rows = checkpointed(split.stratified_split(checkpointed(kept), "campaign_id", seed=seed))
    wide, features = training.campaign_features(rows)
    wide = checkpointed(columns.complete_rows(wide, features))
    fitted = training.train_campaign(wide, features, targets=targets, settings=settings)
    predicted = checkpointed(training.campaign_predictions(wide, features, fitted))
    if model_root:
        artifacts.save_campaign_models(raw.sparkSession, model_root, fitted, features)
    return CampaignRun(summary, predicted, features, fitted, training.campaign_metrics(predicted, fitted))


@dataclass
class AdsRun:
    """What an ads job leaves: the cleaned table, its inputs, models and their errors."""

    rows: DataFrame
    features: list[str]
    fitted: dict[str, training.TargetModels]
    errors: DataFrame


def ads_job(store: StageStore, raw: DataFrame, mapping: kw.Mapping, seed: int = 42, clean: dict | None = None, **training_options) -> AdsRun:
    """Clean the ad rows, split them by a key of their own, fit every target and save the models in the store.

    A target whose models are saved already, from the same cleaned table, is not fitted again.
    """
    cleaned = ads.clean_ads(store, raw, mapping, **(clean or {}))
    labels = [t for t in names.LOG_TARGETS if t in cleaned.columns]
    features = [c for c in scale.numeric_columns(cleaned, exclude=labels)]
    # After the distinct stage no two rows are equal, so a digest of all columns is a key.
    rows = store.run("keyed", lambda: split.hash_split(cleaned.withColumn(KEY, columns.row_key(cleaned.columns)), KEY, seed=seed), seed=seed)
    root, spark = f"{store.root}/fits", store.spark
    done: dict[str, training.TargetModels] = {}
    for t in labels:
        if not (store.force or store.changed) and artifacts.has_version(spark, f"{root}/{t}/models"):
            done |= artifacts.load_models(spark, f"{root}/{t}")
    todo = [t for t in labels if t.removesuffix("_log1p") not in done]
    if todo:
        for name, f in training.train_all(rows, features, KEY, todo, seed=seed, **training_options).items():
            artifacts.save_models(spark, f"{root}/{name}_log1p", {name: f})
            done[name] = f
    done = {t.removesuffix("_log1p"): done[t.removesuffix("_log1p")] for t in labels}
    return AdsRun(rows, features, done, training.model_metrics(done, rows))
