"""Ads-level cleaning job: features, dedupe, outliers, one-hot, scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from adlumen import names
from adlumen.functions import classify as kw
from adlumen.operators import columns, dedupe, encode, masks, outlier, scale, split
from adlumen.plans.features import ad_features
from adlumen.sources.session import checkpointed
from adlumen.sources.stages import StageStore

def remove_outliers(df: DataFrame, contamination: float = 0.1, fit_rows: int | None = None, n_trees: int = 100, seed: int = 42) -> DataFrame:
    """Drop that share of all rows, by a forest whose trees draw from all of them.

    With ``fit_rows`` forest and cut come from a hash sample of that size.
    """
    features = scale.numeric_columns(df, exclude=names.LOG_TARGETS)
    keyed = df.withColumn("_key", columns.row_key(df.columns))
    if fit_rows is None:
        flagged = outlier.forest_outliers(keyed, features, "_key", (), contamination, n_trees, seed=seed)
    else:
        # Read twice: to grow the trees and to place the cut.
        sample = checkpointed(split.exact_sample(keyed, fit_rows, "_key", seed))
        flagged = outlier.sample_fitted_outliers(keyed, sample, features, "_key", contamination, n_trees, seed=seed)
    return masks.inliers(flagged).select(*df.columns)


def clean_ads(
    store: StageStore, raw: DataFrame, mapping: kw.Mapping, contamination: float = 0.05, fit_rows: int | None = None, n_trees: int = 100
) -> DataFrame:
    """Run the stages, reusing those that are complete.

    Leaves the tables ``ohe_vocab`` and ``scaler_params`` in the store.
    """
    spark = store.spark
    features = store.run("features", lambda: ad_features(raw, mapping), mapping=mapping)
    distinct = store.run("distinct", lambda: dedupe.distinct_rows(features))
    inliers = store.run(
        "inliers", lambda: remove_outliers(distinct, contamination, fit_rows, n_trees), contamination=contamination, fit_rows=fit_rows, n_trees=n_trees
    )
    vocabulary = learned_vocabulary(store, inliers)
    encoded = store.run("encoded", lambda: encode.one_hot(inliers, vocabulary))
    flags = [f"{c}_{v}" for c, vs in vocabulary.items() for v in vs]
    numeric = scale.numeric_columns(encoded, exclude=names.LOG_TARGETS + flags)
    params = f"{store.root}/scaler_params"
    if store.force or store.changed or not store.done("scaler_params"):
        fitted = scale.fit_standard(encoded, numeric)
        scale.moments_table(spark, fitted).write.mode("overwrite").parquet(params)
    return store.run("scaled", lambda: scale.apply_standard(encoded, scale.moments_from_table(spark.read.parquet(params))))


def learned_vocabulary(store: StageStore, df: DataFrame) -> encode.Vocabulary:
    path = f"{store.root}/ohe_vocab"
    if store.force or store.changed or not store.done("ohe_vocab"):
        vocabulary, _ = encode.learn_vocabulary(df, names.CATEGORICALS)
        encode.vocabulary_table(store.spark, vocabulary).write.mode("overwrite").parquet(path)
    return encode.vocabulary_from_table(store.spark.read.parquet(path))


def two_pass_outliers(
    df: DataFrame, key: str, contamination: float | str = "auto", min_group: int = 150, n_trees: int = 400, seed: int = 42
) -> tuple[DataFrame, DataFrame]:
    """Campaign-level outliers: per business type, then over what remains.

    Returns the combined mask and the rows that pass both.
    """
    group = "business_type"
    first = _forest_mask(df, key, [group], "gw", contamination, n_trees, min_group, seed)
    rest = df.join(first.filter("is_outlier_gw").select(key), key, "left_anti")
    second = _forest_mask(rest, key, [], "global", contamination, n_trees, min_group, seed)
    mask = masks.combine_masks(df.select(key, group), first, second, key).join(df.select(key, group), key)
    kept = df.join(mask.filter("is_outlier_combined").select(key), key, "left_anti")
    return mask, kept


def _forest_mask(
    df: DataFrame, key: str, by: list[str], name: str, contamination: float | str, n_trees: int, min_group: int, seed: int
) -> DataFrame:
    """One pass: ``is_outlier_{name}`` and ``anomaly_score_{name}`` by key; without numeric features nothing is an outlier."""
    matrix, features = scale.feature_matrix(df, by=by, keep=[key])
    if not features:
        return df.select(key, F.lit(False).alias(f"is_outlier_{name}"), F.lit(None).cast("double").alias(f"anomaly_score_{name}"))
    size = {"min_group": min_group} if by else {}
    found = outlier.forest_outliers(
        matrix, features, key, by, contamination, n_trees, seed=seed, flag=f"is_outlier_{name}", score=f"anomaly_score_{name}", **size
    )
    return checkpointed(found.select(key, f"is_outlier_{name}", f"anomaly_score_{name}"))


def two_pass_summary(mask: DataFrame, df: DataFrame, min_group: int = 150) -> DataFrame:
    """Size, outliers and note of every business type in the first pass over ``df``."""
    return masks.group_summary(mask, "business_type", "is_outlier_gw", min_group, numeric=bool(scale.outlier_columns(df)))
