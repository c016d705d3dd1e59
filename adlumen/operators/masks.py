"""Outlier masks and their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def inliers(df: DataFrame, flag: str = "is_outlier") -> DataFrame:
    return df.filter(~F.coalesce(F.col(flag), F.lit(False)))


def combine_masks(
    ids: DataFrame, first: DataFrame, second: DataFrame, key: str,
    first_flag: str = "is_outlier_gw", second_flag: str = "is_outlier_global",
) -> DataFrame:
    """Both masks per row and their union; a row absent from a mask is no outlier."""
    out = ids.select(key).join(first, key, "left").join(second, key, "left")
    either = F.coalesce(F.col(first_flag), F.lit(False)) | F.coalesce(F.col(second_flag), F.lit(False))
    return out.withColumn("is_outlier_combined", either)


def group_summary(
    df: DataFrame, group: str = "business_type", flag: str = "is_outlier", min_group: int = 150, numeric: bool = True
) -> DataFrame:
    """Size, outliers and their share per group, largest group first.

    A group that no forest looked at has a note: it is too small, or there was no numeric feature.
    """
    out = df.groupBy(group).agg(
        F.count("*").alias("size"),
        F.count_if(F.col(flag)).alias("outliers"),
        (F.avg(F.col(flag).cast("int")) * 100).alias("pct"),
    )
    small = F.col("size") < min_group
    passed = small if numeric else F.lit(True)
    return out.select(
        group, "size",
        F.when(passed, 0).otherwise(F.col("outliers")).cast("bigint").alias("outliers"),
        F.when(passed, 0.0).otherwise(F.col("pct")).alias("pct"),
        F.when(small, "skipped_too_small").otherwise("" if numeric else "no_numeric_features").alias("note"),
    ).orderBy(F.desc("size"), F.asc_nulls_last(group))
