"""Roll-up of ad rows to campaigns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DateType, TimestampNTZType, TimestampType

from adlumen import names
from adlumen.functions import classify as kw
from adlumen.functions.dates import duration_from_dates, duration_from_text
from adlumen.functions.text import squeeze
from adlumen.operators.dictionary import classify_names

KEY = "campaign_id"


def campaign_metrics(rows: DataFrame) -> DataFrame:
    """Number of ad groups, metric sums and outer dates per campaign.

    A null ad group counts as one more value and the sum of nulls is 0.  The
    distinct count is planned by (campaign, ad group) first, so a campaign
    that holds much of the table is spread over all tasks.
    """
    null_group = F.max(F.when(F.col("ad_group_id").isNull(), 1).otherwise(0))
    aggs = [(F.count_distinct("ad_group_id") + null_group).cast("bigint").alias("num_ads")]
    aggs += [F.coalesce(F.sum(m), F.lit(0.0)).alias(m) for m in names.METRICS if m in rows.columns]
    if "campaign_start" in rows.columns:
        aggs.append(F.min("campaign_start").alias("campaign_start"))
    if "campaign_end" in rows.columns:
        aggs.append(F.max("campaign_end").alias("campaign_end"))
    return rows.groupBy(KEY).agg(*aggs)


def profile_counts(rows: DataFrame) -> DataFrame:
    """Rows per campaign and normalised account name."""
    return rows.groupBy(KEY, squeeze(F.col("profile")).alias("profile_norm")).agg(F.count("*").alias("n_rows"))


def campaign_profile(counts: DataFrame) -> DataFrame:
    """Most frequent account name per campaign, ties to the smallest name."""
    window = Window.partitionBy(KEY).orderBy(F.desc("n_rows"), F.asc_nulls_last("profile_norm"))
    ranked = counts.filter(F.col(KEY).isNotNull()).withColumn("_rank", F.row_number().over(window))
    return ranked.filter("_rank = 1").drop("_rank")


def campaign_type(counts: DataFrame, mapping: kw.Mapping) -> DataFrame:
    """Business type of each campaign and the share of its rows that agree.

    The type is that of the most frequent account name.  Names are classified
    once each after counting, and types are folded into a small map per
    campaign, which is bounded by the labels of the mapping.
    """
    known = counts.filter(F.col(KEY).isNotNull())
    if isinstance(mapping, DataFrame):
        typed = classify_names(known, F.col("profile_norm"), mapping, "business_type")
    else:
        typed = known.withColumn("business_type", kw.classify(F.col("profile_norm"), mapping))
    # Most rows first, then the smallest name; a missing name comes last.
    rank = F.struct(-F.col("n_rows"), F.col("profile_norm").isNull(), F.col("profile_norm"))
    per_type = typed.groupBy(KEY, "business_type").agg(F.sum("n_rows").alias("n_rows"), F.min(rank).alias("best"))
    types = F.map_from_entries(F.collect_list(F.struct("business_type", "n_rows")))
    return (
        per_type.groupBy(KEY)
        .agg(
            F.min_by("business_type", "best").alias("business_type"),
            types.alias("_types"),
            F.sum("n_rows").alias("_total"),
        )
        .select(
            KEY,
            "business_type",
            (F.col("_types")[F.col("business_type")] / F.col("_total")).alias("btype_confidence"),
        )
    )


def type_confidence(rows: DataFrame, mapping: kw.Mapping) -> DataFrame:
    return campaign_type(profile_counts(rows), mapping)


def with_duration(df: DataFrame) -> DataFrame:
    """``campaign_duration`` from the outer dates, by the type they have."""
    if not {"campaign_start", "campaign_end"} <= set(df.columns):
        return df.withColumn("campaign_duration", F.lit(0).cast("bigint"))
    dated = (DateType, TimestampType, TimestampNTZType)
    rule = duration_from_dates
    if not all(isinstance(df.schema[c].dataType, dated) for c in ("campaign_start", "campaign_end")):
        rule = duration_from_text
    return df.withColumn("campaign_duration", rule(F.col("campaign_end"), F.col("campaign_start")))


def campaign_rollup(rows: DataFrame, mapping: kw.Mapping, keep_id: bool = True) -> DataFrame:
    """The campaign table: one row per campaign.

    ``rows`` carry canonical names and no duplicates.
    """
    out = with_duration(campaign_metrics(rows)).drop("campaign_start", "campaign_end")
    if "profile" in rows.columns and (isinstance(mapping, DataFrame) or mapping):
        out = out.join(type_confidence(rows, mapping), KEY, "left")
    else:
        out = out.withColumns({"business_type": F.lit(None).cast("string"), "btype_confidence": F.lit(None).cast("double")})
    out = out.withColumns(
        {
            "business_type": F.coalesce("business_type", F.lit("unknown")),
            "btype_confidence": F.coalesce("btype_confidence", F.lit(0.0)),
        }
    )
    order = ([KEY] if keep_id else []) + names.CAMPAIGN_COLUMNS
    return out.select(*[c for c in order if c in out.columns])
