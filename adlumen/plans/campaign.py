"""Campaign-level job: ad rows to campaign table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from adlumen import names
from adlumen.functions import classify as kw
from adlumen.operators import columns, dedupe, rollup


def canonical_rows(raw: DataFrame) -> DataFrame:
    """Known columns under canonical names; the two ids are required."""
    renamed = columns.rename_by_alias(raw)
    columns.require_columns(renamed, ["campaign_id", "ad_group_id"])
    kept, _ = columns.keep_present(renamed, list(names.COLUMN_ALIASES))
    return columns.clean_numbers(kept, names.METRICS)


def distinct_ad_rows(raw: DataFrame) -> DataFrame:
    return dedupe.first_per_key(canonical_rows(raw), names.DEDUPE_KEY)


def campaign_table(raw: DataFrame, mapping: kw.Mapping, keep_id: bool = True) -> DataFrame:
    """Rename, dedupe and roll up."""
    return rollup.campaign_rollup(distinct_ad_rows(raw), mapping, keep_id)
