"""Registration of queries and of the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType

from adlumen.sources.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, digits: int | None = 6):
    """Register a function under its name.

    Engines differ in the last bits of doubles, so results are rounded here;
    the SQL rounds the same columns.
    """

    def register(fn):
        @wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = fn(tune(spark), sf_dir)
            return out if digits is None else rounded(out, digits)

        QUERIES[fn.__name__] = run
        if sql:
            SQL[fn.__name__] = sql
        return run

    return register


def rounded_column(c: Column, digits: int) -> Column:
    """``round``, which takes a decimal by way of text for each number, only where a number is close to a tie or huge.

    Elsewhere the nearest whole number of units, divided by whole units, is the same double.
    """
    scaled = c * F.lit(10.0**digits)
    clear = (F.abs(scaled) < 1e12) & (F.abs(scaled - F.floor(scaled) - 0.5) > 1e-3)
    # Adding 0 makes -0 a 0.
    return F.when(clear, F.rint(scaled) / F.lit(10.0**digits) + F.lit(0.0)).otherwise(F.round(c, digits))


def rounded(df: DataFrame, digits: int) -> DataFrame:
    return df.select(
        *[
            rounded_column(F.col(f"`{f.name}`").cast("double"), digits).alias(f.name)
            if isinstance(f.dataType, (DoubleType, FloatType)) else F.col(f"`{f.name}`")
            for f in df.schema
        ]
    )


# ------------------------------------------------------------- shared SQL text
ADS = """
ads AS (
  SELECT c_nationkey || '-' || year(o_orderdate) AS campaign_id,
         CAST(l_orderkey AS VARCHAR) AS ad_group_id,
         c_mktsegment || '  ' || c_name AS profile,
         o_orderpriority AS campaign_objective,
         l_returnflag || '_' || l_linestatus AS creative_call_to_action_type,
         p_type AS impression_device,
         CAST(o_orderdate AS DATE) AS campaign_start_date,
         CAST(o_orderdate AS DATE) + 30 AS campaign_end_date,
         CAST(o_orderdate AS DATE) + l_linenumber AS ad_group_start_date,
         CAST(o_orderdate AS DATE) + l_linenumber + (CAST(l_quantity AS INTEGER) - 10) AS ad_group_end_date,
         l_extendedprice * l_discount AS cost,
         l_quantity * 1000 AS impressions,
         CAST(floor(l_quantity * 700) AS DOUBLE) AS reach,
         CAST(floor(l_quantity * l_discount * 100) AS DOUBLE) AS clicks,
         CAST(floor(l_quantity * l_tax * 20) AS DOUBLE) AS actions,
         CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0.0 END AS conversion_value,
         strftime(CAST(o_orderdate AS DATE), '%Y%m%d') AS dt,
         l_linenumber AS line_number,
         md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_quantity AS INTEGER),
             CAST(round(l_extendedprice * 100) AS BIGINT), CAST(round(l_discount * 100) AS BIGINT),
             CAST(round(l_tax * 100) AS BIGINT), l_returnflag, l_linestatus, strftime(l_shipdate, '%Y%m%d'))) AS row_key
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey
)"""

COPIES = ADS + """,
ads_copies AS (SELECT * FROM ads UNION ALL SELECT * FROM ads WHERE line_number = 1)"""


def segment_type(text: str) -> str:
    """SQL of the segment mapping in word mode."""
    return (
        f"CASE WHEN regexp_matches({text}, '\\bfurniture\\b') THEN 'retail_brand' "
        f"WHEN regexp_matches({text}, '\\bbuilding\\b') THEN 'real_estate' "
        f"WHEN regexp_matches({text}, '\\bmachinery\\b') THEN 'industrial_manufacturing' "
        f"WHEN regexp_matches({text}, '\\bhousehold\\b') THEN 'other' ELSE 'unknown' END"
    )


SQUEEZED = "regexp_replace(lower(profile), '\\s+', ' ', 'g')"
TYPE = segment_type(SQUEEZED)

TYPED = ADS + f""",
typed AS (SELECT *, {TYPE} AS business_type FROM ads)"""

DISTINCT = COPIES + """,
distinct_ads AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (
      PARTITION BY campaign_id, ad_group_id, ad_group_start_date, ad_group_end_date, impressions, reach, clicks,
                   actions, conversion_value, cost
      ORDER BY campaign_start_date, campaign_end_date, profile) AS rn
    FROM ads_copies) WHERE rn = 1
)"""

ROLLUP = DISTINCT + f""",
counts AS (SELECT campaign_id, {SQUEEZED} AS profile_norm, count(*) AS n FROM distinct_ads GROUP BY ALL),
top AS (SELECT campaign_id, profile_norm FROM (
  SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY n DESC, profile_norm) AS r FROM counts) WHERE r = 1),
camp_type AS (SELECT campaign_id, {segment_type('profile_norm')} AS business_type FROM top),
confidence AS (
  SELECT c.campaign_id, t.business_type,
         sum(CASE WHEN {segment_type('c.profile_norm')} = t.business_type THEN c.n ELSE 0 END) / sum(c.n) AS btype_confidence
  FROM counts c JOIN camp_type t ON c.campaign_id = t.campaign_id GROUP BY c.campaign_id, t.business_type),
campaigns AS (
  SELECT d.campaign_id,
         CAST(greatest(max(campaign_end_date) - min(campaign_start_date), 0) AS BIGINT) AS campaign_duration,
         count(DISTINCT ad_group_id) AS num_ads, sum(cost) AS cost, sum(impressions) AS impressions, sum(reach) AS reach,
         sum(clicks) AS clicks, sum(actions) AS actions, sum(conversion_value) AS conversion_value,
         any_value(c.business_type) AS business_type, any_value(c.btype_confidence) AS btype_confidence
  FROM distinct_ads d JOIN confidence c ON d.campaign_id = c.campaign_id GROUP BY d.campaign_id)"""
