"""Ad rows from the order tables the tests and the bench read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from adlumen.sources.session import small_side, spread

# Keyword mapping for the market segments of the order tables.
SEGMENT_MAPPING = [
    ("furniture", "retail_brand"),
    ("building", "real_estate"),
    ("machinery", "industrial_manufacturing"),
    ("household", "other"),
]

def line_key():
    """Identity of a line item by all its columns, as it has no unique key."""
    cents = [F.round(F.col(c) * 100).cast("bigint") for c in ("l_extendedprice", "l_discount", "l_tax")]
    return F.md5(
        F.concat_ws(
            "|", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), *cents,
            "l_returnflag", "l_linestatus", F.date_format("l_shipdate", "yyyyMMdd"),
        )
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ad row per line item.

    Line items are by far the most rows and are dealt anew for the parts and for the orders.  What follows from a line
    alone is worked out before, and its key travels as bytes; orders and customers meet first, away from the lines.  Lines meet
    their order by ``ad_group_id``, so rows that are next grouped by all columns, or by some with it, lie together already.
    """
    c, qty = F.col, F.col("l_quantity")
    line = spread(table(spark, sf_dir, "lineitem"), "l_orderkey").select(
        c("l_orderkey").cast("string").alias("ad_group_id"), "l_partkey", "l_linenumber", "l_quantity",
        F.concat_ws("_", c("l_returnflag"), c("l_linestatus")).alias("creative_call_to_action_type"),
        (c("l_extendedprice") * c("l_discount")).alias("cost"),
        F.floor(qty * c("l_discount") * 100).cast("double").alias("clicks"),
        F.floor(qty * c("l_tax") * 20).cast("double").alias("actions"),
        F.when(c("l_returnflag") == "R", c("l_extendedprice")).otherwise(0.0).alias("conversion_value"),
        F.unhex(line_key()).alias("_line"),
    )
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    bought = orders.join(small_side(customer), c("o_custkey") == c("c_custkey")).withColumn("_group", c("o_orderkey").cast("string")).hint("merge")
    joined = line.join(small_side(part), c("l_partkey") == c("p_partkey")).join(bought, c("ad_group_id") == c("_group"))
    day = c("o_orderdate").cast("date")
    adg_start = F.date_add(day, c("l_linenumber"))
    return joined.select(
        F.concat_ws("-", c("c_nationkey"), F.year(day)).alias("campaign_id"),
        "ad_group_id",
        F.concat(c("c_mktsegment"), F.lit("  "), c("c_name")).alias("profile"),
        c("o_orderpriority").alias("campaign_objective"),
        "creative_call_to_action_type",
        c("p_type").alias("impression_device"),
        day.alias("campaign_start_date"),
        F.date_add(day, 30).alias("campaign_end_date"),
        adg_start.alias("ad_group_start_date"),
        F.date_add(adg_start, qty.cast("int") - 10).alias("ad_group_end_date"),
        "cost",
        (qty * 1000).alias("impressions"),
        F.floor(qty * 700).cast("double").alias("reach"),
        "clicks", "actions", "conversion_value",
        F.date_format(day, "yyyyMMdd").alias("dt"),
        c("l_linenumber").alias("line_number"),
        F.lower(F.hex("_line")).alias("row_key"),
    )


def ad_rows_with_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ad rows with every first line of an order a second time."""
    rows = ad_rows(spark, sf_dir)
    copies = F.when(F.col("line_number") == 1, 2).otherwise(1)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).drop("copy")
