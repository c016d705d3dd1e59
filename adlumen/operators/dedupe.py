"""Duplicate removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from adlumen.operators.columns import row_key


def distinct_rows(df: DataFrame) -> DataFrame:
    """One of each row.  Copies fold on the map side before the shuffle."""
    return df.dropDuplicates()


def first_per_key(df: DataFrame, key: list[str], order_by: list[str] | None = None) -> DataFrame:
    """One row per key, the first by ``order_by``.

    The order defaults to the remaining columns, so the result does not depend
    on file order.  The filter on rank 1 is applied before the shuffle too, so
    each task sends at most one row per key.
    """
    key = [c for c in key if c in df.columns]
    rest = order_by if order_by is not None else [c for c in df.columns if c not in key]
    if not rest:
        return df.dropDuplicates(key)
    window = Window.partitionBy(*key).orderBy(*[F.col(c).asc_nulls_last() for c in rest])
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def keyed_rows(batch: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row of a batch for each value of ``columns``, with its ``row_key``; the same one if a task runs again."""
    columns = columns or batch.columns
    return first_per_key(batch, columns).withColumn("row_key", row_key(columns))


def new_rows(keyed: DataFrame, seen_keys: DataFrame) -> DataFrame:
    """Rows whose key is not in ``seen_keys(row_key)``."""
    return keyed.join(seen_keys.select("row_key"), "row_key", "left_anti")


def dedupe_report(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows before and after, rows removed and their share."""
    per_key = df.groupBy(*key).agg(F.count("*").alias("copies"))
    out = per_key.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows_before"),
        F.count("*").alias("rows_after"),
    )
    removed = F.col("rows_before") - F.col("rows_after")
    return out.withColumn("removed", removed).withColumn(
        "removed_share", F.try_divide(removed.cast("double"), F.col("rows_before").cast("double"))
    )
