"""Join helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from adlumen.functions import classify as kw
from adlumen.sources.session import MAX_BROADCAST_ROWS, checkpointed


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys where null matches null; the keys of the left side stay.

    Other columns must differ in name.  Spark plans this as an equi-join.
    """
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    pairs = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, reduce(lambda a, b: a & b, pairs), how).drop(*[f"_right_{k}" for k in keys])


def label_distinct(
    df: DataFrame, name: Column, mapping: kw.Mapping | DataFrame, output: str, mode: str = "word", max_names: int = MAX_BROADCAST_ROWS
) -> DataFrame:
    """Classify each distinct name once and look the label up per row; a mapping that is a table is joined.

    Worth it for long mappings: the cost per row is one hash lookup.  Names are
    read in a pass of their own.  With over ``max_names`` of them the label is
    worked out per row instead, so the table is never shuffled.
    """
    if isinstance(mapping, DataFrame):
        from adlumen.operators.dictionary import classify_names

        return classify_names(df, name, mapping, output, mode)
    named = df.withColumn("_name", name)
    distinct = checkpointed(named.select("_name").distinct().limit(max_names + 1))
    if distinct.count() > max_names:
        return named.withColumn(output, kw.classify(F.col("_name"), mapping, mode)).drop("_name")
    lookup = F.broadcast(distinct.withColumn(output, kw.classify(F.col("_name"), mapping, mode)))
    return null_safe_join(named, lookup, ["_name"]).drop("_name")
