"""Scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def scan_parquet(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def between_shards(df: DataFrame, start: str, end: str, column: str = "dt") -> DataFrame:
    """Date shards ``start`` to ``end`` inclusive, compared as text.

    On a table partitioned by ``column`` this prunes partitions.
    """
    return df.filter(F.col(column).between(start, end))


def scan_date_shards(spark: SparkSession, root: str, start: str, end: str, column: str = "dt") -> DataFrame:
    """Shards of a table laid out as ``root/dt=yyyyMMdd``."""
    df = spark.read.parquet(root)
    return between_shards(df.withColumn(column, F.col(column).cast("string")), start, end, column)


def write_parquet(
    df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "errorifexists"
) -> None:
    writer = df.write.mode(mode).option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def copy_table(spark: SparkSession, source: str, target: str, mode: str = "errorifexists") -> None:
    """Copy a table of any size; partitions stream through the executors."""
    write_parquet(spark.read.parquet(source), target, mode=mode)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def row_count(spark: SparkSession, path: str) -> int:
    """Row count from Parquet footers; no column is decoded."""
    return spark.read.parquet(path).count()
