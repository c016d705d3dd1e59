"""Merges of files whose schemas drifted apart."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import (
    ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType,
    ShortType, StringType, StructField, StructType, TimestampNTZType, TimestampType,
)

_WIDTH = [ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType]


def common_type(a: DataType, b: DataType) -> DataType:
    """The type that holds values of both."""
    if a == b:
        return a
    ranks = [next((i for i, t in enumerate(_WIDTH) if isinstance(x, t)), None) for x in (a, b)]
    if None not in ranks:
        integers, widest = min(ranks) <= 3, _WIDTH[max(ranks)]
        # A float cannot hold every integer.
        return DoubleType() if widest is FloatType and integers else widest()
    if isinstance(a, DecimalType) and isinstance(b, DecimalType):
        scale = max(a.scale, b.scale)
        return DecimalType(min(38, max(a.precision - a.scale, b.precision - b.scale) + scale), scale)
    if all(isinstance(x, DecimalType) or r is not None for x, r in zip((a, b), ranks)):
        return DoubleType()
    if {type(a), type(b)} == {DateType, TimestampType}:
        return TimestampType()
    if {type(a), type(b)} == {DateType, TimestampNTZType}:
        return TimestampNTZType()
    return StringType()


def union_schema(schemas: list[StructType]) -> StructType:
    """Every column once, in first-seen order, at its widest type."""
    types: dict[str, DataType] = {}
    for schema in schemas:
        for field in schema:
            types[field.name] = common_type(types[field.name], field.dataType) if field.name in types else field.dataType
    out = StructType()
    for name, dtype in types.items():
        out = out.add(name, dtype, True)
    return out


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """Cast to a schema; absent columns are typed nulls, bad values null."""
    have = {f.name: f.dataType for f in df.schema}

    def column(field):
        if field.name not in have:
            return F.lit(None).cast(field.dataType).alias(field.name)
        c = F.col(f"`{field.name}`")
        return c if have[field.name] == field.dataType else c.try_cast(field.dataType).alias(field.name)

    return df.select(*[column(f) for f in schema])


def union_relaxed(frames: list[DataFrame]) -> DataFrame:
    """Union by name over the union schema."""
    if not frames:
        raise ValueError("nothing to union")
    schema = union_schema([f.schema for f in frames])
    return reduce(DataFrame.unionByName, [conform(f, schema) for f in frames])


@dataclass
class MergeReport:
    """What a merge did: shards, distinct schemas (a scan each), cells that a cast made null, columns left out."""

    shards: int
    scans: int
    nulled_cells: int
    dropped_columns: list[str]


def catalogue(spark: SparkSession, paths: list[str], threads: int = 16) -> dict[str, tuple[StructType, list[str]]]:
    """The paths by their schema, from one footer each, read side by side."""
    with ThreadPoolExecutor(threads) as pool:
        schemas = list(pool.map(lambda p: spark.read.parquet(p).schema, paths))
    out: dict[str, tuple[StructType, list[str]]] = {}
    for path, schema in zip(paths, schemas):
        # Whether a column may be null is no difference.
        key = str([(f.name, f.dataType.simpleString()) for f in schema])
        out.setdefault(key, (schema, []))[1].append(path)
    return out


def _gathered(spark: SparkSession, shards: dict[str, tuple[StructType, list[str]]], schema: StructType) -> DataFrame:
    """All shards in one schema, one scan for each schema they have; ``_nulled`` counts the cells a cast lost."""
    frames = []
    for own, paths in shards.values():
        df = spark.read.schema(own).parquet(*paths)
        casts = [f for f in schema if f.name in own.names and own[f.name].dataType != f.dataType]
        lost = sum((F.when(F.col(f"`{f.name}`").isNotNull() & F.col(f"`{f.name}`").try_cast(f.dataType).isNull(), 1).otherwise(0) for f in casts), F.lit(0))
        nulled = df.select("*", lost.cast("bigint").alias("_nulled"))
        frames.append(conform(nulled, StructType([*schema.fields, StructField("_nulled", LongType())])))
    return reduce(DataFrame.unionByName, frames)


def _written(df: DataFrame, output: str, overwrite: bool) -> int:
    """Write the table without its count of lost cells, which is summed up on the way."""
    seen = Observation()
    counted = df.observe(seen, F.coalesce(F.sum("_nulled"), F.lit(0)).alias("nulled")).drop("_nulled")
    counted.write.mode("overwrite" if overwrite else "errorifexists").option("compression", "zstd").parquet(output)
    return seen.get["nulled"]


def merge_shards(
    spark: SparkSession, inputs: list[str], output: str, overwrite: bool = False, types: str = "widest", files: int | None = None
) -> tuple[DataFrame, MergeReport]:
    """Merge tables of drifted schemas into one Parquet table, and say what it cost.

    With ``widest`` every column of any shard is kept, at the type that holds all its values; with ``first`` the schema is
    that of the first shard by name, columns it has not are left out and values that don't fit become null.  ``files``
    rewrites the table as so many.
    """
    shards = catalogue(spark, inputs)
    schemas = [s for s, _ in shards.values()]
    schema = schemas[0] if types == "first" else union_schema(schemas)
    merged = _gathered(spark, shards, schema)
    nulled = _written(merged.repartition(files) if files else merged, output, overwrite)
    dropped = sorted({n for s in schemas for n in s.names} - set(schema.names))
    return spark.read.parquet(output), MergeReport(len(inputs), len(shards), nulled, dropped)


def merge_many(spark: SparkSession, inputs: list[str], output: str, overwrite: bool = False) -> DataFrame:
    """Merge tables into one Parquet table over the union of their schemas.

    Raises when there is no input, or when the output is there already and
    ``overwrite`` is off.  The inputs are only read.
    """
    todo = [p for p in sorted(inputs) if p != output]
    if not todo:
        raise ValueError("no input tables to merge")
    return merge_shards(spark, todo, output, overwrite)[0]


def compact_shards(
    spark: SparkSession, shards: list[str], output: str, files: int, overwrite: bool = False, types: str = "first"
) -> DataFrame:
    """Rewrite many small files as ``files`` larger ones, in the first shard's schema or the ``widest`` one.

    Earlier merge results (``*_merged.parquet``) among the shards are skipped.
    """
    todo = [s for s in sorted(shards) if not s.rstrip("/").endswith("_merged.parquet") and s != output]
    if not todo:
        raise ValueError("no shards to compact")
    return merge_shards(spark, todo, output, overwrite, types, files)[0]
