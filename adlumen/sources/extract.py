"""Per-company extracts from the ad tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from adlumen.functions import classify as kw
from adlumen.functions.text import export_prefix, storage_slug
from adlumen.sources.session import checkpointed, small_side


def assign_companies(df: DataFrame, mapping: kw.Mapping, mode: str = "longest", profile: str = "profile") -> DataFrame:
    """Rows of the listed companies with ``company`` and ``business_type``.

    A row belongs to a company when its account name starts with the company
    name, or with ``|`` and the name.  With ``longest`` a row goes to the
    longest such name; with ``all`` it is returned once per matching name, as
    separate extracts per company would give it.
    """
    keywords = [k.strip().lower() for k, _ in mapping]
    name = F.lower(F.col(profile))
    if mode == "longest":
        out = df.withColumn("company", kw.longest_prefix(name, keywords)).filter(F.col("company").isNotNull())
    elif mode == "all":
        out = df.withColumn("company", F.explode(kw.all_keywords(name, keywords, "prefix")))
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return out.withColumn("business_type", company_type(F.col("company"), mapping))


def company_type(company: Column, mapping: kw.Mapping) -> Column:
    """Type of an assigned company: a constant map lookup, no join."""
    pairs = {k.strip().lower(): v for k, v in mapping}
    entries = [F.lit(x) for kv in pairs.items() for x in kv]
    return F.create_map(*entries)[company]


def company_counts(df: DataFrame, mapping: kw.Mapping, mode: str = "longest") -> DataFrame:
    """Rows per company; companies without rows do not appear."""
    return assign_companies(df, mapping, mode).groupBy("company", "business_type").agg(F.count("*").alias("n_rows"))


def with_export_prefix(df: DataFrame, base: str, start: str, end: str, group_by_type: bool = False) -> DataFrame:
    return df.withColumn(
        "prefix", export_prefix(F.col("company"), F.col("business_type"), base, start, end, group_by_type)
    )


def export_companies(
    df: DataFrame,
    mapping: kw.Mapping,
    output: str,
    mode: str = "longest",
    rows_per_file: int = 5_000_000,
) -> None:
    """Write one folder per company, in about rows / ``rows_per_file`` files each.

    Companies are counted first; the rows of one are dealt to as many salts as it will have files, so a company with most
    rows is spread over that many tasks, and a small one is a single file whatever tasks its rows came from.
    """
    out = assign_companies(df, mapping, mode).withColumn("company_slug", storage_slug(F.col("company")))
    files = checkpointed(out.groupBy("company_slug").agg(F.ceil(F.count("*") / rows_per_file).cast("int").alias("_files")))
    total = files.agg(F.sum("_files")).first()[0] or 1
    salt = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns], F.monotonically_increasing_id()), F.col("_files"))
    # Stored before it is dealt: a task that runs again must not deal its rows otherwise.
    salted = checkpointed(out.join(small_side(files), "company_slug").withColumn("_salt", salt)) if total > files.count() else out.withColumn("_salt", F.lit(0))
    (
        salted.repartition(total, "company_slug", "_salt").drop("_files", "_salt").write.mode("errorifexists")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", rows_per_file + rows_per_file // 2)
        .partitionBy("company_slug")
        .parquet(output)
    )
