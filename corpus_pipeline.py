"""A corpus pipeline over ``documents``: quality, near duplicates, benchmark text, personal data, packing.

A stage takes the documents its predecessor kept, with all their columns, and decides about each of them:

* quality: rejects documents the classifier scores under 0.7; it learns from the labels of all given documents that are
  not held out, and needs no label to score one;
* near_duplicates: of each group linked by a Jaccard similarity of 0.75 of five-word shingles, the smallest id stays;
* decontamination: documents that hold a window of a benchmark item go;
* personal_data: addresses, card and phone numbers and the terms that reveal them are replaced in the texts;
* packing: the texts as token pieces in sequences of 2,048.

Null and empty texts are documents without words: the classifier judges them by statistics of zero, and no later stage
drops them.  Extra columns pass through up to the last stage; an empty table passes as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from adlumen.llm import decontaminate, packing, partenum, quality, sanitize
from adlumen.llm.common import small_batches, stored
from adlumen.llm.queries import public_tokenizer


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return partenum.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitize.sanitised(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(docs, public_tokenizer())


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("packing", packed),
]
# Boosted trees and byte-pair encoding are beyond SQL; tests/llm compares every stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn; each result is written and read again before the next."""
    small_batches(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
