"""The registered queries of the operators, each over its whole table, and their SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from adlumen.llm import bucketsort, chaining, covertree, decontaminate, lexical, middle, packing, partenum, quality, rotated, sanitize, suffixtree, warc
from adlumen.llm.sql import SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of all pages, written to archives and read back."""
    found = warc.round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


@register
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold text of the benchmark, and of which items."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "first_token", F.round("overlap", 6).alias("overlap"))


@register
def op3_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by boosted trees."""
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op5_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that a smaller document has too, edits allowed."""
    return chaining.passages(table(spark, sf_dir, "documents"))


@register
def op6_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors with a cosine of 0.9 or more."""
    return covertree.near_pairs(table(spark, sf_dir, "embeddings"))


@register
def op4_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents, and the terms that reveal it."""
    found = sanitize.marked(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "n_term")


def public_tokenizer() -> tuple[str, str, str]:
    import public_tokenizers as public

    return public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN


@register
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2,048 tokens."""
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizer())


@register
def op8_partenum_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents linked by a Jaccard similarity of 0.75 or more of their five-word shingles."""
    return partenum.jaccard_components(table(spark, sf_dir, "documents"))


@register
def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each document without the strings of 50 bytes that start in a smaller document too."""
    kept = bucketsort.without_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register
def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probabilities of all documents by the suffix tree and by unigrams of words."""
    return suffixtree.scored(table(spark, sf_dir, "documents"))


@register
def op11_wavelet_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut for filling in the middle, and rebuilt from the result."""
    return middle.checked(table(spark, sf_dir, "documents"))


@register
def op12_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth."""
    return rotated.nearest(table(spark, sf_dir, "embeddings"))


@register
def op13_hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents for each item of the benchmark."""
    return lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
