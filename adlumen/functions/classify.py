"""Keyword classification of account names.

A mapping is an ordered list of ``(keyword, label)``; the first keyword that
matches decides.  Three matching rules are in use:

``prefix``     the name starts with the keyword, or with ``|`` and the keyword
``word``       the keyword occurs between word boundaries
``substring``  the keyword occurs anywhere
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Mapping = Sequence[tuple[str, str]]

# Up to this many keywords a mapping is one expression; a longer one stays a table and is joined.
MAX_KEYWORDS = 1_000


def load_mapping(df: DataFrame) -> list[tuple[str, str]] | DataFrame:
    """A ``keyword, business_type, priority`` table in priority order; a long one as the table it is."""
    rows = df.select("keyword", "business_type", "priority").orderBy("priority", "business_type").limit(MAX_KEYWORDS + 1).collect()
    return df if len(rows) > MAX_KEYWORDS else [(r.keyword, r.business_type) for r in rows]


def mapping_frame(spark: SparkSession, mapping: Mapping) -> DataFrame:
    rows = [(k, v, i) for i, (k, v) in enumerate(mapping)]
    return spark.createDataFrame(rows, "keyword string, business_type string, priority int")


def matches(c: Column, keyword: str, mode: str) -> Column:
    k = keyword.strip().lower()
    if mode == "prefix":
        return c.startswith(k) | c.startswith("|" + k)
    if mode == "substring":
        return c.contains(k)
    if mode == "word":
        # The plain search is cheap and rules out nearly every row, so the
        # regular expression runs only where the keyword does occur.
        return c.contains(k) & c.rlike(rf"(?U)\b{re.escape(k)}\b")
    raise ValueError(f"unknown matching mode {mode!r}")


def classify(c: Column, mapping: Mapping, mode: str = "word", default: str | None = "unknown") -> Column:
    """Label of the first matching keyword, ``default`` where none matches."""
    out = None
    for keyword, label in mapping:
        hit = matches(c, keyword, mode)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    fallback = F.lit(default).cast("string")
    return fallback if out is None else out.otherwise(fallback)


def first_keyword(c: Column, keywords: Sequence[str], mode: str = "prefix") -> Column:
    """The first matching keyword itself, null where none matches."""
    return classify(c, [(k, k) for k in keywords], mode, default=None)


def longest_prefix(c: Column, keywords: Sequence[str]) -> Column:
    """The longest keyword the name starts with, so nested names do not clash."""
    return first_keyword(c, sorted(keywords, key=lambda k: (-len(k), k)), "prefix")


def all_keywords(c: Column, keywords: Sequence[str], mode: str = "prefix") -> Column:
    """Array of every matching keyword."""
    hits = [F.when(matches(c, k, mode), F.lit(k)) for k in keywords]
    return F.array_compact(F.array(*hits))


def known_or_classified(c: Column, vocabulary: Sequence[str], mapping: Mapping, mode: str = "substring") -> Column:
    """A value of the vocabulary passes through, other text is classified."""
    return F.when(c.isin(*vocabulary), c).otherwise(classify(F.coalesce(F.trim(F.lower(c)), F.lit("unknown")), mapping, mode))
