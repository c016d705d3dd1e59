"""Text normalisers, slugs and number formats."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

SPACES = r"(?U)\s+"


def normalize_name(name: str) -> str:
    """Column-name form: lower case, every run of other characters one ``_``."""
    return re.sub(r"[\W_]+", "_", name.strip().lower()).strip("_")


def normalize_name_col(c: Column) -> Column:
    """:func:`normalize_name` for values."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[\W_]+", "_"), r"^_+|_+$", "")


def squeeze(c: Column) -> Column:
    """Lower case with whitespace runs as one blank; edges and nulls stay."""
    return F.regexp_replace(F.lower(c.cast("string")), SPACES, " ")


def norm_text(c: Column) -> Column:
    """Category form: squeezed, trimmed, null as ``unknown``."""
    return F.coalesce(F.trim(squeeze(c)), F.lit("unknown"))


def storage_slug(c: Column) -> Column:
    """Path segment: separators to ``-``, other characters dropped."""
    s = F.regexp_replace(F.trim(F.lower(c)), r"[|/\\\s]+", "-")
    s = F.regexp_replace(s, r"[^a-z0-9\-_]+", "")
    s = F.regexp_replace(F.regexp_replace(s, "-{2,}", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("unknown"))


def table_slug(c: Column, max_length: int = 250) -> Column:
    """Table name: ``c_`` in front when empty or led by a digit."""
    s = F.regexp_replace(F.trim(F.lower(c)), r"[^a-z0-9_]", "_")
    s = F.regexp_replace(F.regexp_replace(s, "_+", "_"), "^_|_$", "")
    s = F.when(s.rlike("^[a-z_]"), s).otherwise(F.concat(F.lit("c_"), s))
    return F.substring(s, 1, max_length)


def export_prefix(
    company: Column, business_type: Column, base: str, start: str, end: str, group_by_type: bool = False
) -> Column:
    """Output path of one company for one date window."""
    leaf = F.concat(storage_slug(company), F.lit(f"_profile_{start}_{end}"))
    parts = [F.lit(base)] + ([business_type] if group_by_type else []) + [leaf]
    return F.concat_ws("/", *parts)


def strip_suffix(c: Column, suffix: str = "_log1p") -> Column:
    return F.replace(c, F.lit(suffix), F.lit(""))


def format_count(c: Column) -> Column:
    return F.format_number(c, 0)


def format_usd(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 2))
