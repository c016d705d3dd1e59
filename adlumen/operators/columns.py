"""Column selection, cleaning and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from adlumen import names
from adlumen.functions import numeric
from adlumen.functions.text import normalize_name


def alias_map(columns: list[str], aliases: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Source column -> canonical name; the first listed alias present wins."""
    by_form: dict[str, str] = {}
    for c in columns:
        by_form.setdefault(normalize_name(c), c)
    found = {}
    for canonical, options in (aliases or names.COLUMN_ALIASES).items():
        source = next((by_form[f] for f in map(normalize_name, options) if f in by_form), None)
        if source is not None:
            found[source] = canonical
    return found


def rename_by_alias(df: DataFrame, aliases: dict[str, list[str]] | None = None) -> DataFrame:
    """Rename known aliases to canonical names, other columns stay."""
    return df.withColumnsRenamed(alias_map(df.columns, aliases))


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"required columns not found: {missing}")
    return df


def keep_present(df: DataFrame, wanted: list[str]) -> tuple[DataFrame, list[str]]:
    """The wanted columns that exist, and the names of those that do not."""
    have = set(df.columns)
    return df.select(*[c for c in wanted if c in have]), [c for c in wanted if c not in have]


def reorder(df: DataFrame, first: list[str], drop: list[str] = ()) -> DataFrame:
    """Wanted columns first, the rest after, some dropped."""
    rest = [c for c in df.columns if c not in drop]
    return df.select(*[c for c in first if c in rest], *[c for c in rest if c not in first])


def clean_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Lenient cast of the columns that exist to double."""
    return df.withColumns({c: numeric.clean_number(F.col(c)) for c in columns if c in df.columns})


def fill_and_clip(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns(
        {c: numeric.fill_and_clip(numeric.clean_number(F.col(c))) for c in columns if c in df.columns}
    )


def negatives_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: numeric.negative_to_null(F.col(c)) for c in columns})


def complete_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a null in any of the columns."""
    return df.na.drop(subset=columns)


def fill_to_features(df: DataFrame, features: list[str], keep: list[str] = ()) -> DataFrame:
    """Exactly the feature list in its order; absent features are 0.0."""
    have = set(df.columns)
    return df.select(
        *keep,
        *[(F.col(f"`{f}`").cast("double") if f in have else F.lit(0.0)).alias(f) for f in features],
    )


def row_key(columns: list[str]):
    """Stable identity of a row: a digest of its columns.

    Nulls, NaN, -0.0 and times a microsecond apart are told apart.
    """
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    options = {"ignoreNullFields": "false", "timestampFormat": micros, "timestampNTZFormat": micros, "timeZone": "UTC"}
    return F.md5(F.to_json(F.struct(*columns), options))
