"""Date parsing and calendar features."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from adlumen import names
from adlumen.functions.numeric import cos_cycle, sin_cycle


def to_date(c: Column) -> Column:
    """Date from a date, timestamp or ISO text; anything else is null."""
    return c.try_cast("date")


def parse_any_date(c: Column, formats: list[str] | None = None) -> Column:
    """Date from text in the first spelling that fits."""
    text = c.cast("string")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats or names.DATE_FORMATS])


def parse_datetime(c: Column) -> Column:
    """Timestamp from the date-time text holds; trailing text is ignored."""
    found = F.regexp_extract(c.cast("string"), r"\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2})?)?", 0)
    return F.nullif(found, F.lit("")).try_cast("timestamp")


def days_between(end: Column, start: Column) -> Column:
    """Whole days, never negative, null as 0."""
    return F.coalesce(F.greatest(F.datediff(end, start), F.lit(0)), F.lit(0)).cast("bigint")


def duration_from_dates(end: Column, start: Column) -> Column:
    """Campaign length from date columns; null stays null."""
    days = F.datediff(F.to_date(end), F.to_date(start))
    return F.when(days.isNotNull(), F.greatest(days, F.lit(0))).cast("bigint")


def duration_from_text(end: Column, start: Column) -> Column:
    """Campaign length from text columns: whole days, null as 0."""
    seconds = F.unix_seconds(parse_datetime(end)) - F.unix_seconds(parse_datetime(start))
    return F.coalesce(F.greatest((seconds / 86400).cast("bigint"), F.lit(0)), F.lit(0)).cast("bigint")


def time_block(prefix: str, d: Column, dow_base: int = 0) -> dict[str, Column]:
    """The 18 calendar features of one date.

    ``dow_base`` is the number of Monday.  With 0 the weekend flag marks
    Saturday and Sunday; 1 keeps day numbers of tables built with ISO
    numbering, where the same comparison marks Friday as well.
    """
    month, day, length = F.month(d), F.dayofmonth(d), F.dayofmonth(F.last_day(d))
    dow = F.weekday(d) + F.lit(dow_base)
    doy = F.dayofyear(d)
    block = {
        "month": month.cast("tinyint"),
        "year4": F.year(d).cast("smallint"),
        "dow": dow.cast("tinyint"),
        "weekofyear": F.weekofyear(d).cast("smallint"),
        "doy": doy.cast("smallint"),
        "days_in_month": length.cast("tinyint"),
        "dom": day.cast("tinyint"),
        "month_progress": (day - 1) / length,
        "quarter": F.quarter(d).cast("tinyint"),
        "is_weekend": (dow >= 5).cast("tinyint"),
        "is_month_start": (day == 1).cast("tinyint"),
        "is_month_end": (day == length).cast("tinyint"),
        "month_sin": sin_cycle(month, 12),
        "month_cos": cos_cycle(month, 12),
        "dow_sin": sin_cycle(dow, 7),
        "dow_cos": cos_cycle(dow, 7),
        "doy_sin": sin_cycle(doy, 366),
        "doy_cos": cos_cycle(doy, 366),
    }
    return {f"{prefix}_{k}": v for k, v in block.items()}


def date_relations(adg_start: Column, adg_end: Column, camp_start: Column, camp_end: Column) -> dict[str, Column]:
    """Offsets and containment of an ad group within its campaign."""
    lead = F.datediff(adg_start, camp_start)
    tail = F.datediff(camp_end, adg_end)
    return {
        "adg_start_minus_camp_start_days": lead.cast("bigint"),
        "camp_end_minus_adg_end_days": tail.cast("bigint"),
        "adg_start_offset_days": F.greatest(lead, F.lit(0)).cast("bigint"),
        "adg_end_offset_days": F.greatest(tail, F.lit(0)).cast("bigint"),
        "adg_inside_campaign": ((lead >= 0) & (tail >= 0)).cast("tinyint"),
    }


def duration_ratio(adg: Column, camp: Column) -> Column:
    return adg / F.greatest(camp, F.lit(1))


def midpoint(start: Column, duration: Column) -> Column:
    return F.date_add(start, F.floor(duration / 2).cast("int"))


def midpoint_cycle(prefix: str, start: Column, duration: Column) -> dict[str, Column]:
    month = F.month(midpoint(start, duration))
    return {f"{prefix}_mid_month_sin": sin_cycle(month, 12), f"{prefix}_mid_month_cos": cos_cycle(month, 12)}
