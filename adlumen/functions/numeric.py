"""Numeric expressions: guarded ratios, log targets, cycles, efficiency."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

EPSILON = 1e-9


def clean_number(c: Column) -> Column:
    """Lenient cast to double: unreadable text and NaN become null."""
    return F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))


def fill_and_clip(c: Column) -> Column:
    return F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))


def negative_to_null(c: Column) -> Column:
    return F.when(c >= 0, c)


def safe_div(num: Column, den: Column) -> Column:
    """Ratio with the denominator held at or above 1e-9 (null counts as below)."""
    return num.cast("double") / F.greatest(den.cast("double"), F.lit(EPSILON))


def log1p_safe(c: Column) -> Column:
    """log(1+x) with negatives and nulls as 0."""
    return F.log1p(F.greatest(c.cast("double"), F.lit(0.0)))


def log1p_or_null(c: Column) -> Column:
    """log(1+x) with unreadable and negative values as null."""
    return F.log1p(negative_to_null(clean_number(c)))


def sin_cycle(c: Column, period: float) -> Column:
    return F.sin(F.lit(2.0 * math.pi) * c.cast("double") / F.lit(float(period)))


def cos_cycle(c: Column, period: float) -> Column:
    return F.cos(F.lit(2.0 * math.pi) * c.cast("double") / F.lit(float(period)))


def inverse_log(c: Column) -> Column:
    return F.expm1(c)


def smeared_level(log_pred: Column, smear: Column) -> Column:
    """Log prediction back to the level, floored at 0, times the smear factor."""
    return F.greatest(F.expm1(log_pred), F.lit(0.0)) * smear


def efficiency_ratios() -> dict[str, Column]:
    """CTR, CVR, CPM, CPC, ROAS, ACOS from the metric columns."""
    c = F.col
    return {
        "ctr": safe_div(c("clicks"), c("impressions")),
        "cvr": safe_div(c("actions"), c("clicks")),
        "cpm": safe_div(c("cost"), c("impressions") / 1000.0),
        "cpc": safe_div(c("cost"), c("clicks")),
        "roas": safe_div(c("conversion_value"), c("cost")),
        "acos": safe_div(c("cost"), c("conversion_value")),
    }


def cost_per_day() -> dict[str, Column]:
    cost, one = F.col("cost"), F.lit(1)
    return {
        "adg_cost_per_day": safe_div(cost, F.greatest(F.col("ad_group_duration"), one)),
        "camp_cost_per_day": safe_div(cost, F.greatest(F.col("campaign_duration"), one)),
    }


def cost_interactions() -> dict[str, Column]:
    """log(1+cost) times the month cycle of each start date."""
    log_cost = log1p_safe(F.col("cost"))
    return {
        f"cost_x_{p}_start_month_{f}": log_cost * F.col(f"{p}_start_month_{f}")
        for p in ("adg", "camp")
        for f in ("sin", "cos")
    }


def log_targets(columns: list[str]) -> dict[str, Column]:
    return {f"{c}_log1p": log1p_safe(F.col(c)) for c in columns}


def row_errors(true: Column, pred: Column) -> dict[str, Column]:
    """Error columns of one prediction."""
    err = pred - true
    spread = F.greatest(F.abs(true) + F.abs(pred), F.lit(1e-8))
    return {
        "err": err,
        "abs_err": F.abs(err),
        "ape": F.when(F.abs(true) > 0, F.abs(err) / F.abs(true)),
        "sape": 2.0 * F.abs(err) / spread,
    }
