"""Prediction errors, overall and per segment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from adlumen import names
from adlumen.functions import numeric
from adlumen.operators.ranking import quantiles


def metric_columns(true: Column, pred: Column) -> dict[str, Column]:
    """Aggregates for one group: size, MAE, RMSE, R2, WAPE, sMAPE."""
    err = true - pred
    spread = F.abs(true) + F.abs(pred)
    var = F.var_pop(true)
    mse = F.avg(err * err)
    return {
        "n": F.count(err),
        "mae": F.avg(F.abs(err)),
        "rmse": F.sqrt(mse),
        # Undefined for one row; a constant truth scores 1 when met, else 0.
        "r2": F.when(F.count(err) < 2, None).when(var > 0, 1 - mse / var).when(mse == 0, 1.0).otherwise(0.0),
        "wape": F.try_divide(F.sum(F.abs(err)), F.sum(F.abs(true))),
        "smape": F.avg(F.when(spread > 0, 2.0 * F.abs(err) / spread).otherwise(0.0)),
    }


def evaluate(df: DataFrame, true: str, pred: str, by: list[str] = ()) -> DataFrame:
    aggs = metric_columns(F.col(true), F.col(pred))
    return df.groupBy(*by).agg(*[a.alias(n) for n, a in aggs.items()])


def evaluate_log(df: DataFrame, true_log: str, pred_log: str, by: list[str] = ()) -> DataFrame:
    """Errors of a log-scale prediction on both scales, one row per scale."""
    scales = F.array(
        F.struct(F.lit("log").alias("scale"), F.col(true_log).alias("y"), F.col(pred_log).alias("p")),
        F.struct(F.lit("orig").alias("scale"), F.expm1(true_log).alias("y"), F.expm1(pred_log).alias("p")),
    )
    rows = df.select(*by, F.explode(scales).alias("_s")).select(*by, "_s.*")
    return evaluate(rows, "y", "p", [*by, "scale"])


def _by_target(df: DataFrame, targets: list[str], keep: list[str]) -> DataFrame:
    have = [t for t in targets if f"{t}_true" in df.columns and f"{t}_pred" in df.columns]
    cells = F.array(
        *[F.struct(F.lit(t).alias("target"), F.col(f"{t}_true").alias("y"), F.col(f"{t}_pred").alias("p")) for t in have]
    )
    return df.select(*keep, F.explode(cells).alias("_t")).select(*keep, "_t.*")


def metrics_by_segment(df: DataFrame, targets: list[str] = names.CAMPAIGN_TARGETS, segment: str = "business_type") -> DataFrame:
    """Errors per target over all rows and per segment, in one pass."""
    rows = _by_target(df, targets, [segment])
    aggs = metric_columns(F.col("y"), F.col("p"))
    out = rows.groupingSets([["target"], ["target", segment]], "target", segment).agg(
        F.grouping(segment).alias("_total"), *[a.alias(n) for n, a in aggs.items()]
    )
    name = F.when(F.col("_total") == 1, "ALL").otherwise(F.concat(F.lit("bt="), F.coalesce(F.col(segment), F.lit("None"))))
    return out.select(name.alias("group"), "target", *aggs).orderBy("group", "target")


def row_errors(df: DataFrame, targets: list[str] = names.CAMPAIGN_TARGETS, keep: list[str] = ()) -> DataFrame:
    """Truth, prediction and error columns side by side."""
    out = [F.col(k) for k in keep]
    for t in targets:
        y, p = F.coalesce(F.col(f"{t}_true"), F.lit(0.0)), F.coalesce(F.col(f"{t}_pred"), F.lit(0.0))
        out += [y.alias(f"{t}_true"), p.alias(f"{t}_pred")]
        out += [e.alias(f"{t}_{n}") for n, e in numeric.row_errors(y, p).items()]
    return df.select(*out)


def top_errors(errors: DataFrame, target: str, k: int, tie: list[str]) -> DataFrame:
    """The k rows with the largest absolute error."""
    return errors.orderBy(F.desc(f"{target}_abs_err"), *tie).limit(k)


def median_smear(df: DataFrame, true_level: str, pred_log: str, by: list[str] = (), small: int | None = None) -> DataFrame:
    """Median ratio of truth to back-transformed prediction: ``by..., smear``."""
    level = F.greatest(F.expm1(pred_log), F.lit(1e-12))
    ratio = F.greatest(F.col(true_level), F.lit(0.0)) / level
    rows = df.select(*by, F.when(F.abs(ratio) < float("inf"), ratio).alias("ratio"))
    found = quantiles(rows, ["ratio"], [0.5], by, **({} if small is None else {"small": small}))
    if by:
        return found.select(*by, F.col("value").alias("smear"))
    return found.agg(F.coalesce(F.max("value"), F.lit(1.0)).alias("smear"))
