"""Splits, errors, prediction figures, ensembles and comparison tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from adlumen import names
from adlumen.functions import kpi, numeric
from adlumen.operators import metrics, models, split
from adlumen.plans import campaign, reports
from adlumen.queries.registry import ADS, ROLLUP, TYPED, query
from adlumen.queries.relational import typed_ads
from adlumen.sources.adapters import SEGMENT_MAPPING, ad_rows, ad_rows_with_copies, table
from adlumen.sources.session import stored

_SHARE = "(('0x' || substr(md5({k} || '|{s}'), 1, 8))::BIGINT / 4294967296.0)"
_HASH = "(('0x' || substr(md5({k} || '|{s}'), 1, 15))::BIGINT)"


def _share(k, s=42):
    return _SHARE.format(k=k, s=s)


def _hash(k, s=42):
    return _HASH.format(k=k, s=s)


# ---------------------------------------------------------------------- splits
@query(f"""SELECT o_orderkey, CASE WHEN {_share('o_orderkey::VARCHAR')} < 0.15 THEN 'test' WHEN {_share('o_orderkey::VARCHAR')} < 0.30 THEN 'val' ELSE 'train' END AS split FROM orders""")
def hash_split(spark, sf):
    return split.hash_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query(f"""SELECT o_orderkey, o_custkey FROM orders ORDER BY {_hash('o_orderkey::VARCHAR')} LIMIT 1000""")
def uniform_sample(spark, sf):
    return split.exact_sample(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), 1000, "o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def members(spark, sf):
    listed = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("l_orderkey"))
    return split.members(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), listed, "l_orderkey")


def _bin_sql(q: str) -> str:
    """Bin of rank r (1-based) of n cut into q equal intervals of ranks."""
    return f"CAST(greatest(1, ((r - 1) * {q} + n - 2) // greatest(n - 1, 1)) AS INTEGER)"


_RANKED = f"""{TYPED}, ranked AS (SELECT row_key, business_type, cost, row_number() OVER (ORDER BY cost, {_hash('row_key')}) AS r,
 count(*) OVER () AS n FROM typed)"""


@query(f"WITH {_RANKED} SELECT row_key, {_bin_sql('10')} AS cost_bin FROM ranked")
def cost_bins(spark, sf):
    return split.cost_bins(ad_rows(spark, sf).select("row_key", "cost"), "row_key").select("row_key", "cost_bin")


@query(f"""WITH {_RANKED}, b AS (SELECT row_key, business_type, unnest(range(2, 11)) AS q, r, n FROM ranked),
c AS (SELECT row_key, business_type, q, {_bin_sql('q')} AS bin FROM b),
good AS (SELECT max(q) AS q FROM (SELECT q, min(k) AS k FROM (SELECT q, business_type, bin, count(*) AS k FROM c GROUP BY ALL) GROUP BY q) WHERE k >= 2)
SELECT row_key, business_type || '|' || bin AS stratum FROM c JOIN good ON c.q = good.q""")
def strata(spark, sf):
    rows, _ = split.safe_strata(typed_ads(spark, sf).select("row_key", "business_type", "cost"), "row_key")
    return rows.select("row_key", "stratum")


@query(f"""WITH {TYPED}, k AS (SELECT row_key, business_type, row_number() OVER (PARTITION BY business_type ORDER BY {_hash('row_key')}) AS r,
 count(*) OVER (PARTITION BY business_type) AS n FROM typed)
SELECT row_key, business_type, r <= round(n * 0.1) AS taken FROM k""")
def stratified_share(spark, sf):
    rows = typed_ads(spark, sf).select("row_key", "business_type")
    return split.take_share(rows, "row_key", 0.1, ["business_type"], "taken")


def _strata_sql(name: str, source: str, max_q: int) -> str:
    return f"""{name}_r AS (SELECT *, row_number() OVER (ORDER BY cost, {_hash('row_key')}) AS r, count(*) OVER () AS n FROM {source}),
{name}_c AS (SELECT * EXCLUDE (r, n), {_bin_sql('q')} AS bin FROM (SELECT *, unnest(range(2, {max_q + 1})) AS q FROM {name}_r)),
{name} AS (SELECT * EXCLUDE (q, bin), business_type || '|' || bin AS stratum FROM {name}_c WHERE q = (SELECT max(q) FROM
  (SELECT q, min(k) AS k FROM (SELECT q, business_type, bin, count(*) AS k FROM {name}_c GROUP BY ALL) GROUP BY q) WHERE k >= 2))"""


@query(f"""WITH {TYPED}, base AS (SELECT row_key, business_type, cost FROM typed), {_strata_sql('a', 'base', 10)},
t AS (SELECT row_key, business_type, cost, row_number() OVER (PARTITION BY stratum ORDER BY {_hash('row_key')}) <= round(count(*) OVER (PARTITION BY stratum) * 0.1) AS is_test FROM a),
rest AS (SELECT row_key, business_type, cost FROM t WHERE NOT is_test), {_strata_sql('b', 'rest', 8)},
v AS (SELECT row_key, row_number() OVER (PARTITION BY stratum ORDER BY {_hash('row_key', 43)}) <= round(count(*) OVER (PARTITION BY stratum) * 0.111) AS is_val FROM b)
SELECT row_key, CASE WHEN is_val THEN 'val' ELSE 'train' END AS split FROM v UNION ALL SELECT row_key, 'test' FROM t WHERE is_test""")
def stratified_split(spark, sf):
    rows = typed_ads(spark, sf).select("row_key", "business_type", "cost")
    return split.stratified_split(rows, "row_key").select("row_key", "split")


# ---------------------------------------------------------------------- errors
def _predicted(spark, sf):
    """Ad rows with formula predictions beside the truth."""
    c = F.col
    return typed_ads(spark, sf).select(
        "row_key", "business_type",
        c("impressions").alias("impressions_true"), (c("reach") * 1.25 + 500).alias("impressions_pred"),
        c("clicks").alias("clicks_true"), (c("impressions") * 0.005).alias("clicks_pred"),
    )


_PREDICTED = f"""{TYPED}, predicted AS (SELECT row_key, business_type, impressions AS impressions_true, reach * 1.25 + 500 AS impressions_pred,
 clicks AS clicks_true, impressions * 0.005 AS clicks_pred FROM typed)"""
_LONG = _PREDICTED + """, long AS (SELECT row_key, business_type, 'impressions' AS target, impressions_true AS y, impressions_pred AS p FROM predicted
 UNION ALL SELECT row_key, business_type, 'clicks', clicks_true, clicks_pred FROM predicted)"""
_METRICS = """count(*) AS n, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse,
 round(1 - avg((y - p) * (y - p)) / var_pop(y), 6) AS r2, round(sum(abs(y - p)) / sum(abs(y)), 6) AS wape,
 round(avg(CASE WHEN abs(y) + abs(p) > 0 THEN 2 * abs(y - p) / (abs(y) + abs(p)) ELSE 0 END), 6) AS smape"""


@query(f"""WITH {_LONG} SELECT 'ALL' AS "group", target, {_METRICS} FROM long GROUP BY target
UNION ALL SELECT 'bt=' || business_type, target, {_METRICS} FROM long GROUP BY business_type, target""")
def metrics_overall_and_segment(spark, sf):
    return metrics.metrics_by_segment(_predicted(spark, sf), ["impressions", "clicks"])


@query(f"""WITH {_PREDICTED}, s AS (SELECT 'log' AS scale, ln(1 + clicks_true) AS y, ln(1 + clicks_pred) AS p FROM predicted
 UNION ALL SELECT 'orig', clicks_true, clicks_pred FROM predicted) SELECT scale, {_METRICS} FROM s GROUP BY scale""")
def metrics_both_scales(spark, sf):
    rows = _predicted(spark, sf).select(F.log1p("clicks_true").alias("y"), F.log1p("clicks_pred").alias("p"))
    return metrics.evaluate_log(rows, "y", "p")


@query(f"""WITH {_PREDICTED} SELECT row_key, impressions_true, impressions_pred, impressions_pred - impressions_true AS impressions_err,
 abs(impressions_pred - impressions_true) AS impressions_abs_err,
 round(CASE WHEN abs(impressions_true) > 0 THEN abs(impressions_pred - impressions_true) / abs(impressions_true) END, 6) AS impressions_ape,
 round(2 * abs(impressions_pred - impressions_true) / greatest(abs(impressions_true) + abs(impressions_pred), 1e-8), 6) AS impressions_sape FROM predicted""")
def row_errors(spark, sf):
    return metrics.row_errors(_predicted(spark, sf), ["impressions"], ["row_key"])


@query(f"""WITH {_PREDICTED} SELECT row_key, round(abs(clicks_pred - clicks_true), 6) AS clicks_abs_err FROM predicted
ORDER BY round(abs(clicks_pred - clicks_true), 6) DESC, row_key LIMIT 20""")
def top_errors(spark, sf):
    errors = metrics.row_errors(_predicted(spark, sf), ["clicks"], ["row_key"]).select("row_key", F.round("clicks_abs_err", 6).alias("clicks_abs_err"))
    return metrics.top_errors(errors, "clicks", 20, ["row_key"])


@query(f"""WITH {TYPED} SELECT business_type, round(quantile_cont(clicks / greatest(exp(ln(1 + impressions * 0.004)) - 1, 1e-12), 0.5), 6) AS smear FROM typed GROUP BY 1""")
def median_smear(spark, sf):
    rows = typed_ads(spark, sf).select("business_type", "clicks", F.log1p(F.col("impressions") * 0.004).alias("pred_log"))
    return metrics.median_smear(rows, "clicks", "pred_log", ["business_type"])


@query(f"""WITH {ADS} SELECT row_key, round(greatest(exp(ln(1 + impressions * 0.004)) - 1, 0) * 1.07, 5) AS level FROM ads""", digits=5)
def back_transform(spark, sf):
    return ad_rows(spark, sf).select("row_key", numeric.smeared_level(F.log1p(F.col("impressions") * 0.004), F.lit(1.07)).alias("level"))


# --------------------------------------------------------- prediction figures
@query(f"""WITH {ROLLUP}, k AS (SELECT campaign_id, impressions AS i, clicks AS c, actions AS a, reach AS r, conversion_value AS v, cost AS b,
 CASE WHEN campaign_id LIKE '%7' THEN 0 ELSE campaign_duration END AS d FROM campaigns)
SELECT campaign_id, round(b / i, 6) AS cost_per_impression, round(i / b, 6) AS impressions_per_dollar, round(i / nullif(d, 0), 4) AS impressions_per_day,
 round(b / c, 6) AS cost_per_click, round(c / b, 6) AS clicks_per_dollar, round(c / nullif(d, 0), 4) AS clicks_per_day,
 round(b / a, 6) AS cost_per_action, round(a / b, 6) AS actions_per_dollar, round(a / nullif(d, 0), 4) AS actions_per_day,
 r AS estimated_reach, round(r / b, 6) AS reach_per_dollar, round(r / nullif(d, 0), 4) AS reach_per_day, round(i / r, 6) AS frequency, round(r / i, 6) AS reach_efficiency,
 round(c / i, 6) AS click_through_rate, round(c / i * 100, 6) AS ctr_percentage,
 CASE WHEN c / i > 0.05 THEN 'Excellent' WHEN c / i > 0.02 THEN 'Good' WHEN c / i > 0.01 THEN 'Average' ELSE 'Below Average' END AS ctr_benchmark,
 round(a / c, 6) AS conversion_rate, round(a / c * 100, 6) AS conversion_rate_percentage,
 CASE WHEN v > 0 THEN round(v / a, 4) END AS value_per_conversion, CASE WHEN v > 0 THEN round(a / b, 6) END AS conversions_per_dollar,
 CASE WHEN v > 0 THEN round(v / b, 6) END AS return_on_ad_spend, CASE WHEN v > 0 THEN round(v / b * 100, 6) END AS roas_percentage,
 CASE WHEN v > 0 THEN CASE WHEN v / b > 4 THEN 'Excellent' WHEN v / b > 2 THEN 'Good' WHEN v / b > 1 THEN 'Break-even' ELSE 'Loss' END END AS roas_benchmark,
 CASE WHEN i / r > 3 THEN 'High (may cause fatigue)' WHEN i / r > 1.5 THEN 'Optimal' ELSE 'Low (may need more exposure)' END AS frequency_benchmark FROM k""")
def kpi_block(spark, sf):
    c = F.col
    days = F.when(c("campaign_id").endswith("7"), 0).otherwise(c("campaign_duration"))
    blocks = kpi.performance_estimates(c("impressions"), c("clicks"), c("actions"), c("reach"), c("conversion_value"), c("cost"), days)
    rows = campaign.campaign_table(ad_rows_with_copies(spark, sf), SEGMENT_MAPPING)
    coarse = {"impressions_per_day", "clicks_per_day", "actions_per_day", "reach_per_day", "value_per_conversion"}
    figures = {n: F.round(e, 4) if n in coarse else e for block in blocks.values() for n, e in block.items()}
    return rows.select("campaign_id", *[e.alias(n) for n, e in figures.items()])


@query(f"""WITH {ADS}, p AS (SELECT row_key, clicks, level, clicks AS pred, 35.5 * CASE level WHEN 0.68 THEN 1 WHEN 0.95 THEN 2 WHEN 0.99 THEN 3 ELSE 2 * level / 0.95 END AS margin
 FROM ads, (SELECT unnest([0.68, 0.95, 0.99, 0.5]) AS level)) SELECT row_key, CAST(level AS DOUBLE) AS confidence_level, round(greatest(pred - margin, 0), 6) AS lower_bound,
 round(pred + margin, 6) AS upper_bound, round(margin, 6) AS margin FROM p""")
def prediction_ranges(spark, sf):
    ranges = F.array(*[kpi.prediction_range(F.col("clicks"), F.lit(35.5), level) for level in (0.68, 0.95, 0.99, 0.5)])
    return ad_rows(spark, sf).select("row_key", F.inline(ranges))


@query(f"""WITH {ADS}, p AS (SELECT row_key, clicks * 60 AS clicks_pred, ln(1 + clicks * 60) + CASE WHEN line_number = 7 THEN 9 ELSE 0 END AS lp FROM ads)
SELECT row_key, CASE WHEN clicks_pred > 12500 THEN 'Clicks/budget ratio too high: ' || printf('%.1f', clicks_pred / 250) || ' clicks per dollar (expected < 50)'
 WHEN NOT (lp >= -3 AND lp <= 14) THEN 'Log prediction outside normal range' END AS warning,
 round(greatest(exp(greatest(least(lp, 12), -1)) - 1, 0), 4) AS level, abs(lp - greatest(least(lp, 12), -1)) > 0.1 AS clamped FROM p""")
def plausibility(spark, sf):
    pred = F.col("clicks") * 60
    lp = F.log1p(pred) + F.when(F.col("line_number") == 7, 9).otherwise(0)
    return ad_rows(spark, sf).select(
        "row_key", kpi.prediction_warning(pred, lp, "clicks").alias("warning"),
        F.round(kpi.bounded_level(lp, "clicks"), 4).alias("level"), kpi.was_clamped(lp, "clicks").alias("clamped"),
    )


@query(f"""WITH {TYPED}, r AS (SELECT business_type, avg(clicks) / 1000 AS r2 FROM typed GROUP BY 1)
SELECT business_type, round(r2, 6) AS r2, CASE WHEN r2 > 0.3 THEN 'High' WHEN r2 > 0.15 THEN 'Medium' ELSE 'Low' END AS reliability FROM r""")
def reliability(spark, sf):
    rows = typed_ads(spark, sf).groupBy("business_type").agg((F.avg("clicks") / 1000).alias("r2"))
    return rows.withColumn("reliability", kpi.reliability(F.col("r2")))


# ------------------------------------------------------------------- ensembles
_MODELS = {"a": "ln(1 + reach) + 0.3", "b": "ln(1 + impressions) - 0.1", "c": "ln(1 + clicks)"}
_BASE = f"""{ADS}, base AS (SELECT row_key, ln(1 + impressions) AS y, {", ".join(f"{e} AS pred_{m}" for m, e in _MODELS.items())},
 CAST(floor({_share('row_key')} * 5) AS INTEGER) AS fold FROM ads)"""


def _base_predictions(spark, sf):
    c = F.col
    return ad_rows(spark, sf).select(
        "row_key", F.log1p("impressions").alias("y"), (F.log1p("reach") + 0.3).alias("pred_a"),
        (F.log1p("impressions") - 0.1).alias("pred_b"), F.log1p(c("clicks")).alias("pred_c"), models.fold_of("row_key").alias("fold"),
    )


@query(f"WITH {_BASE} SELECT row_key, round((pred_a + pred_b + pred_c) / 3, 6) AS pred FROM base")
def voting(spark, sf):
    return _base_predictions(spark, sf).select("row_key", models.voting(["a", "b", "c"]).alias("pred"))


@query(f"""WITH {_BASE}, w AS (SELECT {", ".join(f"greatest(0, 1 - avg((y - pred_{m}) * (y - pred_{m})) / var_pop(y)) AS w_{m}" for m in _MODELS)} FROM base)
SELECT row_key, round((w_a * pred_a + w_b * pred_b + w_c * pred_c) / (w_a + w_b + w_c), 6) AS pred FROM base, w""")
def weighted_voting(spark, sf):
    base = stored(_base_predictions(spark, sf))
    scores = base.agg(*[metrics.metric_columns(F.col("y"), F.col(f"pred_{m}"))["r2"].alias(m) for m in _MODELS]).first().asDict()
    return base.select("row_key", models.weighted_voting(models.voting_weights(scores)).alias("pred"))


@query(f"""WITH {_BASE}, m AS (SELECT count(*) AS n, avg(pred_a) AS mx, avg(y) AS my, var_pop(pred_a) AS vx, covar_pop(pred_a, y) AS cxy FROM base),
w AS (SELECT n * cxy / (n * vx + 1.0) AS w, mx, my FROM m) SELECT row_key, round(my - w * mx + w * pred_a, 6) AS pred FROM base, w""")
def ridge_closed_form(spark, sf):
    base = stored(_base_predictions(spark, sf))
    weights, intercept = models.ridge_coefficients(base, ["pred_a"], "y")[None]
    return base.select("row_key", models.linear_column(["pred_a"], weights, intercept).alias("pred"))


@query()
def stacking(spark, sf):
    base = stored(_base_predictions(spark, sf))
    stack = models.fit_stack(base, ["a", "b", "c"], "y", fold="fold")
    return base.select("row_key", stack.column().alias("pred"), stack.honest_column("fold").alias("pred_out_of_fold"))


# ----------------------------------------------------------- comparison tables
_FORMULAS = [("ridge", "individual", 0.90), ("boosted_depth", "individual", 1.05), ("ensemble_voting", "ensemble", 0.98), ("ensemble_stacking", "ensemble", 1.01)]


def _metrics_table(spark, sf):
    """``model_metrics`` of formula models for two targets over the ad rows."""
    c = F.col
    halves = F.when(F.col("line_number") <= 3, "val").otherwise("test")
    cells = F.array(
        *[F.struct(F.lit(t).alias("target"), F.lit(m).alias("model"), F.lit(k).alias("type"), F.log1p(c(t)).alias("y"), (F.log1p(c(x)) * f + b).alias("p"))
          for t, x, b in (("impressions", "reach", 0.3), ("clicks", "impressions", -4.5)) for m, k, f in _FORMULAS]
    )
    rows = ad_rows(spark, sf).select(halves.alias("split"), F.explode(cells).alias("_c")).select("split", "_c.*")
    return metrics.evaluate_log(rows, "y", "p", ["target", "model", "type", "split"]).drop("n")


_MM = f"""{ADS}, f(model, type, f) AS (VALUES {", ".join(str(x) for x in _FORMULAS)}),
p AS (SELECT 'impressions' AS target, model, type, CASE WHEN line_number <= 3 THEN 'val' ELSE 'test' END AS split, ln(1 + impressions) AS y, ln(1 + reach) * f + 0.3 AS p FROM ads, f
 UNION ALL SELECT 'clicks', model, type, CASE WHEN line_number <= 3 THEN 'val' ELSE 'test' END, ln(1 + clicks), ln(1 + impressions) * f - 4.5 FROM ads, f),
s AS (SELECT target, model, type, split, 'log' AS scale, y, p FROM p UNION ALL SELECT target, model, type, split, 'orig', exp(y) - 1, exp(p) - 1 FROM p),
mm AS (SELECT target, model, type, split, scale, {_METRICS} FROM s GROUP BY ALL),
best AS (SELECT target, model, r2 AS val_r2 FROM mm WHERE split = 'val' AND scale = 'log' QUALIFY row_number() OVER (PARTITION BY target ORDER BY r2 DESC, model) = 1)"""


@query(f"WITH {_MM} SELECT target, model, type, r2 AS val_r2, mae AS val_mae FROM mm WHERE split = 'val' AND scale = 'log'")
def model_comparison(spark, sf):
    return reports.model_comparison(_metrics_table(spark, sf))


@query(f"""WITH {_MM} SELECT best.target, best.model, val_r2, r2 AS test_r2 FROM best JOIN mm ON best.target = mm.target AND best.model = mm.model
WHERE split = 'test' AND scale = 'log'""")
def best_summary(spark, sf):
    return reports.best_summary(_metrics_table(spark, sf))


@query(f"""WITH {_MM}, raw AS (SELECT target, model, type, 1 - avg((y - p) * (y - p)) / var_pop(y) AS r2 FROM p WHERE split = 'val' GROUP BY ALL),
i AS (SELECT target, model, r2 FROM raw WHERE type = 'individual' QUALIFY row_number() OVER (PARTITION BY target ORDER BY r2 DESC, model) = 1),
e AS (SELECT target, model, r2 FROM raw WHERE type = 'ensemble' QUALIFY row_number() OVER (PARTITION BY target ORDER BY r2 DESC, model) = 1)
SELECT i.target, round(i.r2, 6) AS best_individual, i.model AS best_individual_name, round(e.r2, 6) AS best_ensemble, e.model AS best_ensemble_name,
 round((e.r2 - i.r2) / abs(i.r2) * 100, 4) AS improvement_pct FROM i JOIN e ON i.target = e.target""")
def ensemble_delta(spark, sf):
    out = reports.ensemble_delta(_metrics_table(spark, sf))
    return out.withColumn("improvement_pct", F.round("improvement_pct", 4))


@query(f"""WITH {_MM}, b AS (SELECT mm.* FROM mm JOIN best ON mm.target = best.target AND mm.model = best.model)
SELECT target, model AS best_model, max(r2) FILTER (split = 'val' AND scale = 'log') AS val_r2_log, max(r2) FILTER (split = 'test' AND scale = 'log') AS test_r2_log,
 max(r2) FILTER (split = 'val' AND scale = 'orig') AS val_r2_orig, max(r2) FILTER (split = 'test' AND scale = 'orig') AS test_r2_orig,
 max(wape) FILTER (split = 'val' AND scale = 'orig') AS val_wape_orig, max(wape) FILTER (split = 'test' AND scale = 'orig') AS test_wape_orig,
 max(smape) FILTER (split = 'val' AND scale = 'orig') AS val_smape_orig, max(smape) FILTER (split = 'test' AND scale = 'orig') AS test_smape_orig
FROM b GROUP BY target, model""")
def metrics_by_target(spark, sf):
    return reports.metrics_by_target(_metrics_table(spark, sf))


@query(f"WITH {_MM} SELECT model, count(*) AS n_targets FROM best GROUP BY model")
def winner_counts(spark, sf):
    return reports.winner_counts(_metrics_table(spark, sf))
