"""Dates, numeric expressions, the feature table, encoding and scaling."""

from __future__ import annotations

from pyspark.sql import functions as F

from adlumen import names
from adlumen.functions import dates, numeric
from adlumen.operators import columns, encode, profile, ranking, scale
from adlumen.plans import features as plan
from adlumen.queries.registry import ADS, TYPE, TYPED, query
from adlumen.queries.relational import typed_ads
from adlumen.sources.adapters import SEGMENT_MAPPING, ad_rows, table
from adlumen.sources.session import stored

_PI2 = "(2 * pi())"


def _calendar_sql(prefix: str, d: str, dow_base: int = 0) -> list[tuple[str, str]]:
    dow = f"(isodow({d}) - 1 + {dow_base})"
    length = f"day(last_day({d}))"
    out = {
        "month": f"month({d})", "year4": f"year({d})", "dow": dow, "weekofyear": f"weekofyear({d})", "doy": f"dayofyear({d})",
        "days_in_month": length, "dom": f"day({d})", "month_progress": f"round((day({d}) - 1) / {length}, 6)",
        "quarter": f"quarter({d})", "is_weekend": f"CAST({dow} >= 5 AS INTEGER)", "is_month_start": f"CAST(day({d}) = 1 AS INTEGER)",
        "is_month_end": f"CAST(day({d}) = {length} AS INTEGER)",
    }
    for part, x, period in (("month", f"month({d})", 12), ("dow", dow, 7), ("doy", f"dayofyear({d})", 366)):
        for f in ("sin", "cos"):
            out[f"{part}_{f}"] = f"round({f}({_PI2} * {x} / {period}), 6)"
    return [(f"{prefix}_{k}", v) for k, v in out.items()]


def _list(items) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in items)


_DURATIONS = """CAST(coalesce(greatest(ad_group_end_date - ad_group_start_date, 0), 0) AS BIGINT) AS ad_group_duration,
 CAST(coalesce(greatest(campaign_end_date - campaign_start_date, 0), 0) AS BIGINT) AS campaign_duration"""
_RELATIONS = [
    ("adg_start_minus_camp_start_days", "CAST(ad_group_start_date - campaign_start_date AS BIGINT)"),
    ("camp_end_minus_adg_end_days", "CAST(campaign_end_date - ad_group_end_date AS BIGINT)"),
    ("adg_start_offset_days", "CAST(greatest(ad_group_start_date - campaign_start_date, 0) AS BIGINT)"),
    ("adg_end_offset_days", "CAST(greatest(campaign_end_date - ad_group_end_date, 0) AS BIGINT)"),
    ("adg_inside_campaign", "CAST(ad_group_start_date >= campaign_start_date AND ad_group_end_date <= campaign_end_date AS INTEGER)"),
    ("adg_duration_ratio", "round(ad_group_duration / greatest(campaign_duration, 1), 6)"),
]
_MIDPOINTS = [
    (f"{p}_mid_month_{f}", f"round({f}({_PI2} * month({start} + CAST({dur} // 2 AS INTEGER)) / 12), 6)")
    for p, start, dur in (("adg", "ad_group_start_date", "ad_group_duration"), ("camp", "campaign_start_date", "campaign_duration"))
    for f in ("sin", "cos")
]
# Quotients of decimal prices can end in an exact 5, which engines round either
# way; both sides are lifted off the tie.
_LIFT = 1e-9
_COST = [
    ("adg_cost_per_day", f"round(cost / greatest(ad_group_duration, 1) + {_LIFT}, 6)"),
    ("camp_cost_per_day", f"round(cost / greatest(campaign_duration, 1) + {_LIFT}, 6)"),
]
_CROSS = [
    (f"cost_x_{p}_start_month_{f}", f"round(ln(1 + greatest(cost, 0)) * {f}({_PI2} * month({d}) / 12), 6)")
    for p, d in (("adg", "ad_group_start_date"), ("camp", "campaign_start_date")) for f in ("sin", "cos")
]
_TARGETS = [(t, f"round(ln(1 + greatest({t.removesuffix('_log1p')}, 0)), 6)") for t in names.LOG_TARGETS]


def _norm_sql(c: str) -> str:
    return f"coalesce(trim(regexp_replace(lower({c}), '\\s+', ' ', 'g')), 'unknown')"


_CATEGORIES = [
    ("campaign_objective_norm", _norm_sql("campaign_objective")), ("cta_type_norm", _norm_sql("creative_call_to_action_type")),
    ("impression_device_norm", _norm_sql("impression_device")), ("business_type", TYPE),
]
_CALENDAR = [
    x for p, d in (("adg_start", "ad_group_start_date"), ("adg_end", "ad_group_end_date"), ("camp_start", "campaign_start_date"),
                   ("camp_end", "campaign_end_date")) for x in _calendar_sql(p, d)
]
_DATED = f"{ADS}, dated AS (SELECT *, {_DURATIONS} FROM ads)"
FEATURE_SQL = (
    f"{_DATED}, features AS (SELECT row_key, ad_group_duration, campaign_duration, "
    + _list(_CALENDAR + _RELATIONS + _MIDPOINTS + _COST + _CROSS + _CATEGORIES + _TARGETS) + ", round(cost, 6) AS cost FROM dated)"
)


# ----------------------------------------------------------------------- dates
@query(f"WITH {ADS} SELECT row_key, {_list(_calendar_sql('d', 'ad_group_end_date'))} FROM ads")
def time_block(spark, sf):
    return ad_rows(spark, sf).select("row_key", *[e.alias(n) for n, e in dates.time_block("d", F.col("ad_group_end_date")).items()])


@query(f"WITH {ADS} SELECT row_key, {_list(_calendar_sql('d', 'campaign_start_date', 1))} FROM ads")
def time_block_iso_days(spark, sf):
    block = dates.time_block("d", F.col("campaign_start_date"), dow_base=1)
    return ad_rows(spark, sf).select("row_key", *[e.alias(n) for n, e in block.items()])


@query(f"WITH {_DATED} SELECT row_key, ad_group_duration, campaign_duration, {_list(_RELATIONS)} FROM dated")
def date_relations(spark, sf):
    df = plan.with_relations(plan.with_durations(plan.with_anchors(ad_rows(spark, sf))))
    return df.select("row_key", "ad_group_duration", "campaign_duration", *names.RELATION_FEATURES)


@query(f"WITH {_DATED} SELECT row_key, {_list(_MIDPOINTS)} FROM dated")
def midpoint_cycles(spark, sf):
    df = plan.with_relations(plan.with_durations(plan.with_anchors(ad_rows(spark, sf))))
    return df.select("row_key", *names.MIDPOINT_FEATURES)


_SPELLINGS = ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%Y/%m/%d", "%d-%m-%Y"]


@query(f"""WITH t AS (SELECT o_orderkey, CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y')
 WHEN 2 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 3 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 4 THEN strftime(o_orderdate, '%d-%m-%Y')
 WHEN 5 THEN 'soon' ELSE strftime(o_orderdate, '%-d/%-m/%Y') END AS txt FROM orders)
SELECT o_orderkey, CAST(coalesce({", ".join(f"try_strptime(txt, '{f}')" for f in _SPELLINGS)}) AS DATE) AS parsed FROM t""")
def multi_format_dates(spark, sf):
    kind, day = F.col("o_orderkey") % 7, F.col("o_orderdate")
    out = F.when(kind == 5, "soon")
    for i, f in enumerate(["yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy/MM/dd", "dd-MM-yyyy"]):
        out = out.when(kind == i, F.date_format(day, f))
    spelled = out.otherwise(F.date_format(day, "d/M/yyyy"))
    return table(spark, sf, "orders").select("o_orderkey", dates.parse_any_date(spelled).alias("parsed"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS day,
 CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE epoch(CAST(o_orderdate AS DATE)) END::BIGINT AS seconds FROM orders""")
def lenient_dates(spark, sf):
    shown = F.when(F.col("o_orderkey") % 3 == 0, "unknown day").otherwise(F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T00:00:00+07")))
    stamp = dates.parse_datetime(shown)
    return table(spark, sf, "orders").select(
        "o_orderkey", dates.to_date(stamp).alias("day"), F.coalesce(F.unix_seconds(stamp), F.lit(0)).alias("seconds")
    )


# --------------------------------------------------------------------- numeric
@query(f"""WITH {_DATED} SELECT row_key, round(clicks / greatest(impressions, 1e-9) + {_LIFT}, 6) AS ctr, round(actions / greatest(clicks, 1e-9) + {_LIFT}, 2) AS cvr,
 round(cost / greatest(impressions / 1000.0, 1e-9) + {_LIFT}, 6) AS cpm, round(cost / greatest(clicks, 1e-9) + {_LIFT}, 2) AS cpc,
 round(conversion_value / greatest(cost, 1e-9) + {_LIFT}, 2) AS roas, round(cost / greatest(conversion_value, 1e-9) + {_LIFT}, 2) AS acos, {_list(_COST)} FROM dated""")
def efficiency_ratios(spark, sf):
    df = plan.with_durations(plan.with_anchors(ad_rows(spark, sf)))
    ratios = numeric.efficiency_ratios()
    # Ratios over the floor reach 1e13, where six decimals are noise.
    coarse = {n: F.round(e + _LIFT, 6 if n in ("ctr", "cpm") else 2) for n, e in ratios.items()}
    per_day = {n: e + _LIFT for n, e in numeric.cost_per_day().items()}
    return df.select("row_key", *[e.alias(n) for n, e in {**coarse, **per_day}.items()])


@query(f"""WITH {ADS} SELECT row_key, {_list(_TARGETS)}, round(exp(ln(1 + reach)) - 1, 4) AS reach_back,
 round(CASE WHEN clicks - 100 >= 0 THEN ln(1 + clicks - 100) END, 6) AS shifted FROM ads""")
def log_targets(spark, sf):
    logs = numeric.log_targets([t.removesuffix("_log1p") for t in names.LOG_TARGETS])
    return ad_rows(spark, sf).select(
        "row_key", *[e.alias(n) for n, e in logs.items()],
        F.round(numeric.inverse_log(numeric.log1p_safe(F.col("reach"))), 4).alias("reach_back"),
        numeric.log1p_or_null(F.col("clicks") - 100).alias("shifted"),
    )


@query(f"WITH {_DATED} SELECT row_key, {_list(_CROSS)} FROM dated")
def cost_interactions(spark, sf):
    df = plan.with_calendar(plan.with_durations(plan.with_anchors(ad_rows(spark, sf))))
    return df.select("row_key", *[e.alias(n) for n, e in numeric.cost_interactions().items()])


@query(f"WITH {FEATURE_SQL} SELECT * FROM features")
def ad_features(spark, sf):
    df = plan.ad_features(ad_rows(spark, sf), SEGMENT_MAPPING, keep=["row_key"])
    return df.withColumns({c: F.col(c) + _LIFT for c in ("adg_cost_per_day", "camp_cost_per_day")})


# -------------------------------------------------------------------- encoding
_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_TYPES = ["industrial_manufacturing", "other", "real_estate", "retail_brand", "unknown"]


@query(f"""WITH {TYPED} SELECT row_key, {", ".join(f'''CAST(business_type = '{t}' AS INTEGER) AS "business_type_{t}"''' for t in _TYPES)},
 {", ".join(f'''CAST(campaign_objective = '{p}' AS INTEGER) AS "campaign_objective_{p}"''' for p in _PRIORITIES)} FROM typed""")
def one_hot(spark, sf):
    rows = stored(typed_ads(spark, sf).select("row_key", "business_type", "campaign_objective"))
    vocabulary, _ = encode.learn_vocabulary(rows, ["business_type", "campaign_objective"])
    return encode.one_hot(rows, vocabulary)


@query(f"""WITH {TYPED} SELECT row_key, {", ".join(f"CAST(business_type = '{t}' AS DOUBLE) AS business_type_{t}" for t in names.SCORING_VOCABULARY["business_type"])} FROM typed""")
def one_hot_fixed(spark, sf):
    rows = typed_ads(spark, sf).select("row_key", "business_type")
    return encode.one_hot_fixed(rows, {"business_type": names.SCORING_VOCABULARY["business_type"]})


@query(f"""WITH {TYPED} SELECT row_key, {", ".join(f"CAST(business_type = '{t}' AS DOUBLE) AS bt_{t}" for t in _TYPES if t != "unknown")},
 CAST(business_type = 'unknown' AS DOUBLE) AS "bt_None" FROM typed""")
def dummies(spark, sf):
    rows = typed_ads(spark, sf).select("row_key", F.nullif("business_type", F.lit("unknown")).alias("business_type"))
    return encode.dummies(rows, "business_type", "bt").drop("business_type")


@query(f"WITH {ADS} SELECT row_key, clicks, 0.0::DOUBLE AS absent, round(cost, 6) AS cost, actions FROM ads")
def fill_to_features(spark, sf):
    return columns.fill_to_features(ad_rows(spark, sf), ["clicks", "absent", "cost", "actions"], ["row_key"])


# --------------------------------------------------------------------- scaling
@query(f"""WITH {ADS} SELECT 'cost' AS "column", round(avg(cost), 6) AS mean, round(stddev_samp(cost), 6) AS std FROM ads
 UNION ALL SELECT 'clicks', round(avg(clicks), 6), round(stddev_samp(clicks), 6) FROM ads""")
def column_moments(spark, sf):
    return profile.column_moments(ad_rows(spark, sf), ["cost", "clicks"])


@query(f"""WITH {ADS}, m AS (SELECT avg(cost) AS a, stddev_samp(cost) AS s, avg(clicks) AS b, stddev_samp(clicks) AS t FROM ads)
SELECT row_key, round((cost - a) / s, 6) AS cost, round((clicks - b) / t, 6) AS clicks, 1 AS constant FROM ads, m""")
def standardize(spark, sf):
    rows = stored(ad_rows(spark, sf).select("row_key", "cost", "clicks", F.lit(1).alias("constant")))
    return scale.apply_standard(rows, scale.fit_standard(rows, ["cost", "clicks", "constant"]))


@query(f"""WITH {TYPED}, z AS (SELECT row_key, abs(cost) AS a, abs(clicks) AS b, abs(actions / 10) AS c FROM typed)
SELECT row_key, CAST((a <> 0)::INT + (b <> 0)::INT + (c <> 0)::INT AS INTEGER) AS non_zero, round((a + b + c) / 3, 6) AS mean_abs,
 round(greatest(a, b, c), 6) AS max_abs, (a + b + c) / 3 < 2 AND greatest(a, b, c) < 10 AS looks_scaled FROM z""")
def scale_check(spark, sf):
    rows = ad_rows(spark, sf).select("row_key", "cost", "clicks", (F.col("actions") / 10).alias("actions"))
    return scale.scale_check(rows, ["cost", "clicks", "actions"], ["row_key"])


@query(f"""WITH {ADS}, m AS (SELECT avg(cost) AS a, stddev_samp(cost) AS s FROM ads), z AS (SELECT abs((cost - a) / s) AS z FROM ads, m)
SELECT 'cost' AS "column", count(*) AS n_extreme, round(max(z), 6) AS max_abs_z FROM z WHERE z > 2.5""")
def extreme_values(spark, sf):
    rows = ad_rows(spark, sf).select("cost")
    return scale.extreme_values(scale.apply_standard(rows, scale.fit_standard(rows, ["cost"])), ["cost"], 2.5)


@query(f"""WITH {ADS}, q AS (SELECT quantile_cont(cost, [0.25, 0.5, 0.75]) AS c, quantile_cont(clicks, [0.25, 0.5, 0.75]) AS k FROM ads)
SELECT 'cost' AS "column", unnest([0.25, 0.5, 0.75]) AS prob, round(unnest(c), 6) AS value FROM q
UNION ALL SELECT 'clicks', unnest([0.25, 0.5, 0.75]), round(unnest(k), 6) FROM q""")
def quantiles(spark, sf):
    return ranking.quantiles(ad_rows(spark, sf).select("cost", "clicks"), ["cost", "clicks"], [0.25, 0.5, 0.75])


@query(f"""WITH {TYPED} SELECT business_type, 'cost' AS "column", unnest([0.05, 0.5]) AS prob, round(unnest(quantile_cont(cost, [0.05, 0.5])), 6) AS value
FROM typed GROUP BY business_type""")
def quantiles_narrowed(spark, sf):
    """The path for groups too large for one task, forced by ``small=0``."""
    rows = typed_ads(spark, sf).select("business_type", "cost")
    return ranking.quantiles(rows, ["cost"], [0.05, 0.5], ["business_type"], small=0)


@query(f"""WITH {ADS}, q AS (SELECT quantile_cont(cost, [0.25, 0.5, 0.75]) AS c, quantile_cont(actions, [0.25, 0.5, 0.75]) AS k FROM ads)
SELECT row_key, round((cost - c[2]) / (c[3] - c[1]), 6) AS cost, round((actions - k[2]) / (k[3] - k[1]), 6) AS actions FROM ads, q""")
def robust_scale(spark, sf):
    return scale.robust_scale(ad_rows(spark, sf).select("row_key", "cost", "actions"), ["cost", "actions"])


@query(f"""WITH {TYPED}, v AS (SELECT row_key, business_type, CASE WHEN line_number <> 3 THEN cost END AS cost FROM typed),
m AS (SELECT business_type, quantile_cont(cost, 0.5) AS med FROM v GROUP BY 1)
SELECT row_key, v.business_type, round(coalesce(cost, med), 6) AS cost FROM v JOIN m ON v.business_type = m.business_type""")
def median_impute(spark, sf):
    rows = typed_ads(spark, sf).select("row_key", "business_type", F.when(F.col("line_number") != 3, F.col("cost")).alias("cost"))
    return scale.median_impute(rows, ["cost"], ["business_type"])


@query(f"""WITH {ADS}, v AS (SELECT row_key, ln(1 + cost) AS c, CASE WHEN actions - 5 >= 0 THEN actions - 5 END AS a FROM ads),
w AS (SELECT row_key, c, coalesce(a, (SELECT quantile_cont(a, 0.5) FROM v)) AS a FROM v),
q AS (SELECT quantile_cont(c, [0.25, 0.5, 0.75]) AS qc, quantile_cont(a, [0.25, 0.5, 0.75]) AS qa FROM w)
SELECT row_key, round((c - qc[2]) / (qc[3] - qc[1]), 6) AS cost_log1p, round((a - qa[2]) / (qa[3] - qa[1]), 6) AS shifted FROM w, q""")
def feature_matrix(spark, sf):
    rows = ad_rows(spark, sf).select("row_key", "cost", (F.col("actions") - 5).alias("shifted"))
    matrix, _ = scale.feature_matrix(rows, ["shifted", "cost"], ["cost"], keep=["row_key"])
    return matrix
