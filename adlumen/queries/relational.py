"""Sources, columns, duplicates, joins, unions, roll-up and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from adlumen import names
from adlumen.functions import classify as kw, text
from adlumen.operators import columns, dedupe, joins, masks, metrics, profile, rollup
from adlumen.plans import campaign
from adlumen.queries.registry import ADS, COPIES, DISTINCT, ROLLUP, SQUEEZED, TYPED, query
from adlumen.sources import extract, merge, scan
from adlumen.sources.adapters import SEGMENT_MAPPING, ad_rows, ad_rows_with_copies, table
from adlumen.sources.session import stored
from adlumen.sources.stages import removal_report as stage_report

# Nested names, so that a row can belong to two companies.
COMPANIES = [("build", "other"), ("building", "real_estate"), ("furn", "retail_brand"), ("machinery", "industrial_manufacturing")]


def typed_ads(spark, sf):
    return ad_rows(spark, sf).withColumn("business_type", kw.classify(text.squeeze(F.col("profile")), SEGMENT_MAPPING))


# --------------------------------------------------------------------- sources
@query(f"""WITH {ADS}
SELECT dt, count(*) AS n_rows, round(sum(cost), 4) AS cost FROM ads
WHERE dt BETWEEN '19950601' AND '19961231' GROUP BY dt""", digits=4)
def date_shard_scan(spark, sf):
    rows = scan.between_shards(ad_rows(spark, sf), "19950601", "19961231")
    return rows.groupBy("dt").agg(F.count("*").alias("n_rows"), F.sum("cost").alias("cost"))


_COMPANY_SQL = """CASE WHEN lower(profile) LIKE 'machinery%' THEN 'machinery' WHEN lower(profile) LIKE 'building%' THEN 'building'
 WHEN lower(profile) LIKE 'build%' THEN 'build' WHEN lower(profile) LIKE 'furn%' THEN 'furn' END"""
_COMPANY_TYPE_SQL = "CASE company WHEN 'machinery' THEN 'industrial_manufacturing' WHEN 'building' THEN 'real_estate' WHEN 'build' THEN 'other' ELSE 'retail_brand' END"


@query(f"""WITH {ADS}
SELECT company, {_COMPANY_TYPE_SQL} AS business_type,
       'ads/' || {_COMPANY_TYPE_SQL} || '/' || company || '_profile_19950101_19961231' AS prefix,
       row_key, round(cost, 6) AS cost
FROM (SELECT *, {_COMPANY_SQL} AS company FROM ads WHERE dt BETWEEN '19950101' AND '19961231') WHERE company IS NOT NULL""")
def entity_extract(spark, sf):
    start, end = "19950101", "19961231"
    rows = extract.assign_companies(scan.between_shards(ad_rows(spark, sf), start, end), COMPANIES)
    placed = extract.with_export_prefix(rows, "ads", start, end, group_by_type=True)
    return placed.select("company", "business_type", "prefix", "row_key", "cost")


@query(f"""WITH {ADS}, companies(company, business_type) AS (VALUES ('build','other'), ('building','real_estate'),
 ('furn','retail_brand'), ('machinery','industrial_manufacturing'))
SELECT company, business_type, count(*) AS n_rows FROM ads JOIN companies
 ON lower(profile) LIKE company || '%' OR lower(profile) LIKE '|' || company || '%' GROUP BY ALL""")
def entity_extract_all(spark, sf):
    return extract.company_counts(ad_rows(spark, sf), COMPANIES, mode="all")


@query(f"""WITH {ADS}
SELECT company, {_COMPANY_TYPE_SQL} AS business_type, count(*) AS n_rows
FROM (SELECT {_COMPANY_SQL} AS company FROM ads) WHERE company IS NOT NULL GROUP BY ALL""")
def entity_counts(spark, sf):
    return extract.company_counts(ad_rows(spark, sf), COMPANIES)


@query("""SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, round(CAST(o_totalprice AS DOUBLE), 2) AS o_totalprice, o_orderpriority, o_custkey
FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT o_orderkey, round(o_totalprice, 2), NULL, NULL FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT o_orderkey, CAST(floor(o_totalprice) AS DOUBLE), o_orderpriority, o_custkey FROM orders WHERE o_orderstatus = 'P'""", digits=2)
def schema_union(spark, sf):
    orders = table(spark, sf, "orders")
    whole = orders.filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_custkey")
    missing = orders.filter("o_orderstatus = 'O'").select("o_orderkey", "o_totalprice")
    drifted = orders.filter("o_orderstatus = 'P'").select(
        F.col("o_orderkey").cast("int").alias("o_orderkey"), F.floor("o_totalprice").cast("int").alias("o_totalprice"),
        "o_orderpriority", "o_custkey",
    )
    return merge.union_relaxed([whole, missing, drifted])


@query("""SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_totalprice AS DOUBLE) AS v FROM orders
UNION ALL SELECT CAST(c_custkey AS BIGINT), CAST(c_nationkey AS DOUBLE) FROM customer""", digits=4)
def union_relaxed(spark, sf):
    a = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    b = table(spark, sf, "customer").select(F.col("c_custkey").cast("int").alias("k"), F.col("c_nationkey").alias("v"))
    return merge.union_relaxed([a, b])


# --------------------------------------------------------------------- columns
def _aliased(spark, sf):
    """Ad rows under the spellings other exports use."""
    return ad_rows(spark, sf).select(
        F.col("campaign_id").alias("Campaign ID"), F.col("ad_group_id").alias("adset_id"),
        F.col("cost").alias("Amount  Spent"), F.col("impressions").alias("IMPRESSIONS"),
        F.col("reach").alias("unique_impressions"), F.col("clicks").alias("Link Clicks"),
        F.col("profile").alias("account_name"), F.col("row_key").alias("extra"),
    )


@query(f"""WITH {ADS} SELECT campaign_id, ad_group_id, round(cost, 6) AS cost, impressions, reach, clicks, profile, row_key AS extra FROM ads""")
def rename_by_alias(spark, sf):
    return columns.require_columns(columns.rename_by_alias(_aliased(spark, sf)), ["campaign_id", "ad_group_id"])


@query(f"""WITH {ADS} SELECT campaign_id, ad_group_id, impressions, reach, clicks, round(cost, 6) AS cost, profile FROM ads""")
def keep_if_present(spark, sf):
    kept, _ = columns.keep_present(columns.rename_by_alias(_aliased(spark, sf)), list(names.COLUMN_ALIASES))
    return kept


@query("""SELECT o_totalprice, o_orderkey, o_custkey, o_orderpriority FROM orders""", digits=4)
def reorder_columns(spark, sf):
    return columns.reorder(table(spark, sf, "orders"), ["o_totalprice", "o_orderkey"], ["o_orderdate", "o_orderstatus"])


_DIRTY_SQL = f"""WITH {ADS}, dirty AS (
  SELECT row_key, CASE WHEN line_number = 1 THEN 'n/a' WHEN line_number = 2 THEN '-' || CAST(clicks AS VARCHAR) ELSE CAST(clicks AS VARCHAR) END AS clicks,
         CASE WHEN line_number = 3 THEN NULL ELSE impressions END AS impressions, cost FROM ads)"""


def _dirty(spark, sf):
    c, line = F.col, F.col("line_number")
    whole = c("clicks").cast("string")
    clicks = F.when(line == 1, "n/a").when(line == 2, F.concat(F.lit("-"), whole)).otherwise(whole)
    return ad_rows(spark, sf).select(
        "row_key", clicks.alias("clicks"), F.when(line != 3, c("impressions")).alias("impressions"), "cost"
    )


@query(_DIRTY_SQL + " SELECT row_key, TRY_CAST(clicks AS DOUBLE) AS clicks, impressions, round(cost, 6) AS cost FROM dirty")
def clean_numeric(spark, sf):
    return columns.clean_numbers(_dirty(spark, sf), ["clicks", "impressions", "cost"])


@query(_DIRTY_SQL + """ SELECT row_key, greatest(coalesce(TRY_CAST(clicks AS DOUBLE), 0), 0) AS clicks,
 greatest(coalesce(impressions, 0), 0) AS impressions, round(cost, 6) AS cost FROM dirty""")
def fill_and_clip(spark, sf):
    return columns.fill_and_clip(_dirty(spark, sf), ["clicks", "impressions", "cost"])


@query(_DIRTY_SQL + """ SELECT row_key, CASE WHEN TRY_CAST(clicks AS DOUBLE) >= 0 THEN TRY_CAST(clicks AS DOUBLE) END AS clicks FROM dirty""")
def negative_to_null(spark, sf):
    clean = columns.clean_numbers(_dirty(spark, sf), ["clicks"])
    return columns.negatives_to_null(clean, ["clicks"]).select("row_key", "clicks")


@query(_DIRTY_SQL + """ SELECT row_key, TRY_CAST(clicks AS DOUBLE) AS clicks, impressions FROM dirty
 WHERE TRY_CAST(clicks AS DOUBLE) IS NOT NULL AND impressions IS NOT NULL""")
def complete_rows(spark, sf):
    clean = columns.clean_numbers(_dirty(spark, sf), ["clicks", "impressions"]).select("row_key", "clicks", "impressions")
    return columns.complete_rows(clean, ["clicks", "impressions"])


@query(_DIRTY_SQL + """ SELECT 'row_key' AS "column", count(*) - count(row_key) AS nulls FROM dirty
 UNION ALL SELECT 'clicks', count(*) - count(TRY_CAST(clicks AS DOUBLE)) FROM dirty
 UNION ALL SELECT 'impressions', count(*) - count(impressions) FROM dirty UNION ALL SELECT 'cost', count(*) - count(cost) FROM dirty""")
def null_counts(spark, sf):
    return profile.null_counts(columns.clean_numbers(_dirty(spark, sf), ["clicks"]))


@query(f"""WITH {ADS} SELECT count(*) AS n_rows, 19 AS n_columns FROM ads""")
def table_profile(spark, sf):
    return profile.table_profile(ad_rows(spark, sf)).select("n_rows", "n_columns")


@query(f"""WITH {COPIES}, s AS (SELECT (SELECT count(*) FROM ads_copies) AS a, (SELECT count(*) FROM ads) AS b)
SELECT a AS original_rows, b AS final_rows, a - b AS removed_rows, round((a - b) / a, 6) AS removed_share FROM s""")
def removal_report(spark, sf):
    before = ad_rows_with_copies(spark, sf)
    stages = [(before, "raw"), (dedupe.distinct_rows(before), "distinct")]
    counts = [
        d.agg(F.count("*").alias("n_rows")).select(F.lit(i).alias("position"), F.lit(s).alias("stage"), "n_rows")
        for i, (d, s) in enumerate(stages)
    ]
    return stage_report(counts[0].unionByName(counts[1]))


# ------------------------------------------------------------------ duplicates
@query(f"""WITH {COPIES} SELECT DISTINCT campaign_id, ad_group_id, row_key, round(cost, 6) AS cost FROM ads_copies""")
def dedupe_full_row(spark, sf):
    return dedupe.distinct_rows(ad_rows_with_copies(spark, sf)).select("campaign_id", "ad_group_id", "row_key", "cost")


@query(f"""WITH {DISTINCT} SELECT campaign_id, ad_group_id, ad_group_start_date AS date_start, ad_group_end_date AS date_stop,
 round(cost, 6) AS cost, clicks, profile, campaign_start_date AS campaign_start FROM distinct_ads""")
def dedupe_key_subset(spark, sf):
    return campaign.distinct_ad_rows(ad_rows_with_copies(spark, sf)).select(
        "campaign_id", "ad_group_id", "date_start", "date_stop", "cost", "clicks", "profile", "campaign_start"
    )


@query(f"""WITH {COPIES}, d AS (SELECT count(*) AS a, count(DISTINCT row_key) AS b FROM ads_copies)
SELECT a AS rows_before, b AS rows_after, a - b AS removed, round((a - b) / a, 6) AS removed_share FROM d""")
def dedupe_report(spark, sf):
    return dedupe.dedupe_report(ad_rows_with_copies(spark, sf), ["row_key"])


@query(f"""WITH {COPIES} SELECT DISTINCT row_key AS row_id, campaign_id FROM ads_copies WHERE dt >= '19960101'
 AND row_key NOT IN (SELECT row_key FROM ads WHERE line_number <= 2)""")
def dedupe_incremental(spark, sf):
    batch = ad_rows_with_copies(spark, sf).filter("dt >= '19960101'").select(F.col("row_key").alias("row_id"), "campaign_id")
    earlier = ad_rows(spark, sf).filter("line_number <= 2").select(F.col("row_key").alias("row_id"), "campaign_id")
    seen = earlier.select(columns.row_key(["row_id"]).alias("row_key"))
    return dedupe.new_rows(dedupe.keyed_rows(batch, ["row_id"]), seen).drop("row_key")


# --------------------------------------------------------------------- roll-up
@query(f"""WITH {ROLLUP} SELECT campaign_id, campaign_duration, num_ads, round(cost, 4) AS cost, impressions, reach, clicks, actions,
 round(conversion_value, 4) AS conversion_value, business_type, round(btype_confidence, 4) AS btype_confidence FROM campaigns""", digits=4)
def campaign_rollup(spark, sf):
    return campaign.campaign_table(ad_rows_with_copies(spark, sf), SEGMENT_MAPPING)


@query(f"""WITH {DISTINCT} SELECT campaign_id, count(DISTINCT ad_group_id) AS num_ads, round(sum(cost), 4) AS cost, sum(impressions) AS impressions,
 sum(reach) AS reach, sum(clicks) AS clicks, sum(actions) AS actions, round(sum(conversion_value), 4) AS conversion_value,
 min(campaign_start_date) AS campaign_start, max(campaign_end_date) AS campaign_end FROM distinct_ads GROUP BY campaign_id""", digits=4)
def campaign_metrics(spark, sf):
    return rollup.campaign_metrics(campaign.distinct_ad_rows(ad_rows_with_copies(spark, sf)))


@query(f"""WITH {ADS}, counts AS (SELECT campaign_id, {SQUEEZED} AS profile_norm, count(*) AS n_rows FROM ads GROUP BY ALL)
SELECT campaign_id, profile_norm, n_rows FROM counts
QUALIFY row_number() OVER (PARTITION BY campaign_id ORDER BY n_rows DESC, profile_norm) = 1""")
def campaign_mode_profile(spark, sf):
    return rollup.campaign_profile(rollup.profile_counts(ad_rows(spark, sf)))


@query(f"""WITH {ROLLUP} SELECT campaign_id, business_type, round(btype_confidence, 6) AS btype_confidence FROM confidence""")
def business_type_confidence(spark, sf):
    return rollup.type_confidence(campaign.distinct_ad_rows(ad_rows_with_copies(spark, sf)), SEGMENT_MAPPING)


@query(f"""WITH {ADS} SELECT campaign_id, {SQUEEZED} AS profile_norm, count(*) AS n_rows FROM ads GROUP BY ALL""")
def group_sizes(spark, sf):
    return rollup.profile_counts(ad_rows(spark, sf))


@query("""SELECT o_custkey, CAST(greatest(CAST(max(o_orderdate) AS DATE) - CAST(min(o_orderdate) AS DATE), 0) AS BIGINT) AS campaign_duration
FROM orders GROUP BY o_custkey""")
def campaign_duration_text(spark, sf):
    days = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    spans = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min(days).alias("campaign_start"), F.max(days).alias("campaign_end"))
    return rollup.with_duration(spans).select("o_custkey", "campaign_duration")


# ------------------------------------------------------------------------ text
@query(f"""WITH {ADS} SELECT row_key, coalesce(trim(regexp_replace(lower(profile), '\\s+', ' ', 'g')), 'unknown') AS profile_norm,
 {SQUEEZED} AS profile_squeezed,
 coalesce(trim(regexp_replace(lower(nullif(campaign_objective, '1-URGENT')), '\\s+', ' ', 'g')), 'unknown') AS objective_norm FROM ads""")
def norm_text(spark, sf):
    objective = F.nullif(F.col("campaign_objective"), F.lit("1-URGENT"))
    return ad_rows(spark, sf).select(
        "row_key", text.norm_text(F.col("profile")).alias("profile_norm"), text.squeeze(F.col("profile")).alias("profile_squeezed"),
        text.norm_text(objective).alias("objective_norm"),
    )


@query("""WITH t AS (SELECT c_custkey, c_mktsegment || ' | ' || c_name || ' /(TH) & Co.' AS n FROM customer),
g AS (SELECT c_custkey, n, regexp_replace(regexp_replace(regexp_replace(trim(lower(n)), '[|/\\\\\\s]+', '-', 'g'), '[^a-z0-9_-]+', '', 'g'), '-{2,}', '-', 'g') AS s,
 regexp_replace(regexp_replace(trim(lower(CASE WHEN c_custkey % 2 = 0 THEN '9' ELSE '' END || n)), '[^a-z0-9_]', '_', 'g'), '_+', '_', 'g') AS t FROM t)
SELECT c_custkey, trim(s, '-') AS storage_slug, left(CASE WHEN regexp_matches(trim(t, '_'), '^[a-z]') THEN '' ELSE 'c_' END || trim(t, '_'), 250) AS table_slug,
 trim(regexp_replace(trim(lower(n)), '[^a-z0-9]+', '_', 'g'), '_') AS column_name, 'ads/' || trim(s, '-') || '_profile_20210101_20250630' AS prefix,
 'cost' AS stripped FROM g""")
def slugs(spark, sf):
    name = F.concat("c_mktsegment", F.lit(" | "), "c_name", F.lit(" /(TH) & Co."))
    digit = F.when(F.col("c_custkey") % 2 == 0, "9").otherwise("")
    return table(spark, sf, "customer").select(
        "c_custkey", text.storage_slug(name).alias("storage_slug"), text.table_slug(F.concat(digit, name)).alias("table_slug"),
        text.normalize_name_col(name).alias("column_name"),
        text.export_prefix(name, F.lit("x"), "ads", "20210101", "20250630").alias("prefix"),
        text.strip_suffix(F.lit("cost_log1p")).alias("stripped"),
    )


def _classify_sql(conditions, text_sql="lower(profile)"):
    whens = " ".join(f"WHEN {c.format(p=text_sql)} THEN '{v}'" for c, v in conditions)
    return f"WITH {ADS} SELECT row_key, CASE {whens} ELSE 'unknown' END AS business_type FROM ads"


@query(_classify_sql([("{p} LIKE 'building%'", "real_estate"), ("{p} LIKE 'build%'", "other"), ("{p} LIKE 'house%'", "retail_brand")]))
def classify_prefix(spark, sf):
    mapping = [("building", "real_estate"), ("Build ", "other"), ("house", "retail_brand")]
    return ad_rows(spark, sf).select("row_key", kw.classify(F.lower("profile"), mapping, "prefix").alias("business_type"))


@query(_classify_sql([("regexp_matches({p}, '\\bbuild\\b')", "other"), ("regexp_matches({p}, '\\bbuilding\\b')", "real_estate"),
                      ("regexp_matches({p}, '\\bmachinery\\b')", "industrial_manufacturing"),
                      ("regexp_matches({p}, '\\bhousehold \\(ex\\.\\)\\b')", "retail_brand")], "regexp_replace(lower(profile), '\\s+', ' ', 'g')"))
def classify_word(spark, sf):
    mapping = [("build", "other"), ("building", "real_estate"), ("machinery", "industrial_manufacturing"), ("household (ex.)", "retail_brand")]
    return ad_rows(spark, sf).select("row_key", kw.classify(text.squeeze(F.col("profile")), mapping).alias("business_type"))


@query(_classify_sql([("contains({p}, 'build')", "other"), ("contains({p}, 'building')", "real_estate"), ("contains({p}, '00007')", "food_beverage")]))
def classify_substring(spark, sf):
    mapping = [("build", "other"), ("building", "real_estate"), ("00007", "food_beverage")]
    return ad_rows(spark, sf).select("row_key", kw.classify(F.lower("profile"), mapping, "substring").alias("business_type"))


@query(f"""WITH {ADS} SELECT row_key, CASE WHEN line_number = 1 THEN 'real_estate' WHEN contains(lower(profile), 'machinery') THEN 'industrial_manufacturing'
 WHEN contains(lower(profile), 'furniture') THEN 'retail_brand' ELSE 'unknown' END AS business_type FROM ads""")
def classify_known_or_name(spark, sf):
    given = F.when(F.col("line_number") == 1, "real_estate").otherwise(F.col("profile"))
    mapping = [("machinery", "industrial_manufacturing"), ("furniture", "retail_brand")]
    return ad_rows(spark, sf).select(
        "row_key", kw.known_or_classified(given, names.SCORING_VOCABULARY["business_type"], mapping).alias("business_type")
    )


@query("""SELECT o_orderkey, format('{:,}', CAST(o_totalprice AS BIGINT)) AS cnt FROM orders WHERE o_totalprice = floor(o_totalprice)
UNION ALL SELECT o_orderkey, '$' || format('{:,.2f}', o_totalprice) FROM orders WHERE o_totalprice <> floor(o_totalprice)""")
def number_formats(spark, sf):
    price = F.col("o_totalprice")
    shown = F.when(price == F.floor(price), text.format_count(price)).otherwise(text.format_usd(price))
    return table(spark, sf, "orders").select("o_orderkey", shown.alias("cnt"))


# ----------------------------------------------------------------------- joins
@query(f"""WITH {ADS}, c AS (SELECT campaign_id, profile, count(*) AS n FROM ads GROUP BY ALL), m AS (SELECT campaign_id, max(n) AS top FROM c GROUP BY 1)
SELECT c.campaign_id, c.profile, c.n FROM c JOIN m ON c.campaign_id = m.campaign_id WHERE c.n = m.top""")
def join_inner(spark, sf):
    counts = ad_rows(spark, sf).groupBy("campaign_id", "profile").agg(F.count("*").alias("n"))
    top = counts.groupBy("campaign_id").agg(F.max("n").alias("top"))
    return counts.join(top, "campaign_id").filter("n = top").select("campaign_id", "profile", "n")


@query(f"""WITH {TYPED}, best AS (SELECT campaign_id, min(business_type) AS label FROM typed GROUP BY 1),
n AS (SELECT campaign_id, business_type, count(*) AS n_rows FROM typed WHERE line_number = 1 GROUP BY ALL)
SELECT best.campaign_id, label, n_rows FROM best LEFT JOIN n ON best.campaign_id = n.campaign_id AND label = business_type""")
def join_left_two_keys(spark, sf):
    typed = typed_ads(spark, sf)
    best = typed.groupBy("campaign_id").agg(F.min("business_type").alias("label"))
    n = typed.filter("line_number = 1").groupBy(F.col("campaign_id").alias("_id"), "business_type").agg(F.count("*").alias("n_rows"))
    return best.join(n, (best["campaign_id"] == n["_id"]) & (best["label"] == n["business_type"]), "left").select(
        "campaign_id", "label", "n_rows"
    )


@query("""SELECT c_custkey, c_name, n, coalesce(n, 0) AS n_filled FROM customer LEFT JOIN
 (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) ON c_custkey = o_custkey""")
def join_left(spark, sf):
    n = table(spark, sf, "orders").filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"))
    joined = table(spark, sf, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", "c_name", "n", F.coalesce("n", F.lit(0)).alias("n_filled"))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def join_semi(spark, sf):
    listed = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'")
    orders = table(spark, sf, "orders")
    return orders.join(listed, orders["o_custkey"] == listed["c_custkey"], "left_semi").select("o_orderkey", "o_custkey")


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')""")
def join_anti(spark, sf):
    customers = table(spark, sf, "customer")
    orders = table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'")
    return customers.join(orders, customers["c_custkey"] == orders["o_custkey"], "left_anti").select("c_custkey", "c_name")


@query(f"""WITH {ADS} SELECT row_key, company, CASE company WHEN 'building' THEN 'real_estate' WHEN 'machinery' THEN 'industrial_manufacturing'
 ELSE 'retail_brand' END AS business_type FROM (SELECT row_key, CASE WHEN lower(profile) LIKE 'building%' THEN 'building'
 WHEN lower(profile) LIKE 'machinery%' THEN 'machinery' WHEN lower(profile) LIKE 'furniture%' THEN 'furniture' END AS company FROM ads) WHERE company IS NOT NULL""")
def dictionary_join(spark, sf):
    mapping = [("building", "real_estate"), ("machinery", "industrial_manufacturing"), ("furniture", "retail_brand")]
    rows = ad_rows(spark, sf).select("row_key", "profile")
    keyed = rows.withColumn("company", kw.longest_prefix(F.lower("profile"), [k for k, _ in mapping])).drop("profile")
    # Three rows.
    lookup = kw.mapping_frame(spark, mapping).select(F.col("keyword").alias("company"), "business_type")
    return keyed.join(F.broadcast(lookup), "company").select("row_key", "company", "business_type")


@query(f"""WITH {ADS} SELECT row_key, CASE WHEN line_number < 6 THEN clicks > 300 END AS is_outlier_gw,
 CASE WHEN line_number > 2 THEN actions > 60 END AS is_outlier_global,
 coalesce(CASE WHEN line_number < 6 THEN clicks > 300 END, false) OR coalesce(CASE WHEN line_number > 2 THEN actions > 60 END, false) AS is_outlier_combined FROM ads""")
def mask_combine(spark, sf):
    ads = stored(ad_rows(spark, sf).select("row_key", "line_number", "clicks", "actions"))
    first = ads.filter("line_number < 6").select("row_key", (F.col("clicks") > 300).alias("is_outlier_gw"))
    second = ads.filter("line_number > 2").select("row_key", (F.col("actions") > 60).alias("is_outlier_global"))
    return masks.combine_masks(ads.select("row_key"), first, second, "row_key")


@query(f"""WITH {ADS} SELECT row_key, round(cost, 6) AS cost FROM ads WHERE NOT clicks > 300""")
def mask_filter(spark, sf):
    flagged = ad_rows(spark, sf).withColumn("is_outlier", F.col("clicks") > 300)
    return masks.inliers(flagged).select("row_key", "cost")


@query("""SELECT o_orderkey, o_totalprice AS y, round(o_totalprice * 0.9, 4) AS yhat FROM orders""", digits=4)
def join_truth_prediction(spark, sf):
    truth = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("y"))
    pred = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") * 0.9).alias("yhat"))
    return truth.join(pred, "o_orderkey")


# ------------------------------------------------------------------- summaries
@query(f"""WITH {TYPED} SELECT business_type, count(*) AS n_rows FROM typed GROUP BY 1""")
def category_distribution(spark, sf):
    return profile.category_distribution(typed_ads(spark, sf), "business_type")


@query("""SELECT DISTINCT p_type AS value FROM part WHERE p_type IS NOT NULL""")
def distinct_values(spark, sf):
    return profile.distinct_values(table(spark, sf, "part"), "p_type")


@query(f"""WITH {ADS}, v AS (SELECT 'cost' AS "column", ln(1 + cost) AS v FROM ads UNION ALL SELECT 'impressions', impressions FROM ads),
s AS (SELECT "column", min(v) AS lo, max(v) AS hi FROM v GROUP BY 1),
b AS (SELECT v."column", lo, hi, CAST(least(floor((v - lo) / (hi - lo) * 20), 19) AS INTEGER) AS bin FROM v JOIN s ON v."column" = s."column")
SELECT "column", bin, round(lo + (hi - lo) / 20 * bin, 6) AS bin_start, round(lo + (hi - lo) / 20 * (bin + 1), 6) AS bin_end, count(*) AS n FROM b GROUP BY "column", lo, hi, bin""")
def histogram(spark, sf):
    return profile.histogram(ad_rows(spark, sf), ["cost", "impressions"], 20, ["cost"])


@query(f"""WITH {TYPED}, g AS (SELECT business_type, count(*) AS size, count(*) FILTER (clicks > 300) AS o,
 avg(CASE WHEN clicks > 300 THEN 1 ELSE 0 END) * 100 AS p FROM typed GROUP BY 1)
SELECT business_type, size, CASE WHEN size < 11980 THEN 0 ELSE o END AS outliers, round(CASE WHEN size < 11980 THEN 0 ELSE p END, 6) AS pct,
 CASE WHEN size < 11980 THEN 'skipped_too_small' ELSE '' END AS note FROM g""")
def group_summary(spark, sf):
    flagged = typed_ads(spark, sf).withColumn("is_outlier", F.col("clicks") > 300)
    return masks.group_summary(flagged, min_group=11_980)


@query(f"""WITH {ADS} SELECT 'impressions' AS target, round(avg(impressions), 6) AS mean_prediction, round(stddev_pop(impressions), 6) AS std_prediction,
 min(impressions) AS min_prediction, max(impressions) AS max_prediction, count(impressions) AS sample_size FROM ads
 UNION ALL SELECT 'clicks', round(avg(clicks), 6), round(stddev_pop(clicks), 6), min(clicks), max(clicks), count(clicks) FROM ads""")
def prediction_summary(spark, sf):
    return profile.prediction_summary(ad_rows(spark, sf), {"impressions": "impressions", "clicks": "clicks"})


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""", digits=4)
def top_rows(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("""SELECT o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n
FROM orders QUALIFY n = 1""", digits=4)
def best_per_group(spark, sf):
    return (
        table(spark, sf, "orders").groupBy("o_custkey")
        .agg(F.min(F.struct((-F.col("o_totalprice")).alias("p"), "o_orderkey")).alias("b"))
        .select("b.o_orderkey", (-F.col("b.p")).alias("o_totalprice"), F.lit(1).alias("n"))
    )


# ------------------------------------------------------------- keyword tables
_NAMES = "names AS (SELECT c_custkey, lower(c_mktsegment || '  ' || c_name) AS name FROM customer)"
_KEYWORDS = {
    "prefix": "substr(lower(c_mktsegment || '  ' || c_name), 1, CAST(16 + c_custkey % 14 AS INTEGER))",
    "word": "CASE c_custkey % 3 WHEN 0 THEN c_name WHEN 1 THEN substr(c_name, 10) ELSE c_mktsegment END",
    "substring": "substr(c_name, CAST(12 + c_custkey % 5 AS INTEGER))",
}
_HITS = {"prefix": "starts_with(name, k)", "word": r"CASE WHEN contains(name, k) THEN regexp_matches(name, '\b' || k || '\b') ELSE false END", "substring": "contains(name, k)"}


def _dictionary_sql(mode: str) -> str:
    return f"""WITH {_NAMES},
d AS (SELECT DISTINCT lower({_KEYWORDS[mode]}) AS k, c_custkey * 7919 % 10007 AS priority, 't' || (c_custkey % 9) AS label FROM customer),
hits AS (SELECT c_custkey, label, row_number() OVER (PARTITION BY c_custkey ORDER BY priority, label) AS r FROM names JOIN d ON {_HITS[mode]})
SELECT names.c_custkey, coalesce(label, 'unknown') AS business_type FROM names LEFT JOIN hits ON names.c_custkey = hits.c_custkey AND r = 1"""


def _dictionary(spark, sf, mode):
    """Account names under a keyword table as long as the customer table."""
    customers = table(spark, sf, "customer")
    words = customers.select(
        F.expr(_KEYWORDS[mode]).alias("keyword"), F.concat(F.lit("t"), F.col("c_custkey") % 9).alias("business_type"), (F.col("c_custkey") * 7919 % 10007).alias("priority")
    )
    named = customers.select("c_custkey", F.lower(F.concat("c_mktsegment", F.lit("  "), "c_name")).alias("name"))
    return joins.label_distinct(named, F.col("name"), words, "business_type", mode).select("c_custkey", "business_type")


@query(_dictionary_sql("prefix"))
def dictionary_prefix(spark, sf):
    return _dictionary(spark, sf, "prefix")


@query(_dictionary_sql("word"))
def dictionary_word(spark, sf):
    return _dictionary(spark, sf, "word")


@query(_dictionary_sql("substring"))
def dictionary_substring(spark, sf):
    return _dictionary(spark, sf, "substring")
