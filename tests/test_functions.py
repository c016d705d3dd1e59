import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from adlumen import names
from adlumen.functions import classify as kw, dates, kpi, numeric, text


def test_name_forms():
    assert text.normalize_name("  Campaign  ID ") == "campaign_id"
    assert text.normalize_name("__a--b__") == "a_b"


def test_norm_text(one):
    got = one("a string, b string", ("  A\t B ", None), text.norm_text(F.col("a")), text.squeeze(F.col("a")), text.norm_text(F.col("b")))
    assert got == ("a b", " a b ", "unknown")


@pytest.mark.parametrize(
    "raw, slug, table",
    [("A | B / C", "a-b-c", "a_b_c"), ("!!!", "unknown", "c_"), ("9 lives (2024)", "9-lives-2024", "c_9_lives_2024"), ("x--y_z", "x-y_z", "x_y_z")],
)
def test_slugs(one, raw, slug, table):
    assert one("a string", (raw,), text.storage_slug(F.col("a")), text.table_slug(F.col("a"))) == (slug, table)


def test_prefix_and_formats(one):
    c = F.col("a")
    got = one(
        "a string, n double", ("The Fine", 1234.5),
        text.export_prefix(c, F.lit("t"), "base", "1", "2"), text.export_prefix(c, F.lit("t"), "base", "1", "2", True),
        text.format_count(F.col("n")), text.format_usd(F.col("n")), text.strip_suffix(F.lit("x_log1p")),
    )
    assert got == ("base/the-fine_profile_1_2", "base/t/the-fine_profile_1_2", "1,234", "$1,234.50", "x")


def test_classification_rules(one):
    c = F.col("a")
    mapping = [("art", "first"), ("smart shop", "second"), ("club (x)", "third")]
    assert one("a string", ("smart shop",), kw.classify(c, mapping), kw.classify(c, mapping, "substring"), kw.classify(c, mapping, "prefix")) == (
        "second", "first", "second")
    # A keyword ending in a bracket has no word boundary behind it at the end.
    assert one("a string", ("club (x)",), kw.classify(c, mapping), kw.classify(c, mapping, "substring")) == ("unknown", "third")
    assert one("a string", ("|art deco",), kw.classify(c, mapping, "prefix")) == ("first",)
    assert one("a string", (None,), kw.classify(c, mapping)) == ("unknown",)


def test_longest_prefix_and_all(one):
    keys = ["urban", "urban park", "x"]
    assert one("a string", ("urban park 1",), kw.longest_prefix(F.col("a"), keys), kw.all_keywords(F.col("a"), keys)) == (
        "urban park", ["urban", "urban park"])


def test_mapping_order(spark):
    df = spark.createDataFrame([("b", "2", 2), ("a", "1", 1)], "keyword string, business_type string, priority int")
    assert kw.load_mapping(df) == [("a", "1"), ("b", "2")]


@pytest.mark.parametrize(
    "raw, want",
    [("2025-05-06", date(2025, 5, 6)), ("3/4/2025", date(2025, 4, 3)), ("12/31/2025", date(2025, 12, 31)), ("2024/2/29", date(2024, 2, 29)),
     ("01-02-2025", date(2025, 2, 1)), ("soon", None), ("2025-02-30", None), (None, None)],
)
def test_date_spellings(one, raw, want):
    assert one("a string", (raw,), dates.parse_any_date(F.col("a"))) == (want,)


def test_calendar(one):
    d = date(2021, 1, 3)  # Sunday of ISO week 53 of 2020
    block = dates.time_block("d", F.col("d"))
    got = dict(zip(block, one("d date", (d,), *block.values())))
    assert (got["d_dow"], got["d_is_weekend"], got["d_weekofyear"], got["d_doy"], got["d_quarter"]) == (6, 1, 53, 3, 1)
    assert got["d_month_progress"] == pytest.approx(2 / 31)
    assert got["d_dow_sin"] == pytest.approx(math.sin(2 * math.pi * 6 / 7))
    leap = dates.time_block("d", F.col("d"))
    got = dict(zip(leap, one("d date", (date(2024, 2, 29),), *leap.values())))
    assert (got["d_days_in_month"], got["d_is_month_end"], got["d_is_weekend"]) == (29, 1, 0)
    iso = dates.time_block("d", F.col("d"), dow_base=1)
    friday = dict(zip(iso, one("d date", (date(2025, 1, 3),), *iso.values())))
    assert (friday["d_dow"], friday["d_is_weekend"]) == (5, 1)


def test_durations(one):
    a, b = F.col("a"), F.col("b")
    got = one("a date, b date, n date", (date(2025, 1, 10), date(2025, 1, 1), None), dates.days_between(a, b), dates.days_between(b, a),
              dates.days_between(a, F.col("n")), dates.duration_from_dates(F.col("n"), b), dates.duration_from_dates(a, b))
    assert got == (9, 0, 0, None, 9)
    got = one("a string, b string, n string", ("2025-01-10 11:00:00 UTC", "2025-01-01 12:00:00", "bad"),
              dates.duration_from_text(a, b), dates.duration_from_text(b, a), dates.duration_from_text(F.col("n"), b))
    assert got == (8, 0, 0)


def test_guarded_numbers(one):
    x, y = F.col("x"), F.col("y")
    got = one("x double, y double, t string", (5.0, None, "1e2"), numeric.safe_div(x, y), numeric.safe_div(y, x), numeric.log1p_safe(y),
              numeric.log1p_safe(F.lit(-3.0)), numeric.log1p_or_null(F.lit(-3.0)), numeric.clean_number(F.col("t")), numeric.clean_number(F.lit("x")))
    assert got == (5e9, None, 0.0, 0.0, None, 100.0, None)
    assert one("x double", (float("nan"),), numeric.clean_number(x)) == (None,)


def test_row_errors(one):
    errors = numeric.row_errors(F.col("y"), F.col("p"))
    got = dict(zip(errors, one("y double, p double", (0.0, 2.0), *errors.values())))
    assert got == {"err": 2.0, "abs_err": 2.0, "ape": None, "sape": 2.0}


def test_bands_and_warnings(one):
    v = F.col("v")
    assert one("v double", (0.02,), kpi.ctr_benchmark(v)) == ("Average",)
    assert one("v double", (1.5,), kpi.frequency_benchmark(v)) == ("Low (may need more exposure)",)
    assert one("v double", (None,), kpi.roas_benchmark(v), kpi.reliability(v)) == (None, "Unknown")
    assert one("v double", (12_501.0,), kpi.budget_warning(v, "clicks")) == (
        "Clicks/budget ratio too high: 50.0 clicks per dollar (expected < 50)",)
    assert one("v double", (12_500.0,), kpi.budget_warning(v, "clicks"), kpi.budget_warning(v, "clicks", F.lit(10.0))) == (
        None, "Clicks/budget ratio too high: 1250.0 clicks per dollar (expected < 50)")
    assert one("v double", (-7.0,), kpi.bounded_level(v, "clicks"), kpi.was_clamped(v, "clicks"), kpi.log_is_plausible(v, "clicks")) == (0.0, True, False)


def test_kpi_guards(one):
    blocks = kpi.performance_estimates(*[F.col(c) for c in "icarvbd"])
    flat = {n: e for b in blocks.values() for n, e in b.items()}
    got = dict(zip(flat, one("i double, c double, a double, r double, v double, b double, d int", (100.0, 0.0, None, 50.0, 0.0, 0.0, 0), *flat.values())))
    assert got["impressions_per_dollar"] is None and got["impressions_per_day"] is None
    assert got["cost_per_impression"] == 0.0 and got["frequency"] == 2.0
    assert got["click_through_rate"] is None and got["ctr_benchmark"] is None and got["roas_benchmark"] is None


def test_feature_lists():
    assert len(names.FEATURES) == 95 and len(set(names.FEATURES)) == 95
    assert len(names.NUMERIC_FEATURES) == 91 and len(names.SCORED_FEATURES) == 160
