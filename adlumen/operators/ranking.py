"""Exact order statistics without sorting or gathering a group.

The value at a rank is found by narrowing.  Each pass counts rows in up to
1,024 sub-ranges of the range known to hold the answer, with map-side
combining, and goes on in the sub-range where the rank falls.  A pass divides
the number of candidates by about a thousand, a value shared by a third of all
rows is only a count, and no task holds more than the counts.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegralType

from adlumen.operators.joins import null_safe_join
from adlumen.sources.session import checkpointed, small_side

BUCKETS = 1024
# Up to this many rows per group the built-in percentile aggregate is used; its
# table of distinct values then stays within about 100 MB.
SMALL_GROUP = 1_000_000
# Candidates few enough, over all ranges together, to be sorted.
SORT_ROWS = 100_000


def _bucket(v: Column, lo: Column, hi: Column, integral: bool) -> Column:
    """Sub-range of ``v``; never decreasing in ``v``, and lower at ``lo`` than at ``hi``.

    NaN, which sorts last, and the infinities have sub-ranges of their own.
    """
    if integral:
        return F.least(F.floor((v - lo) / (hi - lo) * BUCKETS), F.lit(BUCKETS - 1))

    def log_of(x):
        return F.signum(x) * F.log1p(F.abs(x))

    infinity, most = F.lit(float("inf")), F.lit(1.7976931348623157e308)
    low = F.when(lo == -infinity, -most).otherwise(lo)
    high = F.when(F.isnan(hi) | (hi == infinity), most).otherwise(hi)
    # Log spacing suits long tails; ends too close for it use even spacing.
    width = log_of(high) - log_of(low)
    share = F.when(width > 0, F.try_divide(log_of(v) - log_of(low), width)).otherwise(F.try_divide(v - low, high - low))
    inner = F.least(F.greatest(F.floor(share * BUCKETS), F.lit(0)), F.lit(BUCKETS - 1))
    return (
        F.when(F.isnan(v), F.lit(BUCKETS + 1)).when(v == infinity, F.lit(BUCKETS)).when(v == -infinity, F.lit(-1)).otherwise(inner).cast("bigint")
    )


def _in_ranges(data: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``data`` with each open range of their group they fall in."""
    if not by:
        # One group: as many ranges as ranks were asked for.
        found = [F.struct(F.lit(r.lo).alias("lo"), F.lit(r.hi).alias("hi"), F.lit(r.below).alias("below"))
                 for r in ranges.select("lo", "hi", "below").distinct().collect()]
        out = data.withColumn("_all", F.array(*found))
    else:
        per_group = ranges.groupBy(*by).agg(F.collect_set(F.struct("lo", "hi", "below")).alias("_all"))
        out = null_safe_join(data, small_side(per_group), by)
    inside = F.filter("_all", lambda r: (F.col("v") >= r["lo"]) & (F.col("v") <= r["hi"]))
    return out.select(*by, "v", F.explode(inside).alias("_r")).select(*by, "v", "_r.lo", "_r.hi", "_r.below")


def _span(data: DataFrame, by: list[str]) -> DataFrame:
    """Range and size of every group."""
    return checkpointed(data.groupBy(*by).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")))


def values_at_ranks(
    df: DataFrame, value: str, targets: DataFrame, by: list[str] = (), sort_rows: int = SORT_ROWS
) -> DataFrame:
    """``value`` at each 0-based ``rank`` of ``targets(by..., rank)``.

    Nulls do not count.  Ranks outside a group give no row.  Narrowing ends
    when at most ``sort_rows`` candidates are left, which are then sorted.
    """
    by = list(by)
    integral = isinstance(df.schema[value].dataType, IntegralType)
    data = df.select(*by, F.col(value).cast("bigint" if integral else "double").alias("v")).filter(F.col("v").isNotNull())
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _search(data, _span(data, by), targets, by, integral, sort_rows)
    finally:
        data.unpersist()


def _search(data: DataFrame, span: DataFrame, targets: DataFrame, by: list[str], integral: bool, sort_rows: int) -> DataFrame:
    wanted = targets.select(*by, F.col("rank").cast("bigint").alias("rank")).distinct()
    if by:
        state = null_safe_join(wanted, small_side(span), by)
    else:
        whole = span.first()  # one row
        kind = "bigint" if integral else "double"
        state = wanted.withColumns({c: F.lit(whole[c]).cast(kind) for c in ("lo", "hi")}).withColumn("n", F.lit(whole["n"]))
    state = checkpointed(
        state.filter((F.col("rank") >= 0) & (F.col("rank") < F.col("n"))).select(
            *by, "rank", "lo", "hi", F.lit(0).cast("bigint").alias("below"), "n"
        )
    )
    ranges, before = [*by, "lo", "hi"], None
    while True:
        pending = state.filter(F.col("lo") < F.col("hi"))
        candidates, largest = pending.select(*by, "lo", "hi", "n").distinct().agg(F.sum("n"), F.max("n")).first()
        if candidates is None:
            return state.select(*by, "rank", F.col("lo").alias("value"))
        if before is not None and largest >= before:
            raise RuntimeError(f"a pass left {largest} candidates in one range, as many as before")
        before = largest
        found = state.filter(F.col("lo") >= F.col("hi"))
        rows = _in_ranges(data, pending, by)
        if candidates <= sort_rows:
            place = F.row_number().over(Window.partitionBy(*ranges).orderBy("v")) - 1 + F.col("below")
            ranked = rows.withColumn("place", place)
            placed = ranked.select(*ranges, F.col("place").alias("rank"), F.col("v").alias("value"))
            last = null_safe_join(pending, placed, [*ranges, "rank"]).select(*by, "rank", "value")
            return checkpointed(found.select(*by, "rank", F.col("lo").alias("value")).unionByName(last))
        bucket = _bucket(F.col("v"), F.col("lo"), F.col("hi"), integral)
        counts = rows.groupBy(*by, "lo", "hi", "below", bucket.alias("bucket")).agg(
            F.count("*").alias("n"), F.min("v").alias("first"), F.max("v").alias("last")
        )
        lower = Window.partitionBy(*ranges).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("start", F.col("below") + F.coalesce(F.sum("n").over(lower), F.lit(0)))
        hit = (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("n"))
        narrowed = null_safe_join(pending.drop("below", "n"), counts.drop("below"), ranges).filter(hit).select(
            *by, "rank", F.col("first").alias("lo"), F.col("last").alias("hi"), F.col("start").alias("below"), "n"
        )
        state = checkpointed(found.unionByName(narrowed))


def _long_form(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])
    return df.select(*by, F.explode(cells).alias("_c")).select(*by, "_c.column", "_c.v").filter("v IS NOT NULL")


def quantiles(
    df: DataFrame, columns: list[str], probs: list[float], by: list[str] = (), small: int = SMALL_GROUP
) -> DataFrame:
    """Exact interpolated quantiles: ``by..., column, prob, value``.

    Groups of at most ``small`` rows use the built-in aggregate, one for each column over the table as it is; its memory
    grows with distinct values.  Larger groups are narrowed, with equal results for infinities and NaN (sorted last)
    too: only then do cells become rows, in passes over the cached columns.
    """
    by = list(by)
    keys = [*by, "column"]
    prob_list = F.array(*[F.lit(float(p)) for p in probs])
    wide = df.select(*by, *[F.col(f"`{c}`").cast("double").alias(f"_v{i}") for i, c in enumerate(columns)])
    wide = wide.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if (wide.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= small:
            out = wide.groupBy(*by).agg(*[F.percentile(f"_v{i}", prob_list).alias(f"_v{i}") for i in range(len(columns))])
            cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_v{i}").alias("values")) for i, c in enumerate(columns)])
            long = out.select(*by, F.explode(cells).alias("_c")).select(*by, "_c.*").filter("values IS NOT NULL")
            pairs = F.arrays_zip(prob_list.alias("prob"), F.col("values").alias("value"))
            return checkpointed(long.select(*keys, F.explode(pairs).alias("_q")).select(*keys, "_q.prob", "_q.value"))
        rows = _long_form(wide.withColumnsRenamed({f"_v{i}": c for i, c in enumerate(columns)}), columns, by)
        span = _span(rows, keys)
        at = span.select(*keys, F.explode(prob_list).alias("prob"), "n").withColumn("position", (F.col("n") - 1) * F.col("prob"))
        targets = at.select(*keys, F.explode(F.array(F.floor("position"), F.ceil("position"))).alias("rank"))
        found = _search(rows, span, targets, keys, False, small)
    finally:
        wide.unpersist()
    out = at.withColumns({"r0": F.floor("position"), "r1": F.ceil("position")})
    for i in ("0", "1"):
        out = null_safe_join(out, found.withColumnsRenamed({"rank": f"r{i}", "value": f"v{i}"}), [*keys, f"r{i}"])
    share = F.col("position") - F.floor("position")
    value = F.when(F.col("v0") == F.col("v1"), F.col("v0")).otherwise(F.col("v0") * (1 - share) + F.col("v1") * share)
    return out.select(*keys, "prob", value.alias("value"))


def hashes_at_ranks(df: DataFrame, targets: DataFrame, value: str = "h", by: list[str] = ()) -> DataFrame:
    """``by..., rank, value``: the hash at each rank of ``targets(by..., rank, n)``, ``n`` being the rows of the group.

    Hashes of :func:`hash_number` are spread evenly, so the one at a rank lies within a few deviations of its share of the
    range: rows below that bracket are counted, and only those inside it (some square roots of a group) are sorted.
    A rank that isn't in its bracket, as many equal keys can bring about, is looked up by narrowing.
    """
    by = list(by)
    wanted = checkpointed(targets.filter("rank >= 0 and rank < n").select(*by, F.col("rank").cast("bigint").alias("rank"), "n").distinct())
    share = (F.col("rank") + 0.5) / F.col("n")
    wide = 8 * F.sqrt(share * (1 - share) / F.col("n")) + 8 / F.col("n")
    top = float(HASH_RANGE)
    bounds = wanted.select(*by, "rank", (F.greatest(share - wide, F.lit(0.0)) * top).cast("bigint").alias("lo"), (F.least(share + wide, F.lit(1.0)) * top).cast("bigint").alias("hi"))
    rows = df.select(*by, F.col(value).alias("h")).filter("h IS NOT NULL")
    if by:
        each = null_safe_join(rows, small_side(bounds.groupBy(*by).agg(F.collect_set(F.struct("rank", "lo", "hi")).alias("_all"))), by)
    else:
        # One group: as many brackets as ranks were asked for.
        listed = [F.struct(*[F.lit(r[c]).cast("bigint").alias(c) for c in ("rank", "lo", "hi")]) for r in bounds.collect()]
        each = rows.withColumn("_all", F.array(*listed)) if listed else rows.limit(0).withColumn("_all", F.array(F.struct(*[F.lit(0).cast("bigint").alias(c) for c in ("rank", "lo", "hi")])))
    met = each.select(*by, "h", F.explode(F.filter("_all", lambda r: F.col("h") <= r["hi"])).alias("r")).select(*by, "h", "r.rank", "r.lo")
    # Rows below a bracket fold into one of their number; those inside stay.
    inside = F.when(F.col("h") >= F.col("lo"), F.col("h"))
    counted = met.groupBy(*by, "rank", inside.alias("h")).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*by, "rank").orderBy(F.asc_nulls_first("h")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    through = counted.withColumn("through", F.sum("n").over(order))
    hit = (F.col("rank") < F.col("through")) & (F.col("rank") >= F.col("through") - F.col("n")) & F.col("h").isNotNull()
    found = checkpointed(through.filter(hit).select(*by, "rank", F.col("h").alias("value")))
    if found.count() == wanted.count():
        return found
    return values_at_ranks(df, value, wanted.select(*by, "rank"), by)


def value_brackets(df: DataFrame, value: str, ranks: list[int], accuracy: int = 10_000) -> tuple[list[tuple[float, float]], int]:
    """Ranges that hold the values at the given ranks, and the number of rows; one aggregate over all rows."""
    n = df.count()
    if not n:
        return [], 0
    slack = 2.5 / accuracy
    shares = [x for r in ranks for x in (max(r / n - slack, 0.0), min((r + 1) / n + slack, 1.0))]
    at = df.agg(F.percentile_approx(value, F.array(*[F.lit(x) for x in shares]), accuracy)).first()[0]
    return [(at[2 * i], at[2 * i + 1]) for i in range(len(ranks))], n


def places_of_ranks(df: DataFrame, value: str, ranks: list[int]) -> dict[int, tuple[float, int, int]]:
    """``{rank: (value, rows below it, rows equal to it)}`` for some dozens of 0-based ranks, in three passes.

    An approximate quantile brackets each rank; then rows below the brackets are counted and the distinct values inside
    them, a few ten-thousandths of the table, are counted and summed up in order.
    """
    rows = df.select(F.col(value).cast("double").alias("v")).filter("v IS NOT NULL and NOT isnan(v)")
    brackets, n = value_brackets(rows, "v", ranks)
    if not n:
        return {}
    ranges: list[list[float]] = []
    for lo, hi in sorted(brackets):
        if ranges and lo <= ranges[-1][1]:
            ranges[-1][1] = max(ranges[-1][1], hi)
        else:
            ranges.append([lo, hi])
    v = F.col("v")
    below = rows.agg(*[F.count_if(v < lo).alias(f"b{i}") for i, (lo, _) in enumerate(ranges)]).first()
    place = F.coalesce(*[F.when((v >= lo) & (v <= hi), i) for i, (lo, hi) in enumerate(ranges)])
    counts = rows.withColumn("range", place).filter("range IS NOT NULL").groupBy("range", "v").agg(F.count("*").alias("n"))
    order = Window.partitionBy("range").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    base = F.element_at(F.array(*[F.lit(below[f"b{i}"]) for i in range(len(ranges))]), F.col("range") + 1)
    start = counts.withColumn("start", base + F.coalesce(F.sum("n").over(order), F.lit(0)))
    wanted = F.filter(F.array(*[F.lit(r).cast("bigint") for r in ranks]), lambda r: (r >= F.col("start")) & (r < F.col("start") + F.col("n")))
    # At most a row per rank.
    return {r["rank"]: (r["v"], r["start"], r["n"]) for r in start.select("v", "start", "n", F.explode(wanted).alias("rank")).collect()}


HASH_RANGE = 1 << 60


def hash_number(key: Column, seed: int = 42) -> Column:
    """A stable 60-bit number from a key; equal in any engine with MD5."""
    digest = F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def hash_share(key: Column, seed: int = 42) -> Column:
    """A stable number in [0, 1) from a key."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
