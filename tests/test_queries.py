"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import os
import sys

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry_point  # noqa: E402
from adlumen import queries as registered  # noqa: E402

SQL = registered.SQL


def test_registry():
    queries = entry_point.queries()
    assert set(entry_point.oracle_sql()) <= set(queries)
    assert set(registered.QUERIES) <= set(queries)


def test_entry(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.fixture(scope="module")
def duck():
    from check_oracle import connect

    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    from check_oracle import compare

    got = entry_point.queries()[name](spark, SF).toPandas()
    assert compare(got, duck.execute(SQL[name]).df()) is None


def test_stacking_against_numpy(spark):
    """The stack must equal ridge on the same three prediction columns."""
    import numpy as np

    from adlumen.queries import evaluation

    base = evaluation._base_predictions(spark, SF).toPandas().sort_values("row_key")
    out = entry_point.queries()["stacking"](spark, SF).toPandas().sort_values("row_key")
    x, y = base[["pred_a", "pred_b", "pred_c"]].to_numpy(), base["y"].to_numpy()

    def fitted(rows):
        xc, yc = x[rows] - x[rows].mean(0), y[rows] - y[rows].mean()
        w = np.linalg.solve(xc.T @ xc + np.eye(3), xc.T @ yc)
        return x @ w + y[rows].mean() - x[rows].mean(0) @ w

    every = np.ones(len(x), bool)
    assert np.allclose(out["pred"], fitted(every), atol=2e-6)
    for k in range(5):
        inside = (base["fold"] == k).to_numpy()
        assert np.allclose(out["pred_out_of_fold"][inside], fitted(~inside)[inside], atol=2e-6)


def test_rounding_equals_that_of_spark(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from adlumen.queries.registry import rounded

    rng = np.random.default_rng(5)
    near = (rng.integers(-10**7, 10**7, 4_000) + 0.5) / 1e6
    values = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, -1e-9, 0.5e-6, -0.5e-6, 1.0000005, 1e300, 123456789.1234565, 2.5e12]
    values += [*near, *np.nextafter(near, 9e9), *(rng.normal(size=4_000) * 10.0 ** rng.integers(-8, 13, 4_000))]
    df = spark.createDataFrame([(v if v is None else float(v),) for v in values], "x double")
    pairs = df.withColumn("y", F.col("x")).transform(lambda d: rounded(d, 6)).select("y")
    want = df.select(F.round("x", 6).alias("y"))
    assert [repr(r["y"]) for r in pairs.collect()] == [repr(r["y"]) for r in want.collect()]
    plan = rounded(df, 6)._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan
