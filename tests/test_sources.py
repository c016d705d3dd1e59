import os

import pytest
from pyspark.sql import functions as F

from adlumen import names
from adlumen.functions.text import norm_text
from adlumen.plans import ads
from adlumen.sources import artifacts, extract, merge, scan
from adlumen.sources.adapters import SEGMENT_MAPPING, ad_rows
from adlumen.sources.stages import StageStore, removal_report
from adlumen.streaming import incremental

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_date_shards_prune_partitions(spark, tmp_path):
    root = str(tmp_path / "t")
    df = spark.range(30).select("id", F.format_string("202501%02d", F.col("id") + 1).alias("dt"))
    scan.write_parquet(df, root, ["dt"])
    out = scan.scan_date_shards(spark, root, "20250105", "20250107")
    assert {r["id"] for r in out.collect()} == {4, 5, 6}
    files = df.sparkSession.read.parquet(root).filter("cast(dt as string) between '20250105' and '20250107'")
    assert "PartitionFilters: [" in plan_of(files) and "PushedFilters: []" in plan_of(out)
    assert len(out.inputFiles()) > 0 and scan.row_count(spark, root) == 30


def test_copy_and_text_formats(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    df = spark.range(10).selectExpr("id", "id % 2 = 0 AS flag")
    scan.write_parquet(df, a)
    scan.copy_table(spark, a, b)
    assert scan.scan_parquet(spark, b).count() == 10
    assert any(f.endswith(".zstd.parquet") for f in os.listdir(b))
    with pytest.raises(Exception, match="already exists"):
        scan.copy_table(spark, a, b)
    scan.write_csv(df, str(tmp_path / "c"))
    assert scan.read_csv(spark, str(tmp_path / "c"), "id long, flag boolean").filter("flag").count() == 5
    scan.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 10


def test_schema_drift(spark, tmp_path):
    frames = [spark.createDataFrame([(1, 2.5)], "a long, x double"), spark.createDataFrame([(2,)], "a int"),
              spark.createDataFrame([("7", 3, "new")], "a string, x int, extra string")]
    paths = [str(tmp_path / f"{i}_profile_merged") for i in range(3)]
    for f, p in zip(frames, paths):
        f.write.parquet(p)
    out = merge.merge_many(spark, paths, str(tmp_path / "all"))
    assert out.schema.simpleString() == "struct<a:string,x:double,extra:string>"
    assert {tuple(r) for r in out.collect()} == {("1", 2.5, None), ("2", None, None), ("7", 3.0, "new")}
    with pytest.raises(Exception, match="already exists"):
        merge.merge_many(spark, paths, str(tmp_path / "all"))
    with pytest.raises(ValueError, match="no input"):
        merge.merge_many(spark, [], str(tmp_path / "none"))


def test_compaction_uses_the_first_schema(spark, tmp_path):
    spark.createDataFrame([(1,)], "a int").write.parquet(str(tmp_path / "p1"))
    spark.createDataFrame([(2, "x"), (3 * 10**10, "y")], "a long, b string").write.parquet(str(tmp_path / "p2"))
    spark.createDataFrame([(99,)], "a int").write.parquet(str(tmp_path / "old_merged.parquet"))
    shards = [str(tmp_path / n) for n in ("p2", "p1", "old_merged.parquet")]
    out = merge.compact_shards(spark, shards, str(tmp_path / "one"), 1)
    assert out.columns == ["a"] and sorted(r["a"] for r in out.collect() if r["a"]) == [1, 2]
    assert out.count() == 3  # a value that does not fit becomes null


def test_shards_are_read_by_schema(spark, tmp_path):
    """As many scans as schemas; lost cells and columns are counted; wider types keep every value."""
    kinds = ["CAST(id AS int) a", "id + 30000000000 a, 'x' b", "CAST(id AS string) || 'z' a", "id * 0.5 a, id c"]
    paths = []
    for i in range(24):
        spark.range(3).selectExpr(*kinds[i % 4].split(", ")).coalesce(1).write.parquet(path := str(tmp_path / f"s{i:02d}"))
        paths.append(path)
    wide, report = merge.merge_shards(spark, paths, str(tmp_path / "wide"), files=2)
    assert (report.shards, report.scans, report.nulled_cells, report.dropped_columns) == (24, 4, 0, [])
    assert wide.schema.simpleString() == "struct<a:string,b:string,c:bigint>" and wide.filter("a IS NULL").count() == 0 and wide.count() == 72
    first, report = merge.merge_shards(spark, paths, str(tmp_path / "first"), types="first")
    assert first.schema.simpleString() == "struct<a:int>" and report.dropped_columns == ["b", "c"]
    assert report.nulled_cells == 36 == first.filter("a IS NULL").count()
    assert plan_of(merge._gathered(spark, merge.catalogue(spark, paths), first.schema)).count("FileScan") == 4


def test_export_one_pass(spark, tmp_path):
    df = spark.createDataFrame([("Urban A",), ("|urban park b",), ("urban park",), ("suburban",), (None,)], "profile string")
    mapping = [("urban", "estate"), ("Urban Park", "leisure")]
    extract.export_companies(df, mapping, str(tmp_path / "e"))
    out = {(r["company_slug"], r["business_type"]): r["count"] for r in spark.read.parquet(str(tmp_path / "e")).groupBy("company_slug", "business_type").count().collect()}
    assert out == {("urban", "estate"): 1, ("urban-park", "leisure"): 2}
    assert "Exchange" not in plan_of(extract.assign_companies(df, mapping))
    # A company's files follow its rows, not the tasks they came from.
    many = spark.range(1000, numPartitions=7).select(F.when(F.col("id") < 900, "urban park").otherwise("urban").alias("profile"))
    extract.export_companies(many, mapping, str(tmp_path / "m"), rows_per_file=150)
    files = {c: [f for f in os.listdir(tmp_path / "m" / f"company_slug={c}") if f.endswith(".parquet")] for c in ("urban", "urban-park")}
    assert len(files["urban"]) == 1 and 4 <= len(files["urban-park"]) <= 9
    assert spark.read.parquet(str(tmp_path / "m")).count() == 1000
    assert {r["company"]: r["n_rows"] for r in extract.company_counts(df, mapping, "all").collect()} == {"urban": 3, "urban park": 2}


def test_stages_are_reused(spark, tmp_path):
    calls = []

    def compute(n):
        calls.append(n)
        return spark.range(n)

    for _ in range(2):
        store = StageStore(spark, str(tmp_path))
        store.run("raw", lambda: compute(10))
        assert store.run("clean", lambda: compute(8)).count() == 8
    assert calls == [10, 8]
    assert tuple(removal_report(store.counts()).first()) == (10, 8, 2, 0.2)
    # A stage without its success marker is computed again.
    os.remove(tmp_path / "clean" / "_SUCCESS")
    StageStore(spark, str(tmp_path)).run("clean", lambda: compute(7))
    assert calls == [10, 8, 7]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_cleaning_job(spark, tmp_path):
    store = StageStore(spark, str(tmp_path))
    raw = ad_rows(spark, SF).filter("line_number <= 2")
    out = ads.clean_ads(store, raw.unionByName(raw), SEGMENT_MAPPING, fit_rows=500, n_trees=10)
    counts = {r["stage"]: r["n_rows"] for r in store.counts().collect()}
    assert counts["features"] == 2 * counts["distinct"] and counts["inliers"] == pytest.approx(0.95 * counts["distinct"], rel=0.04)
    assert not set(names.CATEGORICALS) & set(out.columns)
    stats = out.agg(F.avg("cost"), F.stddev_samp("cost")).first()
    assert stats[0] == pytest.approx(0, abs=1e-9) and stats[1] == pytest.approx(1)
    block = [c for c in out.columns if c.startswith("business_type_")]
    assert out.filter(sum(F.col(c) for c in block) != 1).count() == 0
    assert artifacts.find_scaler_params(spark, str(tmp_path)).count() > 80
    with pytest.raises(FileNotFoundError):
        artifacts.find_scaler_params(spark, str(tmp_path / "none"))


def test_older_metric_layout(spark, tmp_path):
    rows = [("clicks", "ridge", "individual", "val", n, v) for n, v in (("log_r2", 0.5), ("log_mae", 0.1), ("orig_r2", 0.2))]
    spark.createDataFrame(rows, "target string, model string, type string, split string, name string, value double").write.parquet(str(tmp_path / "m"))
    out = {r["scale"]: (r["r2"], r["mae"]) for r in artifacts.metrics_from_pairs(spark, str(tmp_path / "m")).collect()}
    assert out == {"log": (0.5, 0.1), "orig": (0.2, None)}


def test_incremental_dedupe(spark, tmp_path):
    paths = {k: str(tmp_path / k) for k in ("in", "rows", "keys", "check")}
    schema = spark.range(1).select("id", norm_text(F.lit("x")).alias("s")).schema

    def load(ids):
        spark.createDataFrame([(i, "x") for i in ids], schema).coalesce(1).write.mode("append").parquet(paths["in"])
        incremental.dedupe_new_files(spark, paths["in"], schema, paths["rows"], paths["keys"], paths["check"])
        return sorted(r["id"] for r in spark.read.parquet(paths["rows"]).select("id").collect())

    assert load([1, 2, 2]) == [1, 2]
    assert load([2, 3, 3, 4]) == [1, 2, 3, 4]
    # A batch run again after a failure gives the same rows.
    batch = spark.createDataFrame([(2, "x"), (9, "x")], schema)
    for _ in range(2):
        incremental.append_new_rows(batch, 5, paths["rows"], paths["keys"])
    assert sorted(r["id"] for r in spark.read.parquet(paths["rows"]).collect()) == [1, 2, 3, 4, 9]


def test_key_store_reads_what_may_match(spark, tmp_path):
    """New keys open no old folder, known ones only theirs, and merging batches changes nothing."""
    from adlumen.streaming.keystore import KeyStore

    def keys(lo, hi):
        return spark.range(lo, hi, numPartitions=2).select(F.md5(F.col("id").cast("string")).alias("row_key"))

    store = KeyStore(spark, str(tmp_path), buckets=4, merge=4)
    opened = []
    for b in range(6):
        opened.append(store.folders(keys(500 * b, 500 * b + 500), b).count())
        store.add(b, keys(500 * b, 500 * b + 500))
    assert sum(opened) <= 1  # a false hit is rare
    store.add(5, keys(2500, 3000))
    assert store.batches() == [0, 1, 2, 3, 4, 5]
    few = keys(700, 703)
    assert 1 <= store.folders(few, 6).count() <= 6 and store.known(few, 6).count() == 3
    assert store.known(few, 1).count() == 0 and store.known(keys(2990, 3010), 6).count() == 10
    store.compact(5)
    assert store.batches() == [4, 5]
    assert store.known(keys(0, 3100), 6).count() == 3000 and store.known(keys(0, 3100), 5).count() == 2500
