"""Stage store: each stage of a job is a table that is reused when complete."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


class StageStore:
    """Tables under one root folder, one per stage."""

    def __init__(self, spark: SparkSession, root: str, force: bool = False):
        self.spark, self.root, self.force = spark, root.rstrip("/"), force
        self.order: list[str] = []
        self.changed = False

    def path(self, stage: str) -> str:
        return f"{self.root}/{stage}"

    def done(self, stage: str) -> bool:
        """True when the stage's write was committed."""
        jvm = self.spark.sparkContext._jvm
        marker = jvm.org.apache.hadoop.fs.Path(f"{self.path(stage)}/_SUCCESS")
        return marker.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)

    def _settings(self, stage: str) -> str | None:
        path = f"{self.root}/_settings/{stage}"
        return self.spark.read.text(path).first()[0] if self.done(f"_settings/{stage}") else None

    def run(self, stage: str, compute: Callable[[], DataFrame], **settings) -> DataFrame:
        """Read the stage if it is there with the same settings, else compute and write it.

        Once a stage was computed, those after it are too: they read its result.
        """
        wanted = json.dumps(settings, sort_keys=True, default=str)
        if self.force or self.changed or not self.done(stage) or self._settings(stage) != wanted:
            self.changed = True
            compute().write.mode("overwrite").option("compression", "zstd").parquet(self.path(stage))
            self.spark.createDataFrame([(wanted,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/_settings/{stage}")
        self.order.append(stage)
        return self.spark.read.parquet(self.path(stage))

    def counts(self) -> DataFrame:
        """Rows of every stage that ran, counted from file footers."""
        rows = [(i, s, self.spark.read.parquet(self.path(s)).count()) for i, s in enumerate(self.order)]
        return self.spark.createDataFrame(rows, "position int, stage string, n_rows long")


def removal_report(counts: DataFrame) -> DataFrame:
    """Original, final and removed rows over all stages.

    ``counts`` holds ``position, stage, n_rows``.
    """
    out = counts.agg(
        F.min_by("n_rows", "position").alias("original_rows"),
        F.max_by("n_rows", "position").alias("final_rows"),
    )
    removed = F.col("original_rows") - F.col("final_rows")
    return out.withColumn("removed_rows", removed).withColumn(
        "removed_share", F.try_divide(removed.cast("double"), F.col("original_rows").cast("double"))
    )
