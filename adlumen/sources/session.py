"""Session settings shared by tests, bench and jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

MAX_BROADCAST_ROWS = 100_000


def local_session(cpus: int | str = 8, name: str = "adlumen", memory: str = "16g") -> SparkSession:
    """A single-machine session for tests and the bench."""
    return tune(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )


def tune(spark: SparkSession) -> SparkSession:
    """Runtime settings for the wide projections of the feature table.

    The JVM does not compile methods beyond 8,000 bytes of byte code.  Above
    that size Spark should leave whole-stage fusion for split projections,
    which do get compiled; by default it fuses up to 65,535 bytes.
    """
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores on a table that has fewer splits than cores.

    Large tables have more splits than cores and pass unchanged, so no shuffle
    is added at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def small_side(df: DataFrame, rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast a frame after counting that it is small, else merge it.

    For frames that are cheap to count: checkpointed ones, tables of files, or a
    few rows per group.  The other side of the join then needs no shuffle,
    however its rows are spread over the keys.  A larger frame must not be
    broadcast: Spark takes the size of compressed files for that of the rows, so
    by itself it would send millions of them through the driver.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df.hint("merge")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Checkpoints go to the folder the session names; a temporary one only in local mode without a name."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        context.setCheckpointDir(configured)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="adlumen-checkpoint-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")


def stored(df: DataFrame) -> DataFrame:
    """Write the frame as Parquet beside the checkpoints and go on from the files.

    For whole tables that are read more than once: columns take a fraction of
    the bytes that checkpointed rows do.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/adlumen-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write the frame to the checkpoint folder and go on from there.

    Used where a later step would otherwise compute the frame again with a
    different outcome, or where a loop would grow the plan.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
