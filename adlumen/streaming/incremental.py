"""Batch-by-batch dedupe of arriving files.

Each micro-batch keeps the rows whose key no earlier batch held.  Keys are a
table beside the output, so the memory of past batches is on shared storage
and not in state that grows in the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from adlumen.operators.dedupe import keyed_rows, new_rows
from adlumen.streaming.keystore import KeyStore


def append_new_rows(batch: DataFrame, batch_id: int, rows: str, keys: str, columns: list[str] | None = None) -> None:
    """Append a batch's new rows under a folder named by the batch, and its keys to the store.

    A batch that is run again after a failure overwrites its own folder and
    keys, and looks only at the keys of earlier batches.
    """
    store = KeyStore(batch.sparkSession, keys)
    keyed = keyed_rows(batch, columns).persist()
    fresh = new_rows(keyed, store.known(keyed.select("row_key"), batch_id)).persist()
    try:
        fresh.drop("row_key").write.mode("overwrite").option("compression", "zstd").parquet(f"{rows}/batch={batch_id}")
        store.add(batch_id, fresh.select("row_key"))
    finally:
        fresh.unpersist()
        keyed.unpersist()
    # The batch just written may still be run again.
    store.compact(batch_id)


def dedupe_new_files(
    spark: SparkSession, source: str, schema: StructType, rows: str, keys: str, checkpoint: str, columns: list[str] | None = None
) -> None:
    """Take in the files that arrived since the last run, then stop."""
    stream = spark.readStream.schema(schema).parquet(source)
    query = (
        stream.writeStream.foreachBatch(lambda df, i: append_new_rows(df, i, rows, keys, columns))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
