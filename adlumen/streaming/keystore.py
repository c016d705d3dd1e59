"""A growing set of row keys in hash buckets, with a Bloom filter for each file of keys.

A batch looks at the filters first, about ``BITS`` bits a key, and opens only the folders that may hold one of its keys.
So what a batch of new rows reads of the history is filters, and what a batch of known rows reads is the folders they are
in.  Every ``MERGE`` batches the older folders of each bucket become one, so their number stays small.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from adlumen.sources.session import checkpointed, small_side

# At 24 bits a key and 16 probes one key in a hundred thousand is found where it isn't.
BUCKETS, BITS, PROBES, MERGE = 64, 24, 16, 20
FILTER_SCHEMA = "bucket int, n long, bits binary"


def _bucket(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _places(hashes: np.ndarray, size: int) -> np.ndarray:
    """The bits of each key in a filter of ``size`` bits, a column per probe (double hashing)."""
    h = hashes.astype(np.uint64)
    first, step = h >> np.uint64(32), (h & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return ((first[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) % np.uint64(size)).astype(np.int64)


def bloom(hashes: np.ndarray) -> bytes:
    bits = np.zeros(max(64, -(-len(hashes) * BITS // 8) * 8), dtype=bool)
    bits[_places(hashes, len(bits)).ravel()] = True
    return np.packbits(bits).tobytes()


def may_hold(bits: bytes, hashes: np.ndarray) -> np.ndarray:
    there = np.unpackbits(np.frombuffer(bits, dtype=np.uint8)).astype(bool)
    return there[_places(hashes, len(there))].all(axis=1)


class KeyStore:
    """Keys of numbered batches under one root; a batch that is added again replaces itself."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, merge: int = MERGE):
        self.spark, self.root, self.buckets, self.merge = spark, root.rstrip("/"), buckets, merge

    def _path(self, *parts: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> list[int]:
        """The batches whose keys and filters were written whole."""
        path, files = self._path("filters")
        names = [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch=") and files.exists(path.suffix(f"/{n}/_SUCCESS")))

    def _hashed(self, keys: DataFrame) -> DataFrame:
        return keys.select("row_key", _bucket(F.col("row_key"), self.buckets).alias("bucket"), F.xxhash64(F.lit(1), "row_key").alias("h"))

    def add(self, batch: int, keys: DataFrame) -> None:
        """Write the distinct ``row_key`` of a batch, then its filters, which make it count."""
        rows = checkpointed(self._hashed(keys))

        def filters(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([(int(pdf["bucket"].iloc[0]), len(pdf), bloom(pdf["h"].to_numpy()))], columns=["bucket", "n", "bits"])

        for b in range(self.buckets):  # folders of an attempt before
            path, files = self._path("keys", f"bucket={b}", f"batch={batch}")
            files.delete(path, True)
        dealt = rows.withColumn("batch", F.lit(batch).cast("long")).repartition(self.buckets, "bucket")
        dealt.select("row_key", "bucket", "batch").write.mode("append").partitionBy("bucket", "batch").parquet(f"{self.root}/keys")
        rows.groupBy("bucket").applyInPandas(filters, FILTER_SCHEMA).write.mode("overwrite").parquet(f"{self.root}/filters/batch={batch}")

    def folders(self, keys: DataFrame, before: int) -> DataFrame:
        """``bucket, batch`` of the folders of earlier batches that may hold one of the keys."""
        earlier = [b for b in self.batches() if b < before]
        schema = "bucket int, batch long"
        if not earlier:
            return self.spark.createDataFrame([], schema)
        read = [self.spark.read.schema(FILTER_SCHEMA).parquet(f"{self.root}/filters/batch={b}").withColumn("batch", F.lit(b).cast("long")) for b in earlier]

        def hits(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            found = [(r.bucket, r.batch) for r in held.itertuples() if len(own) and may_hold(r.bits, own["h"].to_numpy()).any()]
            return pd.DataFrame(found, columns=["bucket", "batch"])

        filters = reduce(DataFrame.unionByName, read)
        return self._hashed(keys).select("bucket", "h").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(hits, schema)

    def known(self, keys: DataFrame, before: int) -> DataFrame:
        """The ``row_key`` of ``keys`` that a batch before holds.

        The folders that may hold one are a broadcast list, so the scan of the history is pruned to them.
        """
        opened = checkpointed(self.folders(keys, before))
        if opened.isEmpty():
            return self.spark.createDataFrame([], "row_key string")
        history = self.spark.read.schema("row_key string, bucket int, batch long").parquet(f"{self.root}/keys")
        return history.join(small_side(opened), ["bucket", "batch"], "left_semi").join(small_side(keys.select("row_key")), "row_key", "left_semi").select("row_key")

    def compact(self, before: int) -> None:
        """Make one batch of all those before ``before``, under the number of the last of them."""
        old = [b for b in self.batches() if b < before]
        if len(old) < max(self.merge, 2):
            return
        history = self.spark.read.schema("row_key string, bucket int, batch long").parquet(f"{self.root}/keys")
        whole = checkpointed(history.filter(F.col("batch").isin(old)).select("row_key").distinct())
        # Until the old filters are gone keys are found twice, never missed.
        self.add(old[-1], whole)
        for b in old[:-1]:
            path, files = self._path("filters", f"batch={b}")
            files.delete(path, True)
            for k in range(self.buckets):
                path, files = self._path("keys", f"bucket={k}", f"batch={b}")
                files.delete(path, True)
