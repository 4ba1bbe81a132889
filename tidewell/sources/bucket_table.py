"""A keyed table in hash buckets, rewritten bucket by bucket: a small batch rewrites few of them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.manifest import Store
from tidewell.sources.tables import upsert

BUCKET = "_bucket"


def bucket(keys: list[str], buckets: int):
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class BucketTable:
    """Rows with unique keys below root. The manifest tells the folder of every bucket and the last batch written.

    A lost write leaves folders that no manifest names; readers keep what the manifest before named.
    """

    def __init__(self, spark: SparkSession, root: str, keys: list[str], buckets: int = 64):
        self.spark, self.store, self.keys = spark, Store(spark, root), keys
        self.number, self.state = self.store.latest()
        self.buckets = self.state.get("buckets", buckets)  # fixed by the first write

    def read(self, only: list[int] | None = None) -> DataFrame | None:
        """The rows of the given buckets, or of all; None before the first write."""
        if not self.number:
            return None
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(self.state["schema"])
        homes = [f"{self.store.root}/{f}/{BUCKET}={b}" for b, f in self.state["homes"].items() if only is None or int(b) in only]
        if not homes:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*homes)

    def upsert(self, batch: DataFrame, order: list[str], created: str | None = None, number: int | None = None) -> int:
        """Write batch over equal keys, as tables.upsert() does; returns how many buckets were rewritten.

        A batch whose number is not above the last one has been written before and changes nothing."""
        if number is not None and number <= self.state.get("batch", -1):
            return 0
        rows = batch.withColumn(BUCKET, bucket(self.keys, self.buckets))
        touched = sorted(r[0] for r in rows.select(BUCKET).distinct().collect())  # at most the number of buckets
        homes, name = dict(self.state.get("homes", {})), f"rows-{uuid.uuid4().hex[:12]}"
        if touched:
            old = self.read([b for b in touched if str(b) in homes])
            new = upsert(batch.limit(0) if old is None else old, batch, self.keys, order, created).drop("status")
            new.withColumn(BUCKET, bucket(self.keys, self.buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.store.root}/{name}")
            homes |= {str(b): name for b in touched}
        state = {
            "buckets": self.buckets, "homes": homes, "folders": sorted(set(homes.values())), "schema": self.state.get("schema") or batch.schema.jsonValue(),
            "batch": self.state.get("batch", -1) if number is None else number,
        }
        self.store.commit(self.number, state)
        self.number, self.state = self.number + 1, state
        return len(touched)
