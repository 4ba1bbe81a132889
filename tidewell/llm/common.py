"""Helpers shared by the corpus operators: shared scratch folders, text views, connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII whitespace as the contracts define it: space and U+0009 to U+000D.
SPACE_CLASS = "[\\x20\\x09-\\x0D]"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where it is unset (tests)."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir()
    return path


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/tidewell/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def drop_shuffles(spark: SparkSession):
    """Inside, shuffle files go when the job that made them ends: what is written as a table needs them no more."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def materialize(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts lineage, survives lost executors.

    The folder is added to paths, for a caller that deletes it once nothing reads it any more.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    if paths is not None:
        paths.append(path)
    with drop_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that materialize() or an index level wrote."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def text_key(col) -> "F.Column":
    """16 bytes that identify a text (the head of its SHA-256); null counts as the empty text."""
    return F.unhex(F.substring(F.sha2(F.coalesce(col, F.lit("")), 256), 1, 32))


def text_views(column: pa.Array):
    """The UTF-8 bytes of each text of an Arrow string array as numpy views; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if data is None or n == 0:
        empty = np.zeros(0, np.uint8)
        return [empty] * n
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)
    return [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def limit_arrow_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of at most so many rows in this session: rows hold whole texts, and a batch exists several times
    at once, in the JVM's direct memory and in Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, str(rows))


def small_batches(batch: pa.RecordBatch, rows: int = 256):
    """Slices of a batch, so that what Python makes of the rows stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def hash_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, starts and ends of the whitespace-separated words of UTF-8 bytes."""
    n = len(raw)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none
    solid = np.empty(n + 2, np.int8)
    solid[0] = solid[-1] = 0
    solid[1:-1] = IS_WORD_BYTE[raw]
    step = np.diff(solid)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    power, inverse = powers(n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUE[raw] * power[:n], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * inverse[starts]), starts, ends


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
IS_WORD_BYTE = np.ones(256, np.int8)
IS_WORD_BYTE[[32, 9, 10, 11, 12, 13]] = 0
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n (or more) powers of an odd base modulo 2^64, and of its inverse."""
    if len(_POWERS[0]) < n + 1:
        size = max(1 << 14, 1 << (n + 1).bit_length())
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            _POWERS[i] = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size - 1, base, np.uint64))])
    return _POWERS[0], _POWERS[1]


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every end of edges(a, b), longs; component is the least node that can be reached.

    Alternates large-star and small-star steps (Kiveris et al.). Every step is one min-aggregation per node and one
    join, so a hub's edges are never gathered in one task. The edge list is written to the shared folder each round.
    """
    spark, paths = edges.sparkSession, []

    def settled(e: DataFrame, name: str) -> tuple[DataFrame, tuple]:
        e = materialize(e.filter("a <> b").distinct(), name, paths)
        for old in paths[:-1]:  # the rounds before
            delete_path(spark, old)
        del paths[:-1]
        sig = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return e, tuple(sig)

    # stored as a > b
    e, sig = settled(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "cc")
    for _ in range(max_rounds):
        if sig[0] == 0:
            break
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("b", "m").union(small.select(F.col("a").alias("b"), "m"))
        new, new_sig = settled(small.select(F.col("b").alias("a"), F.col("m").alias("b")), "cc")
        done, e, sig = new_sig == sig, new, new_sig
        if done:
            break
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    # a fixpoint is a set of stars: every edge leads to its least node
    leaves = e.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return leaves.union(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def in_order(df: DataFrame, keys: list, name: str, paths: list[str] | None = None) -> DataFrame:
    """df in the order of keys, with its place: the sorted part it lies in, and its position there from 0.

    Parts follow each other in the order, so part and position together order all rows. Equal rows may be split over
    parts (they are told apart by where they were read), so a hot key makes no large part. Written to the shared folder.
    """
    told = df.withColumn("_row", F.monotonically_increasing_id())
    spread = told.repartitionByRange(*keys, F.col("_row")).sortWithinPartitions(*keys, F.col("_row")).drop("_row")
    place = spread.withColumn("_at", F.monotonically_increasing_id())
    return materialize(place.selectExpr("*", "shiftright(_at, 33) part", "_at & 8589934591L at").drop("_at"), name, paths)


def look_up(rows: DataFrame, table: DataFrame, on: list[str], weight: str, total: int, share: int = 1000) -> DataFrame:
    """rows with the columns of table, whose on is unique and whose weight says how many rows have that key.

    Keys with over 1/share of the total rows, fewer than share of them, are broadcast; all others are shuffled.
    """
    hot, kept = F.col(weight) > total // share, [c for c in table.columns if c not in on and c != weight]
    told = rows.join(F.broadcast(table.filter(hot).withColumn("_hot", F.lit(True))), on, "left")
    cold = told.filter("_hot IS NULL").select(*rows.columns).join(table.filter(~hot), on, "left")
    return told.filter("_hot").select(*rows.columns, *kept).unionByName(cold.select(*rows.columns, *kept))
