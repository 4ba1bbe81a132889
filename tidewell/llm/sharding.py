"""Operator 11: shards by best-fit-decreasing bin packing of indivisible groups (equal texts).

Groups are put in falling order of size on the cluster; what the packing needs is only how many groups there are of each
size. Sizes are whole numbers, so groups of t bytes in all have at most sqrt(2 t) different ones (14 million of 16 bytes
for 100 TB, far fewer in practice): this histogram alone goes to the driver. There the groups of one size enter the bin
with the tightest room that still takes one, as many as it takes, then the next tightest. The bins lie in a balanced
tree by room. Each turn at a bin more than halves its room, so n bins cost n log2(capacity) turns beside one per size.
The result, runs of places in the order, goes back and is joined to the groups block by block.

With a capacity, the number of shards is what best fit needs; a group larger than the capacity has a shard of its own.
With a number of shards, the capacity is the least (to 1 in 100,000) with which best fit needs no more; groups above the
mean of what is left have shards of their own first, since no law could divide them.

Cases: the size of a row is the UTF-8 bytes of its text plus 16, null counts as the empty text (one group with it);
repeated rows are rows of their own in one group; ids may be null or repeat; no row gives no shard; with fewer groups
than shards, the last shards stay empty; other columns are ignored unless named in keep.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import delete_path, in_order, look_up, materialize, text_key

#: Bytes that a row costs beside its text.
ROW_BYTES = 16
#: Places of the order that are joined to the runs in one group, each to each.
BLOCK = 1 << 8


class Bins:
    """Open bins by (room, number) in a treap: a search tree kept balanced by random-like priorities."""

    def __init__(self):
        self.root = None

    @staticmethod
    def split(node, key):
        """The nodes below key, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            low, high = Bins.split(node[3], key)
            return (node[0], node[1], node[2], low), high
        low, high = Bins.split(node[2], key)
        return low, (node[0], node[1], high, node[3])

    @staticmethod
    def merge(a, b):
        """One tree of two, all keys of a below those of b."""
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            return a[0], a[1], a[2], Bins.merge(a[3], b)
        return b[0], b[1], Bins.merge(a, b[2]), b[3]

    def put(self, room: int, number: int) -> None:
        key = (room, number)
        low, high = self.split(self.root, key)
        self.root = self.merge(self.merge(low, (key, (number + 1) * 0x9E3779B97F4A7C15 % (1 << 64), None, None)), high)

    def take(self, least: int) -> tuple[int, int] | None:
        """The tightest bin with at least so much room; it leaves the tree."""
        node, found = self.root, None
        while node is not None:
            if node[0][0] >= least:
                found, node = node[0], node[2]
            else:
                node = node[3]
        if found is not None:
            low, high = self.split(self.root, found)
            self.root = self.merge(low, self.split(high, (found[0], found[1] + 1))[1])
        return found


def best_fit(classes: list[tuple[int, int]], capacity: int, most: int | None = None) -> tuple[list[tuple[int, int, int]], int] | None:
    """Pack classes, pairs (size, how many) in falling order of size, into bins of the capacity.

    Returns runs (first place, places, bin) over the falling order, and the number of bins; None if it is above most."""
    bins, runs, used, place = Bins(), [], 0, 0
    for size, count in classes:
        while count:
            found = bins.take(size)
            if found is None:
                if used == most:
                    return None
                found, used = (max(capacity, size), used), used + 1
            room, number = found
            n = min(count, room // size)
            runs.append((place, n, number))
            place, count, room = place + n, count - n, room - n * size
            if room:
                bins.put(room, number)
    return runs, used


def even_fit(classes: list[tuple[int, int]], shards: int) -> list[tuple[int, int, int]]:
    """Runs over at most so many shards, the largest as small as best fit allows."""
    left, alone, rest, total = shards, [], [], sum(s * n for s, n in classes)
    for size, count in classes:
        while count and left > 1 and size * left > total and not rest:
            alone.append((len(alone), 1, len(alone)))
            count, left, total = count - 1, left - 1, total - size
        if count:
            rest.append((size, count))
    if not rest:
        return alone
    low = max(rest[0][0], -(-total // left))
    best = best_fit(rest, low, left)
    if best is None:
        high = low + rest[0][0]  # always enough: a bin that refuses a group is fuller than the mean
        best = best_fit(rest, high, left)
        while high - low > max(1, low // 100_000):
            middle = (low + high) // 2
            found = best_fit(rest, middle, left)
            low, high, best = (middle, high, best) if found is None else (low, middle, found)
    return alone + [(place + len(alone), n, number + len(alone)) for place, n, number in best[0]]


def assign(docs: DataFrame, shards: int | None = None, capacity: int | None = None, keep: tuple = ("doc_id",)) -> DataFrame:
    """(doc, size, text_crc32, shard, slot) of every row of docs(text, keep): doc is a struct of the columns in keep.

    Give either the number of shards or their capacity in bytes. Slots count the rows of a shard from 0 without a gap.
    """
    if (shards is None) == (capacity is None):
        raise ValueError("give either shards or capacity")
    spark, paths = docs.sparkSession, []
    text = F.coalesce("text", F.lit(""))
    facts = docs.select(F.struct(*keep).alias("doc"), text_key("text").alias("key"), (F.octet_length(text).cast("long") + ROW_BYTES).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    facts = materialize(facts.withColumn("read_by", F.spark_partition_id()), "shard-facts", paths)
    groups = facts.groupBy("key").agg(F.count("*").alias("n"), (F.count("*") * F.first("size")).alias("bytes"))
    order = in_order(groups, [F.col("bytes").desc(), F.col("key")], "shard-groups", paths)

    sizes = order.groupBy("bytes").count().orderBy(F.desc("bytes")).toArrow()
    classes = list(zip(sizes.column(0).to_pylist(), sizes.column(1).to_pylist()))
    runs = even_fit(classes, shards) if capacity is None else best_fit(classes, capacity)[0]
    runs = pa.table({k: pa.array([r[i] for r in runs], pa.int64()) for i, k in enumerate(("place", "n", "shard"))})
    runs = spark.createDataFrame(runs).select(F.col("place").alias("first"), F.expr("place + n - 1").alias("last"), F.col("shard").cast("int").alias("shard"))
    runs = runs.withColumn("block", F.explode(F.expr(f"sequence(first div {BLOCK}, last div {BLOCK})")))

    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row per part of the order
    before = order.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("before"))
    placed = order.join(F.broadcast(before), "part").select("key", "n", (F.col("at") + F.col("before")).alias("place"))
    placed = placed.withColumn("block", F.expr(f"place div {BLOCK}"))
    placed = placed.join(runs, (placed.block == runs.block) & placed.place.between(runs["first"], runs["last"])).select("key", "n", "shard")
    rows = materialize(look_up(facts, placed, ["key"], "n", facts.count()), "shard-rows", paths)

    earlier = F.sum("n").over(Window.partitionBy("shard").orderBy("read_by").rowsBetween(Window.unboundedPreceding, -1))
    pieces = rows.groupBy("shard", "read_by").agg(F.count("*").alias("n")).select("shard", "read_by", F.coalesce(earlier, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("shard", "read_by").orderBy("key", "doc"))
    out = rows.withColumn("slot", within.cast("long")).join(pieces, ["shard", "read_by"])
    out = materialize(out.select("doc", "size", "text_crc32", "shard", (F.col("slot") + F.col("before") - 1).alias("slot")), "shards")
    for path in paths:
        delete_path(spark, path)
    return out


def report(docs: DataFrame, shards: int = 40) -> DataFrame:
    """The placement of every document in so many shards of near-equal bytes."""
    placed = assign(docs, shards=shards)
    return placed.select("doc.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write(docs: DataFrame, path: str, **kind) -> None:
    """Write whole rows into one folder per shard; kind is the shards or the capacity of assign()."""
    placed = assign(docs, keep=tuple(docs.columns), **kind)
    if "shard" in docs.columns:
        raise ValueError("docs has a column shard, the name of the folders")
    placed.select("doc.*", "shard").write.partitionBy("shard").parquet(path)
