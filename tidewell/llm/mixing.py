"""Operator 1: mixing sources to target weights by the cube method.

Each source gets a target number of words; a document's inclusion value is target / size of its source, at most 2.
The whole part is taken for sure; the fraction is decided by the cube method: inside buckets of one source, values
move along the null space of two constraints (documents and words) until at most two of a bucket are undecided. The
undecided of all buckets form new buckets, and so on, until one bucket of a source is left, whatever other sources have.
Its last undecided documents (the landing) are rounded to the nearest word total. Long documents are decided first, by
null vectors over the whole bucket, and every round holds documents of all sizes back for the landing.

Cases: null text has size 0; null source is a source of its own, last in order; repeated rows are documents of their
own; sources of size 0 have target 0; no rows give no rows. Draws depend on ids and values only, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.llm.common import materialize

WEIGHTS, SHARE, CAP, BUCKET, RESERVE, LONG = (5.0, 2.0, 1.0), 1.5, 2.0, 1000, 12, 4.0
TINY = 1e-9


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, n_docs, target): weights by code point order of the sources, water-filled under the cap.

    One row per source meets in one sorting window (rows of a few bytes, spilled if need be), nothing per document.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank - 1) % len(weights) + 1)
    per = materialize(per.withColumn("weight", weight).withColumn("full_at", cap * F.col("source_size") / F.col("weight")), "sources")
    by = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    goal = per.agg(share * F.sum("source_size"), F.sum("weight")).first()
    if goal[0] is None:
        return per.select("source", "source_size", "n_docs", F.lit(0.0).alias("target"))
    # the level at which the first k sources are full and the others share the rest
    before = F.coalesce(F.sum(cap * F.col("source_size")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    levels = per.select("full_at", ((goal[0] - before) / open_weight).alias("level"))
    level = levels.filter(F.col("level") <= F.col("full_at") * (1 + TINY)).agg(F.max("level")).first()[0]
    level = float("inf") if level is None else level
    return per.select("source", "source_size", "n_docs", F.least(cap * F.col("source_size"), F.lit(level) * F.col("weight")).alias("target"))


def flight(x: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Move x in [0, 1] to 0 or 1 but for two values at most, keeping sum(x) and sum(x * size)."""
    rng = np.random.Generator(np.random.PCG64(seed))
    draw = rng.random(len(x)).tolist()
    v, s = x.tolist(), size.tolist()
    held: list[int] = []
    for nxt in range(len(v)):
        if not TINY < v[nxt] < 1 - TINY:
            v[nxt] = float(round(v[nxt]))
            continue
        held.append(nxt)
        if len(held) < 3:
            continue
        a, b, c = held
        u = [s[b] - s[c], s[c] - s[a], s[a] - s[b]]  # null vector of the rows (1, 1, 1) and sizes
        if u[0] == u[1] == u[2] == 0:
            u = [1.0, -1.0, 0.0]
        ways = []
        for sign in (1, -1):
            room = [(1 - v[k]) / (sign * d) if sign * d > 0 else v[k] / -(sign * d) for k, d in zip(held, u) if d]
            ways.append(min(room))
        up, down = ways
        step = up if draw[nxt] * (up + down) < down else -down
        for k, d in zip(held, u):
            v[k] = min(1.0, max(0.0, v[k] + step * d))
            if not TINY < v[k] < 1 - TINY:
                v[k] = float(round(v[k]))
        held = [k for k in held if 0 < v[k] < 1]
    return np.array(v)


def long_first(x: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Decide the documents longer than LONG times the mean of the undecided, longest first, keeping both sums.

    All undecided documents share the move (the projection of the long one onto the null space), so each gives way a
    little; a document that outweighs the others stays open.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    x = x.copy()
    is_open = (x > TINY) & (x < 1 - TINY)
    if not is_open.any():
        return x
    limit = LONG * size[is_open].mean()
    for a in np.argsort(-size, kind="stable"):
        if size[a] <= limit:
            break
        while TINY < x[a] < 1 - TINY:
            at = np.flatnonzero((x > TINY) & (x < 1 - TINY))
            away = size[at] - size[at].mean()
            spread = (away * away).sum()
            u = (at == a) - 1 / len(at) - (away * (size[a] - size[at].mean()) / spread if spread else 0.0)
            if len(at) < 3 or u[at == a][0] < 1e-3:
                break
            u[np.abs(u) < 1e-12] = 0
            moved = u != 0
            up = np.where(u > 0, 1 - x[at], x[at])[moved] / np.abs(u[moved])
            down = np.where(u > 0, x[at], 1 - x[at])[moved] / np.abs(u[moved])
            up, down = up.min(), down.min()
            x[at] = np.clip(x[at] + u * (up if rng.random() * (up + down) < down else -down), 0.0, 1.0)
    decided = (x <= TINY) | (x >= 1 - TINY)
    x[decided] = x[decided].round()
    return x


def hold_back(x: np.ndarray, size: np.ndarray, seed: int, n: int) -> np.ndarray:
    """long_first and flight, but n of the undecided documents, spread over the sizes, sit out the flight."""
    x = long_first(x, size, seed)
    open_at = np.flatnonzero((x > TINY) & (x < 1 - TINY))
    reserve = open_at[np.unique(np.linspace(0, len(open_at) - 1, n).round().astype(int))] if len(open_at) > n else open_at
    rest = np.setdiff1d(np.arange(len(x)), reserve)
    x[rest] = flight(x[rest], size[rest], seed)
    return x


def land(x: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """The last bucket of a source: RESERVE documents sit out the flight; with the two that it leaves open they form
    the landing, settled by trying every rounding for the nearest word total, then count."""
    x = hold_back(x, size, seed, RESERVE)
    last = np.flatnonzero((x > TINY) & (x < 1 - TINY))
    ways = (np.arange(1 << len(last))[:, None] >> np.arange(len(last))) & 1
    gap = ways - x[last]
    x[last] = ways[np.lexsort((np.abs(gap.sum(axis=1)), np.abs(gap @ size[last]).round(6)))[0]]
    return x.round()


def positive(c) -> "F.Column":
    return c.bitwiseAND(F.lit((1 << 63) - 1))


def by_source(rows: DataFrame, per: DataFrame) -> DataFrame:
    """rows with the columns of per, one row per source; null is a source too."""
    per = per.withColumnRenamed("source", "of_source")
    return rows.join(per, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")


def settler(bucket: int):
    """The cube's work on one bucket; the only bucket of a source lands too."""

    def settle(rows: pa.Table) -> pa.Table:
        numbers = lambda c: rows[c].combine_chunks().to_numpy(zero_copy_only=False)
        rows = rows.take(pa.array(np.lexsort((numbers("salt"), -numbers("size")))))
        x, size, salt = numbers("x"), numbers("size").astype(float), numbers("salt")
        seed, parts = int(np.bitwise_xor.reduce(salt)) & 0x7FFFFFFF, rows["parts"][0].as_py()
        x = land(x, size, seed) if parts == 1 else hold_back(x, size, seed, min(-(-RESERVE // parts), bucket // 4))
        rows = rows.set_column(rows.schema.get_field_index("x"), "x", pa.array(x, pa.float64()))
        return rows.select(["doc_id", "source", "size", "x", "salt"])

    return settle


def cube(rows: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """rows(doc_id, source, size, x in [0, 1]) with x decided: 0 or 1, balanced in every source."""
    done: list[DataFrame] = []
    schema = rows.select("doc_id", "source", "size", "x", "salt").schema
    while True:
        counts = rows.groupBy("source").agg(F.count("*").alias("m"))
        most = counts.agg(F.max("m")).first()[0]
        dealt = by_source(rows, counts).withColumn("parts", F.ceil(F.col("m") / bucket).cast("long")).withColumn("bucket", F.pmod("salt", "parts")).drop("m")
        out = materialize(dealt.groupBy("source", "bucket").applyInArrow(settler(bucket), schema), "cube")
        if most is None or most <= bucket:
            done.append(out)
            break
        done.append(out.filter("x = 0 OR x = 1"))
        # rows that the buckets left open are dealt anew
        rows = out.filter("x > 0 AND x < 1").withColumn("salt", positive(F.xxhash64("salt")))
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    return result.select("doc_id", "source", "size", "x")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row of docs."""
    count = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), count.alias("size"), F.xxhash64("doc_id", "text").alias("salt"))
    # repeated rows get numbers, so that they fall into different buckets like any others
    rows = rows.groupBy("doc_id", "source", "size", "salt").agg(F.count("*").alias("n")).withColumn("k", F.explode(F.sequence(F.lit(1), "n")))
    sizes = materialize(rows.select("doc_id", "source", "size", positive(F.xxhash64("salt", "source", "k")).alias("salt")), "sizes")
    targets = materialize(source_targets(sizes, weights, share, cap), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    per = targets.select("source", rate.alias("rate"))
    rows = by_source(sizes, per).select("doc_id", "source", "size", (F.col("rate") - F.floor("rate")).alias("x"), "salt")
    drawn = cube(rows, bucket)
    out = by_source(drawn, targets)
    copies = F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)) + F.col("x")
    copies = copies.cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
