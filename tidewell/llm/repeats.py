"""Shared by the two long-match dedups: distinct texts, sampled suffixes (anchors), their contexts, and final spans.

1. Distinct texts are stored once, bucketed by text key, so that later passes join them without moving text again.
2. Anchors: the leftmost k-gram of least hash of each window of L units. Which one a window selects depends on its
   content alone, so two equal windows have anchors at equal offsets. Hashes only choose and group anchors.
3. Each operator's own index tells which k-grams occur more than once (see suffix_dedup and rlz_dedup).
4. The context of an anchor is every unit that a window around it can reach. Equal contexts (128-bit BLAKE2 of the
   units themselves) form a class; a class with two members is repeated whole. Where one key has several classes, one
   context of each is compared by the operator's matcher, on real units, inside one task; keys with more than
   `hot_classes` classes are compared window by window, spread over the cluster by window fingerprints (four
   polynomials modulo 2^31 - 1 whose bases are drawn anew for each run, 124 bits).
"""

from __future__ import annotations

import hashlib
import secrets
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import BYTE_VALUE, delete_path, drop_shuffles, hash_words, limit_arrow_batches, materialize, mix, powers, small_batches, text_key, text_views, work_path

ROWS_OUT = 20_000
CHUNK = 1 << 20  # anchors of one text meet in rows of at most so many units
GROUP_ROWS = 3_000
HOT_CLASSES = 20_000  # contexts of one key that one task compares at most: about 10 MB
PRIME = (1 << 31) - 1


class ByteUnits:
    """A text as bytes."""

    def __init__(self, raw: np.ndarray):
        self.raw, self.hashes, self.count = raw, BYTE_VALUE[raw], len(raw)

    def cut(self, lo: int, hi: int) -> bytes:
        return self.raw[lo:hi].tobytes()

    @staticmethod
    def lengths(ctx: bytes) -> np.ndarray:
        """Sizes of the units of a cut."""
        return np.ones(len(ctx), np.int64)

    @staticmethod
    def count_of(raw: np.ndarray) -> int:
        return len(raw)


class WordUnits:
    """A text as its words, one space between two."""

    def __init__(self, raw: np.ndarray):
        self.text = b" ".join(raw.tobytes().split())
        self.hashes, self.starts, self.ends = hash_words(np.frombuffer(self.text, np.uint8))
        self.count = len(self.starts)

    def cut(self, lo: int, hi: int) -> bytes:
        return self.text[self.starts[lo] : self.ends[hi - 1]] if hi > lo else b""

    @staticmethod
    def lengths(ctx: bytes) -> np.ndarray:
        """Sizes of the units of a cut, each with the space after it."""
        return np.fromiter(map(len, ctx.split(b" ")), np.int64) + 1

    @staticmethod
    def count_of(raw: np.ndarray) -> int:
        return len(raw.tobytes().split())


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of w values, by doubling."""
    size = 1
    while size * 2 <= w:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (w - size)], h[w - size :]) if w > size else h


def anchors(hashes: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and k-gram hashes of the anchors of one text, given its units' hashes."""
    n, w = len(hashes), length - k + 1
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    power, inverse = powers(n)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * power[:n], out=prefix[1:])
    h = mix((prefix[k:] - prefix[:-k]) * inverse[: n - k + 1])
    low32 = np.uint64(0xFFFFFFFF)
    best = sliding_min((h & ~low32) | np.arange(len(h), dtype=np.uint64), w) & low32
    at = best[np.concatenate([[True], best[1:] != best[:-1]])].astype(np.int64)
    return at, h[at]


@dataclass
class Contexts:
    """What a matcher gets: one context of each class of whole keys, in order of the keys."""

    key: np.ndarray
    text: pa.Array  # keys of the texts
    pos: np.ndarray  # unit position of the anchor
    left: np.ndarray  # units before the anchor
    alone: np.ndarray  # whether the class has one member
    ctx: list[bytes]


def spans_of_offsets(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Member, first and last offset of each run of repeated windows, from hit[member, units before the anchor]."""
    step = np.diff(np.pad(hit.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    i, a = np.nonzero(step == 1)
    _, b = np.nonzero(step == -1)
    return i, a, b - 1


class WindowPrints:
    """Fingerprints of all windows of a context: four polynomials over its bytes, two to a long."""

    def __init__(self, length: int):
        self.length = length
        self.bases = [secrets.randbelow(PRIME - 1_000_000) + 500_000 for _ in range(4)]
        self.tables: list[np.ndarray] = []

    def _powers(self, n: int) -> list[np.ndarray]:
        if not self.tables or len(self.tables[0]) < n:
            size = 1 << max(10, n.bit_length())
            self.tables = []
            for base in self.bases:
                for b in (base, pow(base, -1, PRIME)):
                    t = np.ones(1, np.uint64)
                    while len(t) < size:
                        t = np.concatenate([t, t * np.uint64(pow(b, len(t), PRIME)) % np.uint64(PRIME)])
                    self.tables.append(t)
        return self.tables

    def of(self, ctx: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(sizes)
        starts = ends - sizes
        m = len(sizes) - self.length + 1
        a, b = starts[:m], ends[self.length - 1 :]
        raw = np.frombuffer(ctx + b" ", np.uint8).astype(np.uint64) + np.uint64(1)  # words end with a space each
        prime, out = np.uint64(PRIME), []
        tables = self._powers(len(raw) + 1)
        for k in range(4):
            up, down = tables[2 * k], tables[2 * k + 1]
            prefix = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(raw * up[: len(raw)] % prime, out=prefix[1:])
            out.append((prefix[b] - prefix[a]) % prime * down[a] % prime)
        shift = np.uint64(31)
        return ((out[0] << shift) | out[1]).view(np.int64), ((out[2] << shift) | out[3]).view(np.int64)


class Repeats:
    """One search; scratch tables and files are dropped by close(), all but what per_text() returns."""

    def __init__(self, spark: SparkSession, length: int, k: int, units: type, hot_classes: int = HOT_CLASSES):
        self.spark, self.length, self.k, self.units, self.hot = spark, length, k, units, hot_classes
        self.window = length - k + 1
        limit_arrow_batches(spark)
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.run, self.tables, self.paths = uuid.uuid4().hex[:10], [], []

    def save(self, df: DataFrame, name: str, key: str) -> str:
        """Store df, which is grouped or joined by key already, bucketed by it: later joins on key need no shuffle."""
        table = f"tidewell_{name}_{self.run}_{len(self.tables)}"
        with drop_shuffles(self.spark):
            df.write.option("compression", "zstd").bucketBy(self.buckets, key).sortBy(key).saveAsTable(table)
        self.tables.append(table)
        return table

    def drop(self, table: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def close(self) -> None:
        for table in self.tables:
            self.drop(table)
        for path in self.paths:
            delete_path(self.spark, path)

    def texts(self, docs: DataFrame, least_bytes: int) -> DataFrame:
        """Distinct texts (th, text, n_copies); shorter texts than any window are left out."""
        text = docs.select(text_key(F.col("text")).alias("th"), "text").filter(F.octet_length("text") >= least_bytes)
        rows = text.groupBy("th").agg(F.first("text").alias("text"), F.count("*").alias("n_copies"))
        return self.spark.table(self.save(rows, "texts", "th"))

    def anchor_table(self, texts: DataFrame, heads: bool = False) -> tuple[DataFrame, str]:
        """(th, pos, key): every anchor of every distinct text, and its path; with heads, the k-gram too (bytes only)."""
        length, k, units = self.length, self.k, self.units

        def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names, at, keys, grams, rows = batch.column(0), [], [], [], []
                total = 0
                for i, raw in enumerate(text_views(batch.column(1))):
                    p, h = anchors(units(raw).hashes, length, k)
                    if len(p):
                        at.append(p)
                        keys.append(h)
                        rows.append(np.full(len(p), i))
                        if heads:
                            grams.append(np.lib.stride_tricks.sliding_window_view(raw, k)[p])
                        total += len(p)
                    if total >= ROWS_OUT:
                        yield pack(names, rows, at, keys, grams)
                        at, keys, grams, rows, total = [], [], [], [], 0
                if total:
                    yield pack(names, rows, at, keys, grams)

        def pack(names, rows, at, keys, grams):
            columns = [names.take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(at).astype(np.int32)), pa.array(np.concatenate(keys).view(np.int64))]
            if heads:
                flat = np.ascontiguousarray(np.concatenate(grams))
                ends = pa.array(np.arange(len(flat) + 1, dtype=np.int32) * k)
                columns.append(pa.Array.from_buffers(pa.binary(), len(flat), [None, ends.buffers()[1], pa.py_buffer(flat)]))
            return pa.RecordBatch.from_arrays(columns, ["th", "pos", "key", "head"][: len(columns)])

        found = texts.select("th", "text").mapInArrow(extract, "th binary, pos int, key long" + (", head binary" if heads else ""))
        path = work_path(self.spark, "anchors")
        self.paths.append(path)
        found.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(found.schema).parquet(path), path

    def joined(self, texts: DataFrame, hits: DataFrame, *columns: str) -> DataFrame:
        """th, text, hits: the texts with the hits of each, at most about CHUNK to a row."""
        part = F.floor(F.col("pos") / CHUNK).cast("int").alias("part")
        listed = hits.repartition(self.buckets, "th").groupBy("th", part).agg(F.collect_list(F.struct("pos", *columns)).alias("hits")).drop("part")
        return texts.select("th", "text").join(listed, "th")

    def contexts(self, rows: DataFrame, columns: dict[str, pa.DataType], digest: bool) -> DataFrame:
        """(columns, th, pos, left, size, ctx): the context of each hit of joined(); with digest, cls in place of ctx."""
        length, w, units, last = self.length, self.window, self.units, "cls" if digest else "ctx"
        names = [*columns, "th", "pos", "left", "size", last]

        def cut(batches):
            for batch in (part for whole in batches for part in small_batches(whole)):
                hits = batch.column(2)
                flat, ends = hits.flatten(), hits.offsets.to_numpy() - hits.offsets[0].as_py()
                pos = flat.field("pos").to_numpy().astype(np.int64)
                done, held, ctx, lefts, sizes = 0, 0, [], [], []
                for i, raw in enumerate(text_views(batch.column(1))):
                    text = units(raw)
                    own = pos[ends[i] : ends[i + 1]]
                    lo, hi = np.maximum(own - (w - 1), 0), np.minimum(own + length, text.count)
                    lefts.append(own - lo)
                    sizes.append(hi - lo)
                    for p, a, b in zip(own.tolist(), lo.tolist(), hi.tolist()):
                        c = text.cut(a, b)
                        ctx.append(hashlib.blake2b(c, digest_size=16, salt=b"%d" % (p - a)).digest() if digest else c)
                    held += len(own)
                    if held - done >= (ROWS_OUT if digest else 2_000) or i == batch.num_rows - 1:
                        at = slice(done, held)
                        owner = np.repeat(np.arange(batch.num_rows), np.diff(ends))[at]
                        given = [flat.field(c).slice(done, held - done) for c in columns]
                        yield pa.RecordBatch.from_arrays(
                            [*given, batch.column(0).take(pa.array(owner)), pa.array(pos[at].astype(np.int32)), pa.array(np.concatenate(lefts).astype(np.int32)), pa.array(np.concatenate(sizes).astype(np.int32)), pa.array(ctx, pa.binary())],
                            names,
                        )
                        done, ctx, lefts, sizes = held, [], [], []

        kinds = {pa.int64(): "long", pa.int32(): "int"}
        ddl = ", ".join([f"{c} {kinds[t]}" for c, t in columns.items()] + ["th binary, pos int, left int, size int", f"{last} binary"])
        return rows.mapInArrow(cut, ddl)

    def classes(self, texts: DataFrame, hits: DataFrame) -> DataFrame:
        """(key, cls, th, pos, left, size) of hits(th, pos, key), whose keys are repeated."""
        out = self.contexts(self.joined(texts, hits, "key"), {"key": pa.int64()}, True)
        return materialize(out, "classes", self.paths)

    def spans(self, texts: DataFrame, classes: DataFrame, matcher: Callable) -> DataFrame:
        """(th, lo, hi): unit ranges covered by repeated windows; they may overlap.

        matcher(Contexts) returns members and the first and last offset (units before the anchor) of repeated windows.
        """
        length, units = self.length, self.units
        sizes = classes.groupBy("key", "cls").agg(F.count("*").alias("n"), F.min(F.struct("th", "pos")).alias("rep"))
        sizes = materialize(sizes.select("key", "cls", "n", "rep.th", "rep.pos"), "sizes", self.paths)
        lo = F.col("pos") - F.col("left")
        twice = sizes.filter("n > 1").select("key", "cls")
        whole = classes.join(twice, ["key", "cls"], "left_semi").select("th", lo.alias("lo"), (lo + F.col("size")).alias("hi"))
        # keys with several classes, where at least one member stands alone
        mixed = sizes.groupBy("key").agg(F.count("*").alias("kinds"), F.min("n").alias("fewest")).filter("kinds > 1 AND fewest = 1")
        reps = sizes.join(mixed.select("key", "kinds"), "key").withColumn("n", F.least("n", F.lit(2)))
        listed = self.joined(texts, reps, "key", "kinds", "n")
        cuts = materialize(self.contexts(listed, {"key": pa.int64(), "kinds": pa.int64(), "n": pa.int64()}, False), "contexts", self.paths)

        def match(table: pa.Table) -> pa.RecordBatch:
            pos = table["pos"].to_numpy().astype(np.int64)
            who = table["th"].combine_chunks()
            alone = table["n"].to_numpy() == 1
            i, a, b = matcher(Contexts(table["key"].to_numpy(), who, pos, table["left"].to_numpy().astype(np.int64), alone, table["ctx"].to_pylist()))
            return pa.RecordBatch.from_arrays([who.take(pa.array(i)), pa.array((pos[i] - b).astype(np.int32)), pa.array((pos[i] - a + length).astype(np.int32))], ["th", "lo", "hi"])

        def compare(batches):
            held: list[pa.RecordBatch] = []
            # rows come sorted by key: a chunk ends where the key changes
            size = 0
            for batch in batches:
                held.append(batch)
                size += batch.num_rows
                if size >= GROUP_ROWS:
                    table = pa.Table.from_batches(held)
                    keys = table["key"].to_numpy()
                    end = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
                    for at in pieces(keys[:end], GROUP_ROWS):
                        yield match(table.slice(at[0], at[1] - at[0]))
                    held, size = table.slice(end).combine_chunks().to_batches(), len(keys) - end
            if size:
                table = pa.Table.from_batches(held)
                for at in pieces(table["key"].to_numpy(), GROUP_ROWS):
                    yield match(table.slice(at[0], at[1] - at[0]))

        usual = cuts.filter(F.col("kinds") <= self.hot).repartition("key").sortWithinPartitions("key")
        near = usual.mapInArrow(compare, "th binary, lo int, hi int")
        prints = WindowPrints(length)

        def scatter(batches):
            for batch in (part for whole in batches for part in small_batches(whole, 500)):
                first, second, start, rows = [], [], [], []
                pos, left = batch.column("pos").to_numpy(), batch.column("left").to_numpy()
                for i, c in enumerate(batch.column("ctx").to_pylist()):
                    sizes = units.lengths(c)
                    if len(sizes) >= length:
                        one, two = prints.of(c, sizes)
                        first.append(one)
                        second.append(two)
                        start.append(np.arange(len(one)) + int(pos[i] - left[i]))
                        rows.append(np.full(len(one), i))
                if rows:
                    at = pa.array(np.concatenate(rows))
                    own = [batch.column(c).take(at) for c in ("th", "n", "kinds")]
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first)), pa.array(np.concatenate(second)), pa.array(np.concatenate(start).astype(np.int32)), *own], ["w1", "w2", "lo", "th", "n", "kinds"])

        wide = cuts.filter(F.col("kinds") > self.hot).mapInArrow(scatter, "w1 long, w2 long, lo int, th binary, n long, kinds long")
        oid = F.xxhash64("th", "lo")
        seen = wide.groupBy("w1", "w2").agg(F.min(oid).alias("a"), F.max(oid).alias("b"), F.max("kinds").alias("kinds")).filter("a <> b")
        # the members of a hot window are dealt over as many parts as its key has thousands of classes
        parts = F.ceil(F.col("kinds") / 1000).cast("int")
        seen = seen.select("w1", "w2", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        mine = wide.filter("n = 1").withColumn("part", F.pmod(oid, parts).cast("int"))
        far = mine.join(seen, ["w1", "w2", "part"], "left_semi").select("th", "lo", (F.col("lo") + length).alias("hi"))
        return whole.unionByName(near).unionByName(far)

    def per_text(self, texts: DataFrame, spans: DataFrame, digest: Callable) -> DataFrame:
        """(th, n_units, n_removed, spans, kept_sha256) of texts that lose units; digest(raw, lo, hi) hashes the rest."""
        length, units = self.length, self.units
        listed = spans.distinct().groupBy("th").agg(F.collect_list(F.struct("lo", "hi")).alias("hits"))

        def settle(batches):
            for batch in (part for whole in batches for part in small_batches(whole)):
                th, copies, hits = batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
                flat, ends = hits.flatten(), hits.offsets.to_numpy() - hits.offsets[0].as_py()
                first, last = flat.field("lo").to_numpy(), flat.field("hi").to_numpy()
                out = {c: [] for c in schema.names}
                for i, raw in enumerate(text_views(batch.column(1))):
                    n, at = units.count_of(raw), slice(ends[i], ends[i + 1])
                    if copies[i] > 1 and n >= length:
                        lo, hi = np.array([0]), np.array([n])
                    elif at.start < at.stop:
                        lo, hi = merge_ranges(first[at], last[at])
                    else:
                        continue
                    spans = [{"lo": int(a), "hi": int(b)} for a, b in zip(lo, hi)]
                    for c, v in zip(out, (th[i], n, int((hi - lo).sum()), spans, digest(raw, lo, hi))):
                        out[c].append(v)
                yield pa.RecordBatch.from_pydict(out, schema)

        schema = pa.schema([("th", pa.binary()), ("n_units", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), ("kept_sha256", pa.string())])
        ddl = "th binary, n_units long, n_removed long, spans array<struct<lo: long, hi: long>>, kept_sha256 string"
        rows = texts.join(listed, "th", "left").filter("n_copies > 1 OR hits IS NOT NULL").select("th", "text", "n_copies", F.coalesce("hits", F.array()).alias("hits"))
        return materialize(rows.mapInArrow(settle, ddl), "per-text")

    def forget(self, path: str) -> None:
        delete_path(self.spark, path)


def pieces(keys: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of about `most` rows that never split a key."""
    if not len(keys):
        return
    ends = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys))
    start = 0
    while start < len(keys):
        i = np.searchsorted(ends, start + most)
        end = int(ends[min(i, len(ends) - 1)])
        yield start, end
        start = end


def merge_ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted maximal ranges; ranges that touch are one."""
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    first = np.ones(len(lo), bool)
    first[1:] = lo[1:] > hi[:-1]
    starts = np.flatnonzero(first)
    return lo[starts], np.append(hi[starts[1:] - 1], hi[-1:])
