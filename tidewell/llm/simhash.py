"""Operator 9: SimHash near-duplicates through a Gray-order hierarchical index.

Fingerprints of 64 bits are cut into six blocks. Two fingerprints at `distance` <= 4 agree in two whole blocks at
least, so each of the 15 pairs of blocks gives a table keyed by 20 to 22 bits; more fingerprints than such keys can
hold apart are cut into seven or eight blocks (35 tables of 27 bits, 70 of 32). Within a key the fingerprints are sorted
by Gray rank, so that neighbours share most bits; runs of them form nodes that keep the bit pattern all members
share and its mask, nodes form upper nodes, and a join of the tree with itself drops a pair of nodes once the
differences of the shared patterns, accumulated on the way down, exceed the distance. Keys with more than `cell`
fingerprints are dealt over pairs of chunks. A cell returns a spanning forest, not pairs, so output is linear.

Cases: null or blank text has fingerprint zero; equal texts have equal fingerprints and one component; a component's
id is its least non-null doc_id (null if none); repeated rows are returned each; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import connected_components, limit_arrow_batches, materialize, text_views

DISTANCE, SHINGLE, SEED = 4, 4, 42
CELL, FANOUT = 1000, 8
KEY_LOAD = 128  # fingerprints to a key, on average, from which longer keys are taken

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def fingerprint(raw: np.ndarray, width: int = SHINGLE) -> int:
    """Unsigned SimHash of UTF-8 bytes."""
    words = _LOWER[raw].tobytes().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    m = max(1, len(words) - width + 1)
    ends = ends[width - 1 :] if len(words) >= width else ends[-1:]
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:m].tolist(), ends.tolist())), np.uint64, m)
    ones = np.zeros(64, np.int64)
    for at in range(0, m, 1 << 14):  # bounded memory for very long texts
        ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > m).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(raw) for raw in text_views(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    limit_arrow_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


def block_count(n_codes: int, distance: int = DISTANCE) -> int:
    """Blocks to cut into so that keys stay apart: distance + 2 to distance + 4."""
    for blocks in (distance + 2, distance + 3):
        if n_codes >> (64 // blocks * (blocks - distance)) < KEY_LOAD:
            return blocks
    return distance + 4


def block_masks(distance: int = DISTANCE, blocks: int = DISTANCE + 2) -> list[int]:
    """Signed masks of every choice of blocks - distance blocks."""
    at, masks = 0, []
    for k in range(blocks):
        size = (64 - at) // (blocks - k)
        masks.append(((1 << size) - 1) << at)
        at += size
    chosen = [sum(c) for c in combinations(masks, blocks - distance)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in chosen]


def gray_rank(col: "F.Column") -> "F.Column":
    """Position of a code in the Gray sequence."""
    for shift in (1, 2, 4, 8, 16, 32):
        col = col.bitwiseXOR(F.shiftrightunsigned(col, shift))
    return col


def tree_join(codes: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of Gray-sorted codes at most `distance` bits apart."""
    levels = [(codes, np.full(len(codes), ~np.uint64(0)))]
    while len(levels[-1][0]) > FANOUT:
        pattern, mask = levels[-1]
        at = np.arange(0, len(pattern), FANOUT)
        first = np.repeat(pattern[at], FANOUT)[: len(pattern)]
        levels.append((pattern[at], np.bitwise_and.reduceat(mask, at) & ~np.bitwise_or.reduceat(pattern ^ first, at)))
    n = len(levels[-1][0])
    i, j = np.triu_indices(n)
    stack = [(len(levels) - 1, i, j)]
    step = np.arange(FANOUT)
    while stack:
        level, i, j = stack.pop()
        pattern, mask = levels[level]
        near = np.bitwise_count((pattern[i] ^ pattern[j]) & mask[i] & mask[j]) <= distance
        i, j = i[near], j[near]
        if level == 0:
            yield i[i < j], j[i < j]
            continue
        size = len(levels[level - 1][0])
        for at in range(0, len(i), 4096):
            a = np.repeat(i[at : at + 4096, None] * FANOUT + step, FANOUT, axis=1).ravel()
            b = np.tile(j[at : at + 4096, None] * FANOUT + step, (1, FANOUT)).ravel()
            real = (a <= b) & (a < size) & (b < size)
            stack.append((level - 1, a[real], b[real]))


def forest(codes: np.ndarray, distance: int) -> np.ndarray:
    """For each code the index of the least code index it is linked with, through any path inside the cell."""
    label = np.arange(len(codes))
    for i, j in tree_join(codes, distance):
        while True:
            low = np.minimum(label[i], label[j])
            if (label[i] == low).all() and (label[j] == low).all():
                break
            np.minimum.at(label, label[i], low)
            np.minimum.at(label, label[j], low)
            np.minimum.at(label, i, low)
            np.minimum.at(label, j, low)
            while not (label[label] == label).all():
                label = label[label]
    return label


def links(fps: DataFrame, distance: int = DISTANCE, cell: int = CELL, blocks: int | None = None) -> DataFrame:
    """(a, b): edges between fps(fp), distinct longs, whose components are those of all links."""
    masks = block_masks(distance, blocks or block_count(fps.count(), distance))
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("t", "key"))
    full = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).filter(F.col("n") > 1)
    rows = keyed.join(full, ["t", "key"])  # a key with one code has no pair
    chunks = F.ceil(F.col("n") / cell).cast("int")
    mine = F.pmod(F.xxhash64("fp"), chunks).cast("int")
    cells = rows.select("t", "key", "fp", mine.alias("c"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("x"))
    cells = cells.select("t", "key", F.least("c", "x").alias("ca"), F.greatest("c", "x").alias("cb"), "fp", gray_rank(F.col("fp")).alias("rank"))
    # unsigned order of the rank
    order = ["t", "key", "ca", "cb", (F.col("rank") < 0), "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            cut = boundaries(table)
            yield join_cells(table, cut)
            rest = table.slice(int(cut[-1])).combine_chunks()
        if rest is not None and len(rest):
            yield join_cells(rest, np.append(boundaries(rest), len(rest)))

    def boundaries(table: pa.Table) -> np.ndarray:
        """Starts of the cells of sorted rows."""
        new = np.zeros(len(table), bool)
        new[:1] = True
        for c in ("t", "key", "ca", "cb"):
            v = table[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new) if len(table) else np.zeros(1, np.int64)

    def join_cells(table: pa.Table, cut: np.ndarray) -> pa.RecordBatch:
        fp = table["fp"].to_numpy().astype(np.int64, copy=False)
        codes = fp.view(np.uint64)
        a, b = [], []
        size = np.diff(cut)
        two = cut[:-1][size == 2]
        two = two[np.bitwise_count(codes[two] ^ codes[two + 1]) <= distance]
        a.append(fp[two])
        b.append(fp[two + 1])
        for start, n in zip(cut[:-1][size > 2].tolist(), size[size > 2].tolist()):
            label = forest(codes[start : start + n], distance)
            linked = np.flatnonzero(label != np.arange(n))
            a.append(fp[start + linked])
            b.append(fp[start + label[linked]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    dealt = cells.repartition("t", "key", "ca", "cb").sortWithinPartitions(*order)
    return dealt.select("t", "key", "ca", "cb", "fp").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, group, component_id): group is a fingerprint that stands for the component."""
    prints = materialize(fingerprints(docs), "prints")
    codes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "codes")
    groups = connected_components(links(codes.select("fp"), distance)).withColumnRenamed("node", "fp")
    codes = codes.join(groups, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("group"))
    codes = materialize(codes, "groups")
    ids = codes.groupBy("group").agg(F.min("least").alias("component_id"))
    return prints.join(codes.join(ids, "group").select("fp", "group", "component_id"), "fp").select("doc_id", "fp", "group", "component_id")


def keep_one(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """docs with one row of each component: the first with its least doc_id (of repeated rows, one). Columns stay.

    The texts stay where they are: rows join the chosen ids by (doc_id, text hash), and only ids are grouped.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = near_duplicates(keyed, distance)
    chosen = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("group").agg(F.first("doc_id").alias("keep_id"), F.first("fp").alias("keep_fp"))
    chosen = materialize(chosen, "chosen")
    packed = docs.select(F.col("doc_id").cast("long").alias("id"), F.struct(*docs.columns).alias("doc"))
    kept = packed.join(chosen.select("keep_id").distinct(), F.col("id").eqNullSafe(F.col("keep_id")), "left_semi")
    # repeated ids: of the rows with a chosen id those stay whose component chose it, once
    again = packed.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("id").alias("again_id"))
    again = materialize(again, "again")
    if again.isEmpty():
        return kept.select("doc.*")
    once = kept.join(again, F.col("id").eqNullSafe(F.col("again_id")), "left_anti").select("doc.*")
    several = kept.join(again, F.col("id").eqNullSafe(F.col("again_id")), "left_semi")
    schema = docs.select("doc_id", "text").schema

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(raw) for raw in text_views(batch.column(0))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(fps.view(np.int64))], ["text", "id", "doc", "fp"])

    ddl = f"text {schema['text'].dataType.simpleString()}, id long, doc {docs.select(F.struct(*docs.columns).alias('d')).schema['d'].dataType.simpleString()}, fp long"
    printed = several.select(F.col("doc.text").alias("text"), "id", "doc").mapInArrow(prints, ddl)
    picked = printed.join(chosen, F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("fp") == F.col("keep_fp")))
    one = picked.groupBy("group").agg(F.first("doc").alias("doc"))
    return once.unionByName(one.select("doc.*"))
