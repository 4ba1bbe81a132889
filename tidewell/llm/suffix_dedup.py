"""Operator 6: long byte matches found by a logarithmic family of sparse suffix arrays.

The distinct texts come in batches of about `batch_bytes`, MOST_BATCHES at most. Each batch gets a suffix array of its
anchors (see repeats: at least one suffix in each run of `length` - `kgram` + 1 starts), partitioned by the hash and
sorted by the bytes of the suffix heads; suffixes with one head are one entry (head, text and position of the first,
number of them). A new batch is merge-scanned against every level that exists: a sort-merge join without a shuffle
yields the heads that both hold. Levels of equal size merge, as in a binary counter, so an entry is rewritten at most
log2(batches) times.

Suffixes that share their head with another one are then ordered to full depth: the bytes after the anchor give the
suffix array of each head's group, the bytes before it, read backwards, the prefix array, both with the longest common
prefixes of neighbours. A window of `length` bytes that starts o bytes before the anchor is repeated if and only if two
members are in one run of common prefixes of length - o at least in the former, and of o at least in the latter.

Cases: null text is empty; texts under `length` bytes are never matched; a text that occurs twice goes whole if it
has `length` bytes or more; rows with equal texts get equal results, rows may repeat; overlapping matches count (a
run of one byte is a match of itself); no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import materialize, text_key
from tidewell.llm.repeats import HOT_CLASSES, ByteUnits, Contexts, Repeats, spans_of_offsets

LENGTH, KGRAM, BATCH_BYTES, MOST_BATCHES = 200, 40, 256 << 20, 16


class LevelFamily:
    """Levels of (head, key, th, pos, n), sorted by head: sparse suffix arrays whose sizes are powers of two in batches."""

    def __init__(self, search: Repeats):
        self.search, self.levels, self.found = search, [], []

    def add(self, batch: DataFrame) -> None:
        """batch: (th, pos, key, head). Scans its suffix array against all levels, then merges levels of equal size."""
        search = self.search
        entry = batch.groupBy("head").agg(F.first("key").alias("key"), F.min(F.struct("th", "pos")).alias("at"), F.count("*").alias("n"))
        size, table = 1, search.save(entry.select("head", "key", "at.th", "at.pos", "n"), "level", "head")
        for other_size, other in self.levels:
            if other_size != size:  # an equal level is scanned by the merge below
                hits = search.spark.table(table).join(search.spark.table(other).select("head"), "head", "left_semi")
                self.found.append(materialize(hits.select("key"), "hits", search.paths))
        while self.levels and self.levels[-1][0] == size:
            other = self.levels.pop()[1]
            table, size = self.merge(other, table), 2 * size
        self.levels.append((size, table))

    def merge(self, one: str, other: str) -> str:
        search = self.search
        a, b = search.spark.table(one).alias("a"), search.spark.table(other).alias("b")
        n = F.coalesce("a.n", F.lit(0)) + F.coalesce("b.n", F.lit(0))
        both = a.join(b, "head", "full_outer").select("head", *(F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in ("key", "th", "pos")), n.alias("n"))
        table = search.save(both, "level", "head")
        search.drop(one)
        search.drop(other)
        return table

    def repeated(self) -> DataFrame:
        """Keys of the heads with two suffixes or more. Closes the family: its levels are dropped."""
        keys = [self.search.spark.table(t).filter("n > 1").select("key") for _, t in self.levels] + self.found
        out = keys[0]
        for more in keys[1:]:
            out = out.union(more)
        keys = materialize(out.distinct(), "repeated", self.search.paths)
        for _, table in self.levels:
            self.search.drop(table)
        return keys


def sorted_strings(group: np.ndarray, rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of byte strings (rows, zero after their size) within groups, and the common prefix of each with the one before.

    The first of a group has none. Shorter ones come first among strings that differ in final zeros only.
    """
    order = np.argsort(size, kind="stable")
    wide = np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()
    order = order[np.argsort(wide[order], kind="stable")]
    order = order[np.argsort(group[order], kind="stable")]
    m = rows[order]
    differ = m[1:] != m[:-1]
    same = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    same = np.minimum(same, np.minimum(size[order][1:], size[order][:-1]))
    return order, np.concatenate([[-1], np.where(group[order][1:] == group[order][:-1], same, -1)])


def longest(order: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The longest prefix that each member shares with any other of its group."""
    best = np.maximum(common, np.append(common[1:], -1))
    out = np.empty_like(best)
    out[order] = best
    return out


def matcher(length: int, kgram: int):
    """Repeated windows of contexts that share their head, from both orders and their common prefixes."""
    w = length - kgram + 1

    def match(c: Contexts):
        m = len(c.ctx)
        left = c.left
        right = np.fromiter(map(len, c.ctx), np.int64, m) - left
        after, before = np.zeros((m, length), np.uint8), np.zeros((m, w), np.uint8)
        for i, ctx in enumerate(c.ctx):
            raw = np.frombuffer(ctx, np.uint8)
            after[i, : right[i]] = raw[left[i] :]
            before[i, : left[i]] = raw[: left[i]][::-1]
        group = np.cumsum(np.concatenate([[0], c.key[1:] != c.key[:-1]]))
        by_suffix, lcp = sorted_strings(group, after, right)
        by_prefix, lcs = sorted_strings(group, before, left)
        # a window has to lie inside what the context shares to the right with one member, to the left with some other
        first, last = np.maximum(length - longest(by_suffix, lcp), 0), np.minimum(longest(by_prefix, lcs), w - 1)
        hit = np.zeros((m, w), bool)
        live = first <= last
        for o in range(w):
            rows = np.flatnonzero(live & (first <= o) & (o <= last))
            if len(rows):
                runs = np.zeros((2, m), np.int64)
                runs[0, by_suffix] = np.cumsum(lcp < length - o)
                runs[1, by_prefix] = np.cumsum(lcs < o)
                _, back, count = np.unique(runs[0, rows] * (m + 1) + runs[1, rows], return_inverse=True, return_counts=True)
                hit[rows, o] = count[back] > 1
        return spans_of_offsets(hit & c.alone[:, None])

    return match


def kept_bytes(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> bytes:
    """The bytes outside the ranges."""
    left = np.ones(len(raw), bool)
    for a, b in zip(lo, hi):
        left[a:b] = False
    return raw[left].tobytes()


def long_matches(docs: DataFrame, length: int = LENGTH, kgram: int = KGRAM, batch_bytes: int = BATCH_BYTES, hot_classes: int = HOT_CLASSES) -> DataFrame:
    """(th, n_units, n_removed, spans, kept_sha256) of each distinct text of docs that shares `length` bytes."""
    search = Repeats(docs.sparkSession, length, kgram, ByteUnits, hot_classes)
    try:
        texts = search.texts(docs, length)
        found, path = search.anchor_table(texts, heads=True)
        total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        batches = int(min(MOST_BATCHES, 1 + total // batch_bytes))
        family = LevelFamily(search)
        for b in range(batches):
            family.add(found.filter(F.pmod(F.xxhash64("th"), F.lit(batches)) == b) if batches > 1 else found)
        classes = search.classes(texts, found.join(family.repeated(), "key", "left_semi").select("th", "pos", "key"))
        search.forget(path)  # nothing reads the anchors from here on
        digest = lambda raw, lo, hi: hashlib.sha256(kept_bytes(raw, lo, hi)).hexdigest()
        return search.per_text(texts, search.spans(texts, classes, matcher(length, kgram)), digest)
    finally:
        search.close()


def remove_long_matches(docs: DataFrame, **options) -> DataFrame:
    """One row per document: its removed ranges (byte offsets) and figures."""
    matches = long_matches(docs, **options)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text_key(F.col("text")).alias("th"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    return rows.join(matches, "th", "left").select(
        "doc_id",
        "n_bytes",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
        "spans",
    )
