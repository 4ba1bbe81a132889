"""Operator 10: substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

References are the corpus itself. An anchor index (see repeats) tells which word 10-grams occur more than once; the
passages around those are dealt to blocks by 10-gram, so a document meets exactly the blocks that share one with it. No
window of `length` words can match in any other block. A block (ReferenceBlock) is indexed by a suffix array over its
words with common prefix lengths. Each passage is parsed greedily against it: a factor is the longest run of words from
here on that also starts elsewhere in the block, else one literal word. Factors of `length` words or more are duplicate
spans. A repeated window inside no factor crosses exactly one factor boundary: the factor that starts inside it reaches
its end at least. So windows over boundaries of factors that are long enough together are looked up in the index.
10-grams with too many different passages for one block are compared window by window over the cluster (see repeats).

Cases: null text has no words; texts with fewer words than `length` are kept; equal texts with enough words go
whole, both copies; windows that overlap themselves count; repeated rows get equal results; no rows give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import materialize, text_key
from tidewell.llm.repeats import HOT_CLASSES, Contexts, Repeats, WordUnits, spans_of_offsets

LENGTH, KGRAM = 35, 10


class ReferenceBlock:
    """Suffix array of several word sequences; no match crosses from one to the next."""

    def __init__(self, passages: list[list[bytes]]):
        ids: dict[bytes, int] = {}
        size = np.fromiter(map(len, passages), np.int64, len(passages))
        flat = np.fromiter((ids.setdefault(w, len(ids)) for p in passages for w in p), np.int64, int(size.sum()))
        self.size, self.start = size, np.cumsum(size + 1) - size - 1
        n = int((size + 1).sum())
        rank = np.empty(n, np.int64)
        inside = np.ones(n, bool)
        inside[self.start + size] = False
        rank[inside] = flat + len(size)
        rank[~inside] = np.arange(len(size))  # an end of its own for each passage
        self.inside, self.ranks = inside, [rank]
        # prefix doubling: ranks[k] orders suffixes by their first 2 ** k words
        step = 1
        while step < max(size, default=0):
            behind = np.zeros(n, np.int64)
            behind[: n - step] = rank[step:] + 1
            code = rank * (n + len(size) + len(ids) + 2) + behind
            values, rank = np.unique(code, return_inverse=True)
            self.ranks.append(rank.astype(np.int32))
            step *= 2
            if len(values) == n:
                break
        order = np.argsort(rank, kind="stable")
        common = self.common(order[:-1], order[1:])
        self.longest = np.zeros(n, np.int64)  # words that also start elsewhere, from each position on
        if n > 1:
            self.longest[order] = np.maximum(np.append(common, 0), np.concatenate([[0], common]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes i and j."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), np.int64)
        last = len(self.inside) - 1
        for k in range(len(self.ranks) - 1, -1, -1):
            same = (i <= last) & (j <= last)
            same[same] = self.ranks[k][i[same]] == self.ranks[k][j[same]]
            out[same] += 1 << k
            i[same] += 1 << k
            j[same] += 1 << k
        return out

    def parse(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of the greedy factors of all passages, in order; literals have length 0."""
        at, end = self.start.copy(), self.start + self.size
        starts = []
        while True:
            at = at[(live := at < end)]
            end = end[live]
            if not len(at):
                break
            starts.append(at)
            at = at + np.maximum(self.longest[at], 1)
        starts = np.sort(np.concatenate(starts)) if starts else np.zeros(0, np.int64)
        return starts, self.longest[starts]

    def repeated(self, length: int) -> np.ndarray:
        """Starts of the windows of `length` words that also start elsewhere: those in factors, and over boundaries."""
        starts, size = self.parse()
        hit = np.zeros(len(self.inside) + length, bool)
        long = size >= length
        for s, n in zip(starts[long].tolist(), size[long].tolist()):
            hit[s : s + n - length + 1] = True
        # the factor before a boundary and the one after it, literals being one word
        width = np.maximum(size, 1)
        joint = np.flatnonzero((starts[:-1] + width[:-1] == starts[1:]) & (width[:-1] + width[1:] >= length))
        for before, at, n in zip(starts[joint].tolist(), starts[joint + 1].tolist(), width[joint + 1].tolist()):
            s = np.arange(max(before, at - length + 1), min(at, at + n - length + 1))
            hit[s[self.longest[s] >= length]] = True
        return np.flatnonzero(hit)


def matcher(length: int, kgram: int):
    """Repeated windows of the passages of one block by parsing; overlapping passages of one text are one."""
    w = length - kgram + 1

    def match(c: Contexts):
        words = [x.split(b" ") for x in c.ctx]
        lo = c.pos - c.left
        hi = lo + np.fromiter(map(len, words), np.int64, len(words))
        _, text = np.unique(np.array(c.text.to_pylist(), dtype="S16"), return_inverse=True) if len(words) else (None, lo)
        order = np.lexsort((lo, text))
        passages, owner, offset = [], np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        end, last = -1, -1
        for i in order.tolist():
            if text[i] != last or lo[i] > end:
                passages.append([])
                first, end, last = lo[i], lo[i], text[i]
            passages[-1] += words[i][max(0, end - lo[i]) :]
            end = max(end, hi[i])
            owner[i], offset[i] = len(passages) - 1, lo[i] - first
        block = ReferenceBlock(passages)
        known = np.zeros(len(block.inside) + w, bool)
        known[block.repeated(length)] = True
        # back to the contexts: a window starts o words before its anchor
        at = block.start[owner] + offset + c.left
        o = np.arange(w)
        exists = (o <= c.left[:, None]) & (length - o <= (hi - c.pos)[:, None])
        hit = known[np.maximum(at[:, None] - o, 0)] & exists
        return spans_of_offsets(hit & c.alone[:, None])

    return match


def kept_words(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> bytes:
    """Words outside the ranges, joined by one space."""
    words, out, at = raw.tobytes().split(), [], 0
    for a, b in zip(lo, hi):
        out += words[at:a]
        at = b
    return b" ".join(out + words[at:])


def factors(docs: DataFrame, length: int = LENGTH, kgram: int = KGRAM, hot_classes: int = HOT_CLASSES) -> DataFrame:
    """(th, n_units, n_removed, spans, kept_sha256) of each distinct text with a factor of `length` words or more."""
    search = Repeats(docs.sparkSession, length, kgram, WordUnits, hot_classes)
    try:
        texts = search.texts(docs, 2 * length - 1)
        found, path = search.anchor_table(texts)
        oid = F.xxhash64("th", "pos")
        index = found.groupBy("key").agg(F.min(oid).alias("first"), F.max(oid).alias("last"))
        keys = materialize(index.filter("first <> last").select("key"), "reference", search.paths)
        classes = search.classes(texts, found.join(keys, "key", "left_semi"))
        search.forget(path)
        digest = lambda raw, lo, hi: hashlib.sha256(kept_words(raw, lo, hi)).hexdigest()
        return search.per_text(texts, search.spans(texts, classes, matcher(length, kgram)), digest)
    finally:
        search.close()


def remove_factors(docs: DataFrame, **options) -> DataFrame:
    """One row per document: word ranges of its duplicate spans and figures."""
    found = factors(docs, **options)
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", text_key(F.col("text")).alias("th"), F.size(words).cast("long").alias("n_words"), F.sha2(F.array_join(words, " "), 256).alias("whole"))
    return rows.join(found, "th", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("kept_sha256", "whole").alias("kept_sha256"),
        "spans",
    )
