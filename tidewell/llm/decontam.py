"""Operator 2: benchmark decontamination with a generalised suffix automaton.

The items' words are one automaton (built on the driver from at most `block_words` words; a larger benchmark is taken
in blocks of items, each with its own automaton and its own pass). Documents stream through it: the state holds the
longest run of words up to here that some item contains. Runs of `window` words or more, and whole items that are
shorter, are hits. Only runs of benchmark words long enough for a hit enter the automaton.

Cases: null text and null items have no words; items without words never match; repeated items count each by its id;
a null item_id counts as the empty id; repeated documents get equal results; no items or rows: nothing is hit.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import limit_arrow_batches, materialize, small_batches, text_views

WINDOW, BLOCK_WORDS = 10, 1_000_000

#: Bytes of words: digits, letters (A-Z become a-z) and everything beyond ASCII; all others separate.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_IS_WORD = np.frombuffer(bytes(int(c != 32) for c in _FOLD), np.int8)


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the items of each window-long or whole-item match.

    States are numbers into flat arrays of 32-bit integers; nearly all have one way on, which is in the arrays too, and
    only the others have a dictionary. A window's items are a run of one flat array, so all of them together take no more
    than the words of the items, however many share a window.
    """

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.symbol, self.target = array("i", [-1]), array("i", [0])  # the first way on of each state
        self.ways: dict[int, dict[int, int]] = {}  # the further ones
        self.link, self.length = array("i", [-1]), array("i", [0])
        coded = []
        for name, words in items:
            ids = array("i", [self.vocab.setdefault(w, len(self.vocab)) for w in words])
            if ids:
                coded.append((name, ids))
                last = 0
                for c in ids:
                    last = self._extend(last, c)
        self.least = min([window, *(len(ids) for _, ids in coded)])
        self.names = [name for name, _ in coded]
        groups, members, n = array("i"), array("i"), 0  # pairs of a group and an item that is in it

        def joined(group: int, item: int) -> int:
            nonlocal n
            if group < 0:
                group, n = n, n + 1
            groups.append(group)
            members.append(item)
            return group

        self.items = array("i", [-1]) * len(self.link)  # of the window that a state stands for: its group
        self.whole: dict[int, dict[int, int]] = {}  # state of a whole short item -> its length -> group
        for item, (_, ids) in enumerate(coded):
            if len(ids) < window:
                state = 0
                for c in ids:
                    state = self.step(state, c)
                ends = self.whole.setdefault(state, {})
                ends[len(ids)] = joined(ends.get(len(ids), -1), item)
                continue
            state = size = 0
            for c in ids:
                state, size = self.step(state, c), size + 1
                state, size = self._shorten(state, min(size, window))
                if size == window:
                    self.items[state] = joined(self.items[state], item)
        # the items of group g are members[first[g]:first[g + 1]]; an item is there once for each window
        order = np.argsort(np.frombuffer(groups, np.int32), kind="stable") if n else np.zeros(0, np.int64)
        self.members = np.frombuffer(members, np.int32)[order] if n else np.zeros(0, np.int32)
        self.first = np.searchsorted(np.frombuffer(groups, np.int32)[order], np.arange(n + 1)) if n else np.zeros(1, np.int64)
        # the nearest state on the way up the links that ends a whole short item
        self.up = array("i", [-1]) * len(self.link)
        if self.whole:
            for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
                self.up[state] = state if state in self.whole else self.up[self.link[state]]

    def step(self, state: int, c: int) -> int:
        """The state that c leads to, or -1."""
        if self.symbol[state] == c:
            return self.target[state]
        more = self.ways.get(state)
        return more.get(c, -1) if more else -1

    def _lead(self, state: int, c: int, to: int) -> None:
        if self.symbol[state] in (-1, c):
            self.symbol[state], self.target[state] = c, to
        else:
            self.ways.setdefault(state, {})[c] = to

    def _new(self, link: int, length: int) -> int:
        self.symbol.append(-1)
        self.target.append(0)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _extend(self, last: int, c: int) -> int:
        q = self.step(last, c)
        if q >= 0:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = self._new(0, self.length[last] + 1)
        p = last
        while p != -1 and (q := self.step(p, c)) < 0:
            self._lead(p, c, new)
            p = self.link[p]
        if p != -1:
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = self._new(self.link[q], self.length[p] + 1)
        self.symbol[copy], self.target[copy] = self.symbol[q], self.target[q]
        if q in self.ways:
            self.ways[copy] = dict(self.ways[q])
        self.link[q] = copy
        while p != -1 and self.step(p, c) == q:
            self._lead(p, c, copy)
            p = self.link[p]
        return copy

    def _shorten(self, state: int, size: int) -> tuple[int, int]:
        while state and self.length[self.link[state]] >= size:
            state = self.link[state]
        return state, size

    def scan(self, ids: list[int], hit: np.ndarray, at: int, found: set[int]) -> None:
        """Stream ids, which stand at `at` in the document; mark hit words and collect groups of items."""
        step, link, length, up, window = self.step, self.link, self.length, self.up, self.window
        state = size = 0
        for i, c in enumerate(ids):
            to = step(state, c)
            while to < 0 and state:
                state = link[state]
                size = length[state]
                to = step(state, c)
            if to < 0:
                state = size = 0
                continue
            state, size = to, size + 1
            if size >= window:
                hit[at + i - size + 1 : at + i + 1] = True
                found.add(self.items[self._shorten(state, window)[0]])
            short = up[state]
            while short > 0:
                for n, group in self.whole[short].items():
                    if n <= size:
                        hit[at + i - n + 1 : at + i + 1] = True
                        found.add(group)
                short = up[link[short]] if link[short] > 0 else -1

    def match(self, raw: bytes) -> tuple[int, np.ndarray, set[str]]:
        """Number of words, which are hit, and the items found, of a text in UTF-8."""
        words = words_of(raw)
        n, get = len(words), self.vocab.get
        hit, found = np.zeros(n, bool), set()
        ids = np.fromiter((get(w, -1) for w in words), np.int32, n)
        step = np.diff(np.pad((ids >= 0).astype(np.int8), 1))
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        long = ends - starts >= self.least
        for a, b in zip(starts[long].tolist(), ends[long].tolist()):
            self.scan(ids[a:b].tolist(), hit, a, found)
        some = np.zeros(len(self.names), bool)
        for g in found:
            some[self.members[self.first[g] : self.first[g + 1]]] = True
        return n, hit, {self.names[k] for k in np.flatnonzero(some)} if found else set()


def block_count(rows: DataFrame, block_words: int) -> int:
    """Number of item blocks of about so many words: it follows the size of the benchmark."""
    words = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    return 1 + int((rows.agg(F.sum(words)).first()[0] or 0) // block_words)


def overlaps(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, cut: tuple[int, float] | None = None) -> DataFrame:
    """(doc, n_words, hits, items) of each row: its other columns as a struct, word ranges and sorted item ids.

    With cut (longest, coverage) the last pass applies cut_hits() instead; the result has the columns of docs.
    """
    spark, names = docs.sparkSession, docs.columns
    docs = docs.select(F.col("text").cast("string").alias("text"), F.struct(*[c for c in names if c != "text"], F.lit(0).alias("text")).alias("doc"))
    keep, at = docs.columns, 0
    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    extra = "n_words long, hits array<struct<lo: int, hi: int>>, items array<string>"
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = block_count(rows, block_words)

    def pass_over(auto, later: bool, last: bool):
        types = [pa.field("n_words", pa.int64()), pa.field("hits", pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))), pa.field("items", pa.list_(pa.string()))]

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            before = [batch.column(len(keep) + k).to_pylist() for k in range(3)] if later else None
            counts, ranges, names, texts = [], [], [], []
            for r, raw in enumerate(text_views(batch.column(at))):
                n, hit, found = auto.value.match(raw.tobytes())
                if later:
                    for x in before[1][r]:
                        hit[x["lo"] : x["hi"]] = True
                    found |= set(before[2][r])
                step = np.diff(np.pad(hit.astype(np.int8), 1))
                hits = [{"lo": int(a), "hi": int(b)} for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))]
                if last and cut:
                    texts.append(cut_hits(raw, hits, *cut, n) if hits else raw.tobytes())
                else:
                    counts.append(n)
                    ranges.append(hits)
                    names.append(sorted(found))
            columns = [batch.column(k) for k in range(len(keep))]
            if not (last and cut):
                return pa.RecordBatch.from_arrays([*columns, *(pa.array(v, f.type) for v, f in zip((counts, ranges, names), types))], names=[*keep, *(f.name for f in types)])
            known = batch.column(at).is_valid().to_pylist()
            columns[at] = pa.array([t.decode() if t is not None and ok else None for t, ok in zip(texts, known)], pa.string())
            return pa.RecordBatch.from_arrays(columns, names=keep).filter(pa.array([t is not None for t in texts]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from map(one, small_batches(batch))

        return run

    limit_arrow_batches(spark)
    result = docs
    for b in range(blocks):
        part = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else rows
        auto = spark.sparkContext.broadcast(ItemAutomaton([(r.item_id, words_of(r.text.encode())) for r in part.toLocalIterator()], window))
        last = b == blocks - 1
        result = result.mapInArrow(pass_over(auto, b > 0, last), given if last and cut else f"{given}, {extra}")
        if not last:
            result = materialize(result, "overlaps")
    return result.select(*(F.col("text") if c == "text" else F.col("doc")[c].alias(c) for c in names)) if cut else result


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: words, hit words, items and whether it is contaminated."""
    found = overlaps(docs.select("doc_id", "text"), items, window)
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda s, x: s + x["hi"] - x["lo"])
    return found.select(
        "doc.doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def cut_hits(raw: np.ndarray, hits: list, longest: int, coverage: float, n_words: int) -> bytes | None:
    """The text without hit ranges of `longest` words or more; None where hits cover too much of it."""
    if n_words and sum(h["hi"] - h["lo"] for h in hits) > coverage * n_words:
        return None
    step = np.diff(np.pad(_IS_WORD[raw], 1))
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    keep = np.ones(len(raw), bool)
    for h in hits:
        if h["hi"] - h["lo"] >= longest:
            keep[starts[h["lo"]] : ends[h["hi"] - 1]] = False
    return raw[keep].tobytes()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, longest: int = 1, coverage: float = 0.5) -> DataFrame:
    """docs without hit passages; documents covered by hits beyond `coverage` go. Columns stay; n_chars follows."""
    out = overlaps(docs, items, window, cut=(longest, coverage))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT DISTINCT doc_id, p, dw.n, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
