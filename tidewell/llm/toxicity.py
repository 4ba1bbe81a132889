"""Operator 3: toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

The kernel of two strings sums over common subsequences of four letters, where one character may stand between any
two, each weighted by DECAY to the power of its span and scaled by the strings' sizes; so gapped, spaced and padded
insults still share most of their subsequences. A string's Nystroem map is its whitened kernel with LANDMARKS passages
of labelled sentences. A linear SVM on that map folds into one weight per subsequence, so the decision on a passage of
WINDOW characters is a sum of table entries. A document scores by the norm of its DEEP worst passages, calibrated to
0..1: one that is plainly toxic is enough, several that are nearly so count together.

Training takes a bounded sample of labelled documents (SAMPLE a class, one row per id, picked by a hash of the id). Only
documents are labelled, so the toxic passages of their sentences are latent: the witness function of a plain spectrum
kernel (by how many standard errors more toxic documents hold a run of GRAMS letters than clean ones) names the first
worst passages of every sampled document; landmarks are chosen among those by pivoted Cholesky steps; then the SVM is
fitted on the worst passages of toxic and clean documents and names them again, ROUNDS times. The clean passages found
stay in the set, so it grows by those that look toxic. One document in eight of the sample calibrates the score only.
Every text is scored whole.

Cases: null and empty texts have no passage and get the score of none; texts shorter than a passage are one; digits and
signs that stand for letters count as those; Latin letters lose case; a text is read twice, with marks, which put a letter
into one of 8 further classes, and without them, and the worse reading counts (the model is learnt with them); letters of
other scripts fall into 26 classes by a hash of the code point, anything else is a gap; repeated label rows count once
(toxic if any says so); of repeated rows of one id one is learnt from; without labels of both classes nothing can be
learnt and every score is 0; one label of each class is enough; no rows give none.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import limit_arrow_batches, small_batches

GAPS = tuple((a, a + b, a + b + c) for a in (1, 2) for b in (1, 2) for c in (1, 2))  # offsets of the later letters
DECAY, SPAN, WINDOW, CLASSES = 0.9, 7, 16, 36
STARTS = WINDOW - 3
SMOOTH = 2.0  # added to the squared size of a string before it scales the features
EDGE = 27  # the class of white space and of both ends of a text: words that begin or end alike are alike
MARKED = 8  # classes after EDGE, of Latin letters with marks
SAMPLE, LANDMARKS, ROUNDS, PASSAGES, TOXIC_PASSAGES, RIDGE, HELD_OUT_FOLDS = 4000, 300, 6, 8, 4, 0.05, 5
GRAMS, BUCKETS, REACH = (6, 7), 22, 10  # the witness: letters of a run, bits of its hash, starts in a passage
LEAST_EVIDENCE, LEAST_SHARE = 5.0, 0.01  # standard errors; of the toxic documents, 3 documents at least
PIVOTS = (900, 450)  # passages of each class that landmarks are chosen from
CLEAN_WEIGHT = 2.0  # of a clean document in the calibration
SLICE = 2000  # rows of a matrix that are converted to double at once: the fit runs in the driver's memory
DEEP, NORM = 4, 3  # worst passages of a text that its score rests on, and the norm that joins them


def letter_classes(marks: bool, size: int = 0x10000) -> np.ndarray:
    """Class of each code point: 1 to 26 for letters without case, 27 for white space, 0 for others; Latin letters with
    marks fall into 28 to 35 if marks count."""
    table = np.zeros(size, np.int32)
    #: Characters that stand for letters.
    alike = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "ß": "s", "ø": "o", "æ": "a", "ı": "i", "ł": "l", "đ": "d", "œ": "o"}
    for i in range(size):
        c = chr(i).lower()
        c = alike.get(c, c)
        if len(c) == 1 and "a" <= c <= "z":
            table[i] = ord(c) - 96
        elif "a" <= unicodedata.normalize("NFD", c)[0] <= "z":
            table[i] = EDGE + 1 + ord(c[0]) % MARKED if marks else ord(unicodedata.normalize("NFD", c)[0]) - 96
        elif c.isspace():
            table[i] = EDGE
        elif c.isalpha():
            table[i] = 1 + ord(c) * 2654435761 % (1 << 32) % 26
    return table


CLASS_OF = {marks: letter_classes(marks) for marks in (False, True)}
WEIGHTS = [DECAY ** (last + 1) for _, _, last in GAPS]


def codes(text: str, marks: bool = False) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    table = CLASS_OF[marks]
    out = table[np.minimum(points, len(table) - 1)]
    high = np.flatnonzero(points >= len(table))
    out[high] = [1 + p * 2654435761 % (1 << 32) % 26 if chr(p).isalpha() else 0 for p in points[high].tolist()]
    return out


def subsequences(c: np.ndarray, gaps=GAPS) -> Iterator[np.ndarray]:
    """For each gap pattern, the table index of the subsequence at every start along the last axis (0: not four letters)."""
    n = c.shape[-1] - SPAN + 1
    dead = c == 0
    powers = [c * CLASSES**k for k in (3, 2, 1, 0)]
    for offsets in gaps:
        at, off = powers[0][..., :n].copy(), dead[..., :n].copy()
        for k, o in enumerate(offsets, 1):
            at += powers[k][..., o : o + n]
            off |= dead[..., o : o + n]
        at[off] = 0
        yield at


def occurrences(strings: list[str], marks: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """Subsequences [string, start] of each gap pattern of passages, and the passages' sizes."""
    c = np.zeros((len(strings), WINDOW + SPAN), np.int32)
    for row, s in zip(c, strings):
        own = codes(s, marks)[:WINDOW]
        row[: len(own)] = own
    at = list(subsequences(c))
    size = sum(w * w * np.count_nonzero(a, axis=1) for a, w in zip(at, WEIGHTS))
    return at, np.sqrt(size + SMOOTH)


class Nystroem:
    """Landmark map: whitened kernels with the landmarks."""

    def __init__(self, landmarks: list[str], marks: bool = False):
        self.marks = marks
        at, size = occurrences(landmarks, marks)
        seen = np.unique(np.concatenate([a.ravel() for a in at]))
        self.known = seen[seen > 0]  # subsequences that some landmark has; others never meet
        self.column = np.zeros(CLASSES**4, np.int32)
        self.column[self.known] = np.arange(1, len(self.known) + 1)
        phi = np.zeros((len(self.known) + 1, len(landmarks)), np.float32)
        for a, w in zip(at, WEIGHTS):
            np.add.at(phi, (self.column[a], np.arange(len(landmarks))[:, None]), w)
        phi[0] = 0
        phi /= size.astype(np.float32)
        self.phi = phi
        gram = (phi.T @ phi).astype(float)
        value, vector = np.linalg.eigh(gram + 1e-3 * np.eye(len(landmarks)))
        self.root = (vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6))) @ vector.T).astype(np.float32)

    def kernel(self, strings: list[str]) -> np.ndarray:
        out = np.zeros((len(strings), self.phi.shape[1]), np.float32)
        for first in range(0, len(strings), 1000):
            at, size = occurrences(strings[first : first + 1000], self.marks)
            part = out[first : first + 1000]
            for a, w in zip(at, WEIGHTS):
                for column in self.column[a].T:
                    part += np.float32(w) * self.phi[column]
            part /= size[:, None].astype(np.float32)
        return out

    def map(self, strings: list[str]) -> np.ndarray:
        out = self.kernel(strings)
        for at in range(0, len(out), SLICE):  # in place: one matrix of this size is enough
            out[at : at + SLICE] = out[at : at + SLICE] @ self.root
        return out

    def table(self, w: np.ndarray) -> np.ndarray:
        """The linear model on the map as one weight per subsequence."""
        g = np.zeros(CLASSES**4, np.float32)
        v = self.root @ w
        for at in range(0, len(self.known), SLICE):
            g[self.known[at : at + SLICE]] = self.phi[at + 1 : at + 1 + SLICE] @ v
        return g


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Squared-hinge linear SVM by Newton steps on the primal; y is 1 or -1. The bias is the last weight, unpenalised."""
    penalty = ridge * np.eye(x.shape[1] + 1)
    penalty[-1, -1] = 1e-6
    active = np.ones(len(x), bool)
    for _ in range(rounds):
        left, right = penalty.copy(), np.zeros(len(penalty))
        rows = np.flatnonzero(active)
        for at in range(0, len(rows), SLICE):
            own = rows[at : at + SLICE]
            part = np.hstack([x[own], np.ones((len(own), 1))])
            scaled = part * weight[own, None]
            left += scaled.T @ part
            right += scaled.T @ y[own]
        w = np.linalg.solve(left, right)
        now = np.concatenate([y[at : at + SLICE] * (x[at : at + SLICE] @ w[:-1] + w[-1]) < 1 for at in range(0, len(x), SLICE)])
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def worst(texts: list[str | None], table: np.ndarray, bias: float, most: int = 1, marks: bool = False) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The highest decisions on passages of each text that do not overlap, `most` at most, and where they start."""
    best, where = [np.zeros(0)] * len(texts), [np.zeros(0, int)] * len(texts)
    at = 0
    while at < len(texts):
        parts, ends, size, end = [], [], 0, at
        while end < len(texts) and (end == at or size < 500_000):
            c = codes(texts[end] or "", marks)
            parts += [[EDGE], c, [EDGE], np.zeros(WINDOW, np.int32)]  # no window reaches the next text
            size += len(c) + 2 + WINDOW
            ends.append(size)
            end += 1
        c = np.concatenate([*parts, np.zeros(SPAN, np.int32)])
        value, live = np.zeros((2, len(c) - SPAN + 1), np.float32)
        for weight, i in zip(WEIGHTS, subsequences(c)):
            value += np.float32(weight) * table[i]
            live += np.float32(weight * weight) * (i > 0)
        reach = np.minimum(np.arange(size) + STARTS, len(value))
        total = np.concatenate([[0.0], np.cumsum(value, dtype=np.float64)])
        norm = np.concatenate([[0.0], np.cumsum(live, dtype=np.float64)])
        window = (total[reach] - total[:size]) / np.sqrt(norm[reach] - norm[:size] + SMOOTH)
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        for k, (a, b) in enumerate(zip(starts.tolist(), ends)):
            own = window[a : b - WINDOW - 1]
            if b - a > WINDOW + 2:
                found = [int(np.argmax(own))]
                while len(found) < most and len(own) > WINDOW:
                    own = own.copy()
                    own[max(0, found[-1] - WINDOW + 1) : found[-1] + WINDOW] = -np.inf
                    i = int(np.argmax(own))
                    if own[i] == -np.inf:
                        break
                    found.append(i)
                best[at + k], where[at + k] = window[a + np.array(found)] + bias, np.maximum(np.array(found) - 1, 0)
        at = end
    return best, where


def joined(best) -> float:
    """One decision of a text: the norm of how far its DEEP worst decisions lie beyond -1, the margin of clean passages,
    counted from there. Equal decisions give that decision; passages that a text lacks count as the margin."""
    f = np.maximum(np.asarray(best[:DEEP], float) + 1, 0)
    return float((f**NORM).sum() / DEEP) ** (1 / NORM) - 1


def as_written(texts: list[str | None], table: np.ndarray, bias: float, most: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return worst(texts, table, bias, most, marks=True)


def worse_reading(texts: list[str | None], table: np.ndarray, bias: float, most: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """What worst() returns, by the reading with or without marks that is the worse one: marks may disguise a word."""
    best, where = as_written(texts, table, bias, most)
    marked = [i for i, t in enumerate(texts) if t and not t.isascii()]
    for i, b, w in zip(marked, *worst([texts[i] for i in marked], table, bias, most)):
        if joined(b) > joined(best[i]):
            best[i], where[i] = b, w
    return best, where


class Model:
    """Folded table, bias, and the two numbers of the calibration."""

    def __init__(self, table, bias: float, slope: float, shift: float):
        self.table, self.bias, self.slope, self.shift = table, bias, slope, shift

    def scores(self, texts: list[str | None]) -> np.ndarray:
        f = np.array([joined(b) for b in worse_reading(texts, self.table, self.bias, DEEP)[0]])
        return 1 / (1 + np.exp(-np.clip(self.slope * f + self.shift, -50, 50)))


def platt(f: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit, by Newton steps with a small ridge; clean texts weigh CLEAN_WEIGHT times as much."""
    x = np.stack([f, np.ones_like(f)], axis=1)
    weight = np.where(y > 0, 1 / max(1, (y > 0).sum()), CLEAN_WEIGHT / max(1, (y <= 0).sum())) * len(y) / (1 + CLEAN_WEIGHT)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (weight * (y - p)) - 1e-2 * (beta - [1.0, 0.0]))
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(beta[0], 0.1)), float(beta[1])


def held_out(doc_id) -> "F.Column":
    return F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_FOLDS == 0


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame | None:
    """(text, toxic, checks) of about `sample` labelled documents a class, one row an id, none of them held out; None if
    a class is missing. One in eight, of classes with ten or more, checks: it takes part in the calibration only."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not counts.get(0) or not counts.get(1):
        return None
    share = F.when(F.col("toxic") == 1, min(1.0, sample / counts[1])).otherwise(min(1.0, sample / counts[0]))
    picked = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    few = F.when(F.col("toxic") == 1, F.lit(counts[1] < 10)).otherwise(F.lit(counts[0] < 10))
    checks = (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(8)) == 0) & ~few
    # about 2 * sample ids: bounded by the parameter, whatever the input
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic", checks.alias("checks"))


def grams(c: np.ndarray) -> list[np.ndarray]:
    """Buckets of the runs of each of GRAMS letters at every start (0: not all letters)."""
    out = []
    for n in GRAMS:
        size = max(0, len(c) - n + 1)
        h, live = np.zeros(size, np.uint64), np.ones(size, bool)
        for k in range(n):
            h = h * np.uint64(CLASSES + 1) + c[k : k + size].astype(np.uint64)
            live &= c[k : k + size] > 0
        h = (h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - BUCKETS)).astype(np.int64)
        h[~live] = 0
        out.append(h)
    return out


def edged(text: str | None) -> np.ndarray:
    return np.concatenate([[EDGE], codes(text or "", True), [EDGE]])


def witness(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that stand out in toxic documents, and by how many standard errors."""
    spark = rows.sparkSession
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n0, n1 = max(1, n.get(0, 0)), max(1, n.get(1, 0))
    least = max(min(3, n1), int(LEAST_SHARE * n1))

    def counts(batches: Iterator[pa.RecordBatch], kept: np.ndarray | None = None) -> np.ndarray:
        seen = np.zeros((2, 1 << BUCKETS), np.int32)
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                i = np.unique(np.concatenate(grams(edged(text))))
                seen[toxic, i if kept is None else i[kept[i]]] += 1
        seen[:, 0] = 0
        return seen

    toxic = rows.filter("toxic = 1").select("text", "toxic")
    share = -(-least // max(1, toxic.rdd.getNumPartitions()))  # what has `least` documents has so many in some task

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(counts(batches)[1] >= share).tobytes()])], ["bits"])

    # one bit a bucket from each task
    bits = np.zeros(1 << BUCKETS >> 3, np.uint8)
    for r in toxic.mapInArrow(frequent, "bits binary").toLocalIterator():
        bits |= np.frombuffer(r.bits, np.uint8)
    shared = spark.sparkContext.broadcast(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = counts(batches, np.unpackbits(shared.value).astype(bool))
        at = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[0, at].astype(np.int64)), pa.array(seen[1, at].astype(np.int64))], ["i", "c", "t"])

    found = rows.select("text", "toxic").mapInArrow(count, "i int, c long, t long").groupBy("i").agg(F.sum("c").alias("c"), F.sum("t").alias("t")).filter(F.col("t") >= least)
    pooled = (F.col("c") + F.col("t") + 1) / (n0 + n1 + 2)
    z = ((F.col("t") + 0.5) / (n1 + 1) - (F.col("c") + 0.5) / (n0 + 1)) / F.sqrt(pooled * F.greatest(1 - pooled, F.lit(1e-3)) * (1 / n0 + 1 / n1))
    found = found.select("i", z.alias("z"))
    best = found.filter(F.col("z") >= LEAST_EVIDENCE).orderBy(F.desc("z"), "i").limit(50_000).toPandas()
    if best.empty:  # few labels: nothing stands out by itself, any evidence counts
        best = found.filter("z > 0").orderBy(F.desc("z"), "i").limit(2_000).toPandas()
    return best["i"].to_numpy(int), best["z"].to_numpy(float)


def first_passages(texts: list[str | None], at: np.ndarray, z: np.ndarray, most: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """What worst() returns, by the witness."""
    best, where = [], []
    evidence = np.zeros(1 << BUCKETS, np.float32)
    evidence[at] = z
    for text in texts:
        c = edged(text)
        value = np.zeros(len(c))
        for i in grams(c):
            value[: len(i)] += evidence[i]
        total = np.concatenate([[0.0], np.cumsum(value)])
        own = total[np.minimum(np.arange(len(c)) + REACH, len(c))] - total[:-1]
        found, f = [], []
        while len(found) < most and own.max() > -np.inf:
            i = int(np.argmax(own))
            found.append(max(0, i - 1))
            f.append(own[i])
            own[max(0, i - WINDOW + 1) : i + WINDOW] = -np.inf
        best.append(np.array(f))
        where.append(np.array(found))
    return best, where


def pick_landmarks(strings: list[str], gain: np.ndarray, most: int) -> list[str]:
    """Strings that are worth much and unlike those picked before: pivoted Cholesky steps, pivots by residual times gain."""
    at, size = occurrences(strings, True)
    phi = np.zeros((len(strings), 4096), np.float32)  # subsequences hashed with signs: near enough to choose by
    for a, w in zip(at, WEIGHTS):
        h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        np.add.at(phi, (np.arange(len(strings))[:, None], (h >> np.uint64(52)).astype(int)), np.where(a > 0, w * (1 - 2.0 * ((h >> np.uint64(40)) & np.uint64(1)).astype(int)), 0))
    phi /= size[:, None]
    gram = phi @ phi.T
    left = np.diag(gram).astype(float)
    rows, picked = np.zeros((most, len(strings))), []
    for k in range(min(most, len(strings))):
        i = int(np.argmax(left * gain))
        if left[i] < 1e-3:
            break
        rows[k] = (gram[i] - rows[:k].T @ rows[:k, i]) / np.sqrt(left[i])
        left = np.maximum(left - rows[k] ** 2, 0)
        left[i] = 0
        picked.append(i)
    return [strings[i] for i in picked]


def some(strings: list[str], most: int) -> list[str]:
    """At most so many, spread evenly."""
    return [strings[i] for i in np.unique(np.linspace(0, len(strings) - 1, most).round().astype(int))] if len(strings) > most else strings


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, landmarks: int = LANDMARKS, rounds: int = ROUNDS) -> Model | None:
    limit_arrow_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = sampled(docs, labels, sample)
    if rows is None:
        return None
    rows = rows.repartition(max(8, spark.sparkContext.defaultParallelism)).cache()
    try:

        def passages(find, *model) -> list:
            """(worst passages, decisions, toxic, checks) of each sampled document, by find(texts, *model, PASSAGES)."""
            shared = spark.sparkContext.broadcast(model)  # a few MB at most

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in (part for whole in batches for part in small_batches(whole)):
                    texts = batch.column(0).to_pylist()
                    best, where = find(texts, *shared.value, PASSAGES)
                    cut = [[(t or "")[a : a + WINDOW] for a in w.tolist()] for t, w in zip(texts, where)]
                    yield pa.RecordBatch.from_arrays([pa.array(cut, pa.list_(pa.string())), pa.array([b.tolist() for b in best], pa.list_(pa.float64())), batch.column(1), batch.column(2)], ["s", "f", "toxic", "checks"])

            found = rows.mapInArrow(run, "s array<string>, f array<double>, toxic int, checks boolean").collect()
            shared.destroy()
            return sorted(found, key=lambda r: (r.toxic, r.checks, r.s, r.f))

        evidence = witness(rows.filter("NOT checks"))
        table, bias, clean, space = np.zeros(CLASSES**4, np.float32), 0.0, {}, None
        for i in range(rounds):
            found = passages(as_written, table, bias) if i else passages(first_passages, *evidence)
            toxic = {}
            for r in found:
                if not r.checks and r.s:
                    if r.toxic:
                        least = LEAST_EVIDENCE if i == 0 else 0
                        toxic.update({s: f for k, (s, f) in enumerate(zip(r.s[:TOXIC_PASSAGES], r.f)) if k == 0 or f > least})
                    else:
                        clean.update({s: f for k, (s, f) in enumerate(zip(r.s, r.f)) if f > -1 and (i or k < 3)})
            clean = {s: f for s, f in clean.items() if s not in toxic}
            if not toxic or not clean:
                break
            if i < 2:
                nearest = sorted(clean, key=lambda s: (-clean[s], s))[: PIVOTS[1]]
                pivots, space = some(sorted(toxic), PIVOTS[0]), None
                space = Nystroem(pick_landmarks([*pivots, *nearest], np.repeat([1.0, 0.3], [len(pivots), len(nearest)]), landmarks), marks=True)
            strings, y = [*toxic, *clean], np.array([1.0] * len(toxic) + [-1.0] * len(clean))
            w, bias = svm(space.map(strings), y, np.where(y > 0, len(y) / (2 * len(toxic)), len(y) / (2 * len(clean))))
            table = space.table(w)
        final = [r for r in passages(worse_reading, table, bias) if r.f]
        checks = [r for r in final if r.checks]
        if {r.toxic for r in checks} != {0, 1}:
            checks = final
        return Model(table, bias, *platt(np.array([joined(r.f) for r in checks]), np.array([float(r.toxic) for r in checks])))
    finally:
        rows.unpersist()


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with score; texts are scored whole, in one pass without a shuffle."""
    if model is None:
        return docs.withColumn("score", F.lit(0.0))
    limit_arrow_batches(docs.sparkSession)
    shared, at, names = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in small_batches(whole)):
            values = shared.value.scores(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values)], [*names, "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "score double"])
    return docs.mapInArrow(run, schema)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    rows = score(docs, train(docs, labels))
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs without those that score 0.5 or more; columns stay."""
    if model is None:
        return docs
    packed = docs.select("text", F.struct(*docs.columns).alias("doc"))  # a column named score may exist
    return score(packed, model).filter("score < 0.5").select("doc.*")
