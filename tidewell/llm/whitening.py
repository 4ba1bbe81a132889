"""Operator 12: whitening of embeddings by an incremental eigendecomposition.

Entries become whole numbers, so counts and sums are exact and every vector is centred with the exact mean before
anything is multiplied. Each task keeps the spectrum of the scatter of its vectors. FOLD centred vectors for each dimension
are turned into a triangle of as many rows as dimensions, whose scatter is theirs, and each row is taken as a rank-one
update: entries of the update that do not matter are deflated, the new eigenvalues are the roots of the
secular equation, and the eigenvectors follow from the roots (after Gu and Eisenstat, so they stay orthogonal). Spectra
of tasks are merged FAN_IN at a time by taking the scaled eigenvectors of one as updates of another. What rounding has
spoiled in many updates is mended by a Rayleigh-Ritz step: the covariance is projected on the basis in one more pass, and
the small projected matrix is solved.

Cases: rows whose vector is null or has a null or non-finite entry are left out, as are entries beyond 2**40 (they have
no exact whole number) and vectors of another length than most have (ties: the longer); repeated vectors count as often
as they occur; repeated or null vec_ids are kept; directions without variance (below 1e-12 of the largest) cannot be
scaled, so they are no components: equal vectors, or one alone, give no rows; an empty table gives none; other columns
are ignored. deviation is null where it exceeds a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import delete_path, materialize

#: The fixed steps of the whole numbers: x = floor(SCALE * c) + OFFSET.
SCALE, OFFSET, LARGEST = 64, 1_000_000, 2.0**40
#: Spectra that one task merges.
FAN_IN = 16
#: Vectors for each dimension that are folded into one triangle; 0 takes every vector as an update of its own.
FOLD = 32
#: Updates after which a basis is made orthonormal again.
REPAIR = 512
EPS = float(np.finfo(float).eps)


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum z^2 / (d - x) = 0 for ascending, distinct d and nonzero z.

    Root i lies between d[i] and d[i + 1]. Returns the roots and the matrix d[j] - root[i] at [i, j], whose small entries
    are accurate because each root is sought as its distance from the nearer pole."""
    m, z2 = len(d), z * z
    gap = np.append(np.diff(d), z2.sum())  # the last root has no pole above it; a pole of weight 0 is put there
    below = np.tri(m, dtype=bool)
    half = 1 + (z2 / (d - (d + gap / 2)[:, None])).sum(axis=1)
    near_left = (half >= 0) | (np.arange(m) == m - 1)
    origin = np.where(near_left, d, d + gap)
    delta = d - origin[:, None]
    low, high = np.where(near_left, 0.0, -gap / 2), np.where(near_left, np.where(half >= 0, gap / 2, gap * (1 + 1e-9)), 0.0)
    first, second = np.where(near_left, 0.0, -gap), np.where(near_left, gap, 0.0)
    x, open_ = (low + high) / 2, np.ones(m, bool)
    for _ in range(100):
        far = delta - x[:, None]
        w = z2 / far
        psi, slope = np.where(below, w, 0).sum(axis=1), w / far
        f = 1 + w.sum(axis=1)
        phi, dpsi, dphi = f - 1 - psi, np.where(below, slope, 0).sum(axis=1), np.where(below, 0, slope).sum(axis=1)
        open_ &= np.abs(f) > EPS * m * (1 + np.abs(psi) + np.abs(phi))
        if not open_.any():
            break
        low, high = np.where(f < 0, x, low), np.where(f >= 0, x, high)
        one, two = first - x, second - x
        a, b, c = (one + two) * f - one * two * (dpsi + dphi), one * two * f, f - one * dpsi - two * dphi
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        with np.errstate(divide="ignore", invalid="ignore"):
            step = np.where(a > 0, 2 * b / (a + root), (a - root) / (2 * c))
        new = x + step
        new = np.where(np.isfinite(new) & (new > low) & (new < high), new, (low + high) / 2)
        if not np.any(open_ & (new != x)):
            break
        x = np.where(open_, new, x)
    return origin + x, delta - x[:, None]


def update(values: np.ndarray, basis: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum (ascending values, basis in columns) of basis diag(values) basis' + y y'."""
    z, values = basis.T @ y, values.copy()
    norm2 = z @ z
    if norm2 == 0:
        return values, basis
    small = 8 * EPS * max(values[-1], norm2)
    keep = np.abs(z) * np.sqrt(norm2) > small
    # equal values: turn the two vectors so that one of them leaves the update
    last = -1
    turned = False
    for j in np.flatnonzero(keep):
        if last >= 0 and values[j] - values[last] <= small:
            if not turned:
                basis, turned = basis.copy(), True
            r = np.hypot(z[last], z[j])
            c, s = z[j] / r, z[last] / r
            basis[:, [last, j]] = basis[:, [last, j]] @ np.array([[c, s], [-s, c]])
            z[last], z[j], keep[last] = 0.0, r, False
        last = j
    d, weights = values[keep], z[keep]
    roots, far = secular_roots(d, weights)
    # the weights for which these roots are exact
    apart = d[:, None] - d
    np.fill_diagonal(apart, 1.0)
    exact = np.sqrt(np.abs(np.prod(-far / apart, axis=0)))
    vectors = (np.copysign(exact, weights) / far).T
    vectors /= np.linalg.norm(vectors, axis=0)
    out = basis if turned else basis.copy()
    out[:, keep] = basis[:, keep] @ vectors
    values[keep] = roots
    order = np.argsort(values, kind="stable")
    return values[order], out[:, order]


def take_all(values: np.ndarray, basis: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spectrum after the rows, one update each, with a repair of the basis now and then."""
    for i, y in enumerate(rows):
        values, basis = update(values, basis, y)
        if i % REPAIR == REPAIR - 1:
            basis = orthonormal(basis)
    return values, orthonormal(basis)


def folded(rows: np.ndarray):
    """Blocks of rows as triangles with the same scatter."""
    size = rows.shape[1]
    step = FOLD * size or len(rows) or 1
    for at in range(0, len(rows), step):
        block = rows[at : at + step]
        yield np.linalg.qr(block, mode="r") if FOLD and len(block) > size else block


def orthonormal(basis: np.ndarray) -> np.ndarray:
    """The basis with the rounding of its angles removed; columns keep their direction."""
    q, r = np.linalg.qr(basis)
    return q * np.sign(np.diag(r))


def whole_numbers(column, size: int) -> np.ndarray:
    """The vectors of an Arrow list column as rows of whole numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    c = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return np.floor(SCALE * c).astype(np.int64) + OFFSET


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part, but for the length."""
    v = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & F.forall(v, lambda c: F.coalesce(F.abs(c) < LARGEST, F.lit(False))) & (F.size(v) > 0)
    return vectors.filter(fine).select("vec_id", v.alias("embedding"))


def fit(vectors: DataFrame, components: int = 32) -> dict | None:
    """The mean, axes (columns, by falling variance) and variances of the usable vectors; None without any.

    Also n, the exact sums, the size of vectors and the share of each axis in the whole variance."""
    spark, paths = vectors.sparkSession, []
    clean = usable(vectors)
    sizes = clean.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if sizes is None:
        return None
    size, n = sizes["size"], sizes["count"]
    clean = clean.filter(F.size("embedding") == size).select("embedding")

    def sum_up(batches):
        total = np.zeros(size, object)
        for b in batches:
            total = total + whole_numbers(b.column(0), size).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(size), pa.int32()), "s": pa.array([str(x) for x in total])})

    parts = clean.mapInArrow(sum_up, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    sums = [int(r.s) for r in parts.orderBy("i").collect()]
    high = np.array([s // n for s in sums], np.int64)  # the mean as whole part and rest, both exact to rounding
    rest = np.array([s % n for s in sums]) / n

    def centred(batch):
        return (whole_numbers(batch, size) - high) - rest

    def packed(values, basis):
        return {"values": pa.array([values.tolist()], pa.list_(pa.float64())), "basis": pa.array([basis.ravel().tolist()], pa.list_(pa.float64()))}

    def decompose(batches):
        values, basis, some = np.zeros(size), np.eye(size), False
        for b in batches:
            rows, times = np.unique(whole_numbers(b.column(0), size), axis=0, return_counts=True)
            some |= len(rows) > 0
            rows = ((rows - high) - rest) * np.sqrt(times)[:, None]  # equal vectors of a batch are one longer one
            for block in folded(rows):
                values, basis = take_all(values, basis, block)
        if some:
            yield pa.RecordBatch.from_pydict(packed(values, basis))

    def combine(key, table):
        table = table.sort_by("task")
        spectra = zip(table.column("values").to_pylist(), table.column("basis").to_pylist())
        values, basis = (np.array(x) for x in next(spectra))
        basis = basis.reshape(size, size)
        for more, other in spectra:
            rows = np.array(other).reshape(size, size).T * np.sqrt(np.maximum(more, 0))[:, None]
            values, basis = take_all(values, basis, rows)
        return pa.Table.from_pydict(packed(values, basis) | {"task": pa.array([key[0].as_py()], pa.int64())}).select(["task", "values", "basis"])

    kind = "task long, values array<double>, basis array<double>"
    spectra = clean.mapInArrow(decompose, "values array<double>, basis array<double>").select(F.spark_partition_id().cast("long").alias("task"), "values", "basis")
    spectra = materialize(spectra, "spectra", paths)
    while spectra.count() > 1:
        grouped = spectra.groupBy(F.expr(f"task div {FAN_IN}")).applyInArrow(combine, kind)
        spectra = materialize(grouped, "spectra", paths)
    basis = np.array(spectra.first().basis).reshape(size, size)

    def project(batches):
        h = np.zeros((size, size))
        for b in batches:
            y = centred(b.column(0)) @ basis
            h += y.T @ y
        i, j = np.triu_indices(size)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "h": pa.array(h[i, j])})

    h = np.zeros((size, size))
    for r in clean.mapInArrow(project, "i int, j int, h double").groupBy("i", "j").agg(F.sum("h").alias("h")).collect():
        h[r.i, r.j] = h[r.j, r.i] = r.h / n
    ritz, turn = np.linalg.eigh(h)
    axes, variances, trace = orthonormal(basis @ turn[:, ::-1]), ritz[::-1], float(np.trace(h))
    for path in paths:
        delete_path(spark, path)
    k = int((variances[:components] > 1e-12 * max(variances[0], 0)).sum()) if trace > 0 else 0
    return {"n": n, "size": size, "sums": sums, "high": high, "rest": rest, "axes": axes[:, :k], "variances": variances[:k], "explained": variances[:k] / trace if k else variances[:0]}


def identity_error(clean: DataFrame, model: dict) -> float:
    """The largest entry by which the covariance of the whitened vectors differs from the identity, measured."""
    size, n, k = model["size"], model["n"], len(model["variances"])
    high, rest, scaled = model["high"], model["rest"], model["axes"] / np.sqrt(model["variances"])

    def moments(batches):
        w1, w2 = np.zeros(k), np.zeros((k, k))
        for b in batches:
            w = ((whole_numbers(b.column(0), size) - high) - rest) @ scaled
            w1, w2 = w1 + w.sum(axis=0), w2 + w.T @ w
        i, j = np.triu_indices(k)
        i, j, h = np.append(i, np.full(k, -1)), np.append(j, np.arange(k)), np.append(w2[i, j], w1)
        yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "h": pa.array(h)})

    found = {(r.i, r.j): r.h / n for r in clean.select("embedding").mapInArrow(moments, "i int, j int, h double").groupBy("i", "j").agg(F.sum("h").alias("h")).collect()}
    return max(abs(h - found[-1, i] * found[-1, j] - (i == j)) for (i, j), h in found.items() if i >= 0)


def whiten(vectors: DataFrame, components: int = 32) -> DataFrame:
    """(vec_id, component from 1, n, deviation, whitened, explained, identity_error) of vectors(vec_id, embedding).

    deviation: the exact sum over dimensions of (n x - S)^2; whitened: the centred vector on the component, divided by
    its standard deviation; explained: the share of the component in the whole variance."""
    model = fit(vectors, components)
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    id_type = vectors.schema["vec_id"].dataType
    schema = f"vec_id {id_type.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if model is None or not len(model["variances"]):
        return vectors.sparkSession.createDataFrame([], schema)
    size, n, sums, high, rest = (model[x] for x in ("size", "n", "sums", "high", "rest"))
    k, explained, scaled = len(model["variances"]), model["explained"], model["axes"] / np.sqrt(model["variances"])
    clean = usable(vectors).filter(F.size("embedding") == size)
    error = identity_error(clean, model)
    remain = np.array([s % n for s in sums], object)

    def deviations(x):
        off = np.abs(x - high).max(initial=0) + 1
        if (int(off) * n) ** 2 * size < 1 << 63:
            exact = n * (x - high) - remain.astype(np.int64)
            return pa.array((exact * exact).sum(axis=1), pa.int64())
        exact = (n * (x - high).astype(object) - remain) ** 2
        return pa.array([v if v < 1 << 63 else None for v in exact.sum(axis=1).tolist()], pa.int64())

    def rows(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                x, m = whole_numbers(part.column(1), size), part.num_rows
                each = np.repeat(np.arange(m), k)
                white = (((x - high) - rest) @ scaled).ravel()
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                    deviations(x).take(pa.array(each)), pa.array(white), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ], names)

    return clean.mapInArrow(rows, schema)
