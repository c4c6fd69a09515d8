"""Whitening of embeddings along the principal components of their distinct vectors.

Entries become whole numbers (an offset common to all would cancel out everywhere), so equal vectors are found by equality and sums are exact. Spark does what
grows with the data: distinct vectors, their sums, the centred covariance, the projection and its check, each as
partial sums per task; only sums of a fixed number of entries (dimensions squared) meet on the driver.

Eigenpairs of that small matrix come from FEAST contour integration. Inertia counts (signs of the pivots of
the shifted covariance) cut the spectrum into intervals of few eigenvalues. For each, quadrature along a
half circle of complex shifted solves filters a subspace onto the interval, Rayleigh-Ritz extracts the pairs
from it, and the number inside must equal the interval's inertia count, so none is missed.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewsift.session import materialize

SCALE = 64
COMPONENTS = 16
#: Gauss-Legendre nodes on the half circle, eigenvalues an interval holds, and rounds of filtering.
NODES, PER_INTERVAL, ROUNDS = 12, 8, 40
#: Part of the greatest eigenvalue below which rounding alone can make an eigenvalue of a sum of doubles.
NO_VARIANCE = 1e-11
#: Rows of a batch of the projection's output, so a task holds a bounded block.
BLOCK = 4096


# --- the small symmetric matrix ------------------------------------------------------------

def inertia(v: np.ndarray, shift: float) -> int:
    """Number of eigenvalues of ``v`` below ``shift``: the negative pivots of its elimination (Sylvester)."""
    a = v - shift * np.eye(len(v))
    tiny = np.finfo(float).eps * max(1e-300, np.abs(v).max())
    below = 0
    for k in range(len(a)):
        pivot = a[k, k] if abs(a[k, k]) > tiny else tiny
        below += pivot < 0
        row = a[k + 1:, k] / pivot
        a[k + 1:, k + 1:] -= np.outer(row, a[k, k + 1:])
    return int(below)


def intervals(v: np.ndarray, count: int, per: int = PER_INTERVAL) -> list[tuple[float, float, int]]:
    """``(low, high, eigenvalues between)`` of intervals that hold the ``count`` greatest eigenvalues.

    An interval is halved while it holds more than ``per``, down to the width that doubles resolve: equal
    eigenvalues stay together.
    """
    radius = np.abs(v).sum(axis=1) - np.abs(np.diag(v))
    low, high = (np.diag(v) - radius).min(), (np.diag(v) + radius).max()  # Gershgorin
    width = max(high - low, np.abs(v).max(), 1e-300)
    low, high = low - 0.01 * width, high + 0.01 * width
    found, todo, need = [], [(low, high, 0, len(v))], count
    while todo and need > 0:  # the upper half is looked at first
        a, b, under, upto = todo.pop()
        if upto == under:
            continue
        if upto - under <= per or b - a < 1e-10 * width:
            found.append((a, b, upto - under))
            need -= upto - under
            continue
        middle, at = _cut(v, a, b)
        at = min(max(at, under), upto)
        todo += [(a, middle, under, at), (middle, b, at, upto)]
    return found


def _cut(v: np.ndarray, a: float, b: float) -> tuple[float, int]:
    """A point near the middle of ``[a, b]`` with no eigenvalue close by, and the eigenvalues below it."""
    for part in (0.5, 0.45, 0.55, 0.4, 0.6, 0.35, 0.65, 0.3, 0.7):
        at = a + part * (b - a)
        below, margin = inertia(v, at), 1e-4 * (b - a)
        if inertia(v, at - margin) == below == inertia(v, at + margin):
            break
    return at, below


def feast(v: np.ndarray, low: float, high: float, count: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` eigenpairs of ``v`` in ``[low, high]``, to double precision, by falling eigenvalue.

    The interval's contour integral of the resolvent is the projector onto the pairs inside; quadrature of it
    weighs the others down, more with every round. The subspace starts with room to spare and from a fixed seed.
    """
    d = len(v)
    size = min(d, max(count + 4, 2 * count))
    basis = np.random.default_rng(7).standard_normal((d, size))
    x, weight = np.polynomial.legendre.leggauss(nodes)
    centre, half = (low + high) / 2, (high - low) / 2
    turn = np.exp(1j * np.pi / 2 * (1 + x))  # upper half; the lower one is its mirror image
    shifts, factors = centre + half * turn, weight / 4 * half * turn
    scale = np.abs(v).max()
    for _ in range(ROUNDS):
        filtered = np.zeros((d, basis.shape[1]))
        for z, f in zip(shifts, factors):
            filtered += (f * np.linalg.solve(z * np.eye(d) - v, basis.astype(complex))).real
        # directions that the filter left out are none of the interval's
        u, s, _ = np.linalg.svd(filtered, full_matrices=False)
        q = u[:, s > s[0] * 1e-14] if s[0] > 0 else u
        ritz, mix = np.linalg.eigh(q.T @ v @ q)  # Rayleigh-Ritz
        vectors = q @ mix
        inside = (ritz >= low) & (ritz <= high)
        residual = np.linalg.norm(v @ vectors[:, inside] - vectors[:, inside] * ritz[inside], axis=0)
        if inside.sum() == count and residual.max(initial=0) <= 4e-14 * scale * np.sqrt(d):
            order = np.argsort(-ritz[inside], kind="stable")
            return ritz[inside][order], vectors[:, inside][:, order]
        basis = vectors
    raise ArithmeticError(f"{int(inside.sum())} of {count} eigenpairs found in [{low}, {high}]")


def components(v: np.ndarray, count: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The greatest ``count`` eigenvalues of a covariance and their unit vectors (as columns).

    Directions without variance, as far as doubles tell, are left out. A vector's largest entry is positive.
    """
    if not len(v) or not np.abs(v).max() > 0:
        return np.empty(0), np.empty((len(v), 0))
    count = min(count, len(v))
    parts = [feast(v, *found) for found in intervals(v, count)]
    # Rayleigh-Ritz once more over all parts: vectors of neighbouring intervals become orthogonal too
    found = np.concatenate([u for _, u in parts], axis=1)
    q = np.linalg.qr(found[:, np.argsort(-np.concatenate([e for e, _ in parts]), kind="stable")])[0]
    ritz, mix = np.linalg.eigh(q.T @ v @ q)
    values, vectors = ritz[::-1][:count], (q @ mix)[:, ::-1][:, :count]
    some = values > values[0] * NO_VARIANCE
    vectors = vectors[:, some]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values[some], vectors * sign


# --- vectors -----------------------------------------------------------------------------------

def _packed(x: np.ndarray) -> list[bytes]:
    """Each row of offsets (whole numbers) in the fewest bytes an entry; equal rows give equal bytes."""
    out = []
    reach = np.abs(x).max(axis=1, initial=0)
    for row, most in zip(x, reach):
        kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if most <= np.iinfo(k).max)
        out.append(row.astype(kind).tobytes())
    return out


def _unpacked(values: list[bytes], d: int) -> np.ndarray:
    out = np.empty((len(values), d), np.int64)
    for i, b in enumerate(values):
        out[i] = np.frombuffer(b, f"<i{len(b) // d}")
    return out


def quantised(vector: Column) -> Column:
    """``floor(64 c)`` of each entry, packed; null for a vector that is null or has null or non-finite entries."""

    @F.arrow_udf("binary")
    def pack(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            size = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            entries = batch.flatten().to_numpy(zero_copy_only=False)  # a null entry is no number
            first = np.cumsum(size) - size
            out: list[bytes | None] = [None] * len(batch)
            for d in np.unique(size[size > 0]):
                rows = np.flatnonzero(size == d)
                block = entries[first[rows, None] + np.arange(d)]
                good = np.isfinite(block).all(axis=1)
                x = np.floor(SCALE * block[good])
                if np.abs(x).max(initial=0) >= 2.0**62:
                    raise OverflowError("an entry does not fit a long")
                for i, b in zip(rows[good], _packed(x.astype(np.int64))):
                    out[i] = b
            yield pa.array(out, pa.binary())

    return pack(vector.cast("array<double>"))


def _summed(vectors: DataFrame, d: int) -> list[int]:
    """Exact sums of the packed entries, by dimension."""

    def add(batches):
        total = [0] * d
        for b in batches:
            part = _unpacked(b.column(0).to_pylist(), d).astype(object).sum(axis=0) if len(b) else [0] * d
            total = [int(a) + int(p) for a, p in zip(total, part)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(d), pa.int32()), pa.array(map(decimal.Decimal, total), pa.decimal128(38, 0))], ["i", "s"])

    rows = vectors.mapInArrow(add, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect()
    found = [0] * d
    for r in rows:
        found[r.i] = int(r.s)
    return found


def _products(vectors: DataFrame, d: int, mean: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Sum over ``vectors`` of ``y y'`` with ``y`` the centred vector times ``matrix``."""
    k = matrix.shape[1]
    upper = np.triu_indices(k)

    def multiply(batches):
        total = np.zeros((k, k))
        for b in batches:
            y = (_unpacked(b.column(0).to_pylist(), d) - mean) @ matrix
            total += y.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(total[upper])], ["i", "j", "p"])

    rows = vectors.mapInArrow(multiply, "i int, j int, p double").groupBy("i", "j").agg(F.sum("p").alias("p")).collect()
    out = np.zeros((k, k))
    for r in rows:
        out[r.i, r.j] = out[r.j, r.i] = r.p
    return out


RESULT = ("id {id}, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)`` per remaining row and component.

    Rows whose vector is null, empty, or holds null or non-finite entries are left out, and so are vectors
    of another length than most (of the greater one in a tie). ``n`` is the number of distinct vectors, of which each counts
    once. Directions without variance are no components: a table of one distinct vector, or of none, gives no
    rows, and there are never more components than dimensions. Repeated rows and null ids are rows like any
    other. Other columns are not read. A deviation or an entry beyond a long is an error.
    """
    kind = rows.schema[id_col].dataType
    schema = RESULT.format(id=kind.simpleString())
    kept = materialize(
        rows.select(F.col(id_col).alias("id"), F.size(vector_col).alias("d"), quantised(F.col(vector_col)).alias("x"))
        .where("x is not null"), "quantised")
    lengths = kept.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    empty = kept.sparkSession.createDataFrame([], schema)
    if not lengths:
        return empty
    d = lengths[0].d
    kept = kept.where(F.col("d") == d).select("id", "x")
    # every copy of a task collapses before anything is shuffled
    fit = materialize(kept.select("x").distinct(), "fit")
    n = fit.count()
    sums = _summed(fit, d)
    mean = np.array([s / n for s in sums])
    v = _products(fit, d, mean, np.eye(d)) / n
    values, vectors = components(v, count)
    k = len(values)
    if not k:
        return empty
    matrix = vectors / np.sqrt(values)
    error = float(np.abs(_products(fit, d, mean, matrix) / n - np.eye(k)).max())
    explained = values / np.trace(v)

    def project(batches):
        for b in batches:
            for at in range(0, len(b), BLOCK):
                part = b.slice(at, BLOCK)
                x = _unpacked(part.column(1).to_pylist(), d)
                m = len(x)
                white = (x - mean) @ matrix
                away = _deviations(x, n, sums)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                    pa.array(np.repeat(away, k)), pa.array(white.ravel()), pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * k, error))],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return kept.mapInArrow(project, schema)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Sums of ``(n x - S)^2``, exact; the offset of all entries cancels out."""
    reach = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if x.shape[1] * reach * reach < 2**63:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1)
    exact = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    if max(exact, default=0) >= 2**63:
        raise OverflowError("a deviation does not fit a long")
    return np.array(exact, np.int64)
