"""Whitening of embeddings by spectral divide and conquer.

Spark sums the whole table, first by column and then, centred, as one small square matrix for each task. That covariance is
split on the driver, its size being the dimension alone: the polar factor U of the covariance less a shift, by QDWH iterations,
has eigenvalues 1 above the shift and -1 below, so (U + I) / 2 projects on the invariant subspace above it. Bases of both
subspaces turn the matrix into two smaller ones, and so on until single components are left. The resulting matrix is sent to
the tasks, which project every row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

EPS = np.finfo(float).eps
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this size are taken as this size, so that sums stay whole numbers.
LARGEST = 1 << 52


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a square matrix by dynamically weighted Halley iterations on QR factors.

    The weights follow a lower bound of the least singular value, so a condition of 1e16 takes about six turns; a singular
    matrix keeps arbitrary signs in its null space, which `_split` notices.
    """
    n = len(a)
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    low = max(EPS, 0.5 * _least_singular(x))
    for _ in range(40):
        d = np.cbrt(4 * max(1 - low**2, 0.0) / low**4)
        root = np.sqrt(1 + d)
        first = root + 0.5 * np.sqrt(max(8 - 4 * d + 8 * (2 - low**2) / (low**2 * root), 0.0))
        second = (first - 1) ** 2 / 4
        third = first + second - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(third) * x, np.eye(n)]))
        new = (second / third) * x + (first - second / third) / np.sqrt(third) * (q[:n] @ q[n:].T)
        low = min(1.0, low * (first + second * low**2) / (1 + third * low**2))
        moved, x = np.linalg.norm(new - x), new
        if moved < np.cbrt(EPS) and abs(1 - low) < 10 * EPS:
            break
    return x


def _least_singular(x: np.ndarray) -> float:
    """A lower estimate of the least singular value from the triangular factor."""
    r = np.linalg.qr(x, mode="r")
    d = np.abs(np.diag(r))
    if d.min() <= EPS:
        return EPS
    return 1 / (np.linalg.norm(np.linalg.solve(r, np.eye(len(r)))) + 1)


def _split(a: np.ndarray, shift: float) -> tuple[np.ndarray, int, float] | None:
    """A basis whose first columns span the invariant subspace above the shift, their number, and what remains off the blocks."""
    n = len(a)
    u = polar(a - shift * np.eye(n))
    projector = (u + u.T) / 4 + np.eye(n) / 2
    rank = int(round(np.trace(projector)))
    if not 0 < rank < n:
        return None
    basis, _ = np.linalg.qr(np.hstack([_range(projector, rank), _range(np.eye(n) - projector, n - rank)]))
    off = basis[:, :rank].T @ a @ basis[:, rank:]
    return basis, rank, float(np.linalg.norm(off))


def _mixer(rows: int, columns: int) -> np.ndarray:
    return np.random.default_rng(rows * 7919 + columns).standard_normal((rows, columns))


def _range(projector: np.ndarray, rank: int) -> np.ndarray:
    """An orthonormal basis of a projector's range: fixed random columns through it, twice."""
    q, _ = np.linalg.qr(projector @ _mixer(len(projector), rank))
    q, _ = np.linalg.qr(projector @ q)
    return q


def spectrum(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit eigenvectors as columns, each with its largest entry positive."""
    v = (v + v.T) / 2
    size = np.linalg.norm(v)
    stack, values, vectors = [(v, np.eye(len(v)))], [], []
    while stack:
        a, basis = stack.pop()
        n = len(a)
        middle = np.trace(a) / n if n else 0.0
        rest = a - middle * np.eye(n)
        if n <= 1 or np.linalg.norm(rest) <= 4 * n * EPS * size:  # one component, or equal ones: any basis will do
            values.extend(np.diag(a))
            vectors.append(basis)
            continue
        # the mean lies between the least and the largest eigenvalue; other shifts only if it hits one
        spread = np.linalg.norm(rest) / np.sqrt(n)
        best = None
        for step in (0.0, 0.1, -0.1, 0.35, -0.35, 0.7, -0.7, 0.03, -0.03, 0.003, -0.003):
            got = _split(a, middle + step * spread)
            if got is not None and (best is None or got[2] < best[2]):
                best = got
            if best is not None and best[2] <= 8 * np.sqrt(n) * EPS * size:
                break
        if best is None:  # eigenvalues that no shift tells apart
            values.extend(np.diag(a))
            vectors.append(basis)
            continue
        q, rank, _ = best
        for part in (q[:, :rank], q[:, rank:]):
            small = part.T @ a @ part
            stack.append(((small + small.T) / 2, basis @ part))
    values, vectors = np.array(values), np.hstack(vectors) if vectors else np.zeros((0, 0))
    values, vectors = _polish(v, values, vectors)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    top = np.abs(vectors).argmax(0) if len(v) else np.zeros(0, int)
    sign = np.where(vectors[top, np.arange(len(values))] < 0, -1.0, 1.0) if len(v) else np.ones(0)
    return values, vectors * sign


def _polish(v: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Newton steps on all eigenvectors together, then the nearest orthogonal matrix: split subspaces to double precision."""
    n = len(v)
    for _ in range(2 if n > 1 else 0):
        slack = np.eye(n) - vectors.T @ vectors
        seen = vectors.T @ v @ vectors
        values = np.diag(seen) / np.maximum(1 - np.diag(slack), 0.5)
        gap = values[None, :] - values[:, None]
        close = np.abs(gap) <= 2 * (np.linalg.norm(seen - np.diag(values)) + np.linalg.norm(v) * np.linalg.norm(slack)) + EPS * np.linalg.norm(v)
        step = np.where(close, slack / 2, (seen + values[None, :] * slack) / np.where(close, 1.0, gap))
        vectors = polar(vectors + vectors @ step)
    return np.einsum("ij,ij->j", vectors, v @ vectors), vectors


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Whole numbers floor(64 c) + 1000000 of vectors that are known to be complete."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    return np.clip(np.floor(SCALE * flat), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, whole numbers."""
    return n * x - sums


def _deviation(c: np.ndarray) -> pa.Array:
    """Sums of squares of whole numbers; null where a sum has no place in 64 bits."""
    near = (c.astype(np.float64) ** 2).sum(1)
    total = (c * c).sum(1, dtype=np.int64) if len(c) else np.zeros(0, np.int64)
    wide = np.flatnonzero(near > 9e18)
    out = total.astype(object)
    for i in wide:
        exact = sum(int(y) ** 2 for y in c[i])
        out[i] = exact if exact < 1 << 63 else None
    return pa.array(out.tolist(), pa.int64()) if len(wide) else pa.array(total)


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is whole: not null, not empty, every entry a finite number. `isnan(x - x)` is true for infinities too."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double") - c.cast("double")))
    return vectors.filter(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)


class Whitening:
    """mean (as n and sums), components as columns, their variances, the trace, and the largest error of the identity."""

    def __init__(self, n: int, sums: np.ndarray, values: np.ndarray, vectors: np.ndarray, trace: float):
        self.n, self.sums, self.values, self.vectors, self.trace = n, sums, values, vectors, trace
        floor = len(sums) * EPS * max(float(values[0]), 0.0) if len(values) else 0.0
        self.real = values > floor  # a component without variance cannot be scaled to one: it is 0 for every row
        self.weights = vectors / np.sqrt(np.where(self.real, values, 1.0)) * self.real
        self.identity_error = 0.0

    def apply(self, x: np.ndarray) -> np.ndarray:
        return (_centred(x, self.n, self.sums) / self.n) @ self.weights


def _partial_sums(rows: DataFrame, dim: int, product: Callable[[np.ndarray], np.ndarray]) -> list[Row]:
    """The sum over all rows of product(x): one small array for each task, added up in Spark by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for a in range(0, batch.num_rows, 1 << 14):
                got = product(_matrix(batch.column(0).slice(a, 1 << 14), dim))
                total = got if total is None else total + got
        if total is not None:
            flat = total.ravel()
            whole = flat if flat.dtype == np.int64 else np.zeros(len(flat), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat.astype(np.float64)), pa.array(whole)], ["at", "value", "whole"])

    parts = rows.mapInArrow(run, "at long, value double, whole long").groupBy("at").agg(F.sum("value").alias("value"), F.sum("whole").alias("whole"))
    return sorted(parts.collect(), key=lambda r: r["at"])  # the square of the dimension at most


def fit(vectors: DataFrame, vector: str = "embedding", most: int = 32, dim: int | None = None) -> Whitening | None:
    """Learn from every complete vector; None when there is none. See `whiten` for rows of another length."""
    rows = usable(vectors, vector)
    if dim is None:
        dim = common_length(vectors, vector)
    if dim is None:
        return None
    rows = rows.filter(F.size(vector) == dim).select(vector)

    def sums_of(x: np.ndarray) -> np.ndarray:
        return np.concatenate([[len(x)], x.sum(0)]).astype(np.int64)

    first = np.array([r["whole"] for r in _partial_sums(rows, dim, sums_of)], np.int64)
    n, sums = int(first[0]), first[1:]

    def scatter(x: np.ndarray) -> np.ndarray:
        c = _centred(x, n, sums) / n
        return c.T @ c

    v = np.array([r["value"] for r in _partial_sums(rows, dim, scatter)]).reshape(dim, dim) / n
    values, basis = spectrum(v)
    model = Whitening(n, sums, values[:most], basis[:, :most], float(np.trace(v)))

    def gram(x: np.ndarray) -> np.ndarray:
        w = model.apply(x)
        return np.vstack([w.sum(0)[None, :], w.T @ w])

    k = len(model.values)
    seen = np.array([r["value"] for r in _partial_sums(rows, dim, gram)]).reshape(k + 1, k)
    mean = seen[0] / n
    error = np.abs(seen[1:] / n - np.outer(mean, mean) - np.diag(model.real.astype(float)))
    model.identity_error = float(error.max())
    return model


def common_length(vectors: DataFrame, vector: str) -> int | None:
    """The length most complete vectors have; of equally frequent ones the longest. Null without any."""
    got = usable(vectors, vector).groupBy(F.size(vector).alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return got["dim"] if got else None


def whiten(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", most: int = 32, dim: int | None = None) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): one row per complete vector and component.

    Vectors that are null, empty or hold a null, NaN or infinity go, and so do those of another length than `dim`, by default the
    most common one. Repeated rows each count and give rows; null keys stay; other columns are not read. An empty table gives
    no rows. Components beyond the rank of the covariance are 0 for every row and left out of identity_error. deviation is null
    where the sum does not fit into 64 bits. Four short passes over the input, no shuffle of rows.
    """
    if dim is None:
        dim = common_length(vectors, vector)
    model = fit(vectors, vector, most, dim)
    rows = usable(vectors, vector).select(F.col(key).alias("key"), F.col(vector).alias("vector"))
    kind = rows.schema["key"].dataType.simpleString()
    if model is None:
        empty = rows.limit(0).select(F.col("key").alias(key), F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"))
        return empty.withColumns({c: F.lit(0.0) for c in ("whitened", "explained", "identity_error")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1 << 13):
                part = batch.slice(a, 1 << 13)
                x = _matrix(part.column(1), dim)
                told = model.apply(x)
                k = told.shape[1]
                cells = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(told.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), _deviation(_centred(x, model.n, model.sums)), cells], ["key", "deviation", "told"])

    told = rows.filter(F.size("vector") == dim).mapInArrow(run, f"key {kind}, deviation long, told array<double>")
    share = F.array(*[F.lit(float(e / model.trace) if model.trace > 0 else 0.0) for e in model.values])
    each = told.select("key", "deviation", F.posexplode("told").alias("at", "whitened"))
    return each.select(
        F.col("key").alias(key),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(share, F.col("at") + 1).alias("explained"),
        F.lit(model.identity_error).alias("identity_error"),
    )
