"""Whitening of embedding vectors: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: A vector's entry c counts as floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Components of a result at most.
COMPONENTS = 32
#: Entries of this size and more have no whole number of 64 bits and don't count as finite.
HUGE = float(1 << 55)


@dataclass
class Whitening:
    """What whiten() needs: the number of fitted vectors, whole numbers near their means, what the sums exceed these by, and
    the eigenvalues (falling) and unit eigenvectors (columns) of the covariance."""

    n: int = 0
    near: list[int] = field(default_factory=list)
    totals: list[int] = field(default_factory=list)
    eigenvalues: np.ndarray = field(default_factory=lambda: np.zeros(0))
    components: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    trace: float = 0.0

    @property
    def size(self) -> int:
        return len(self.near)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x less the sums, exact: 64-bit numbers, or Python's where they don't fit."""
        y, t = x - np.array(self.near, np.int64), np.array(self.totals, object)
        if float(np.abs(y).max(initial=0)) * self.n + max(map(abs, self.totals), default=0) < 2.0**62:
            return y * np.int64(self.n) - t.astype(np.int64)
        return y.astype(object) * self.n - t

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        return deviations.astype(float) / self.n @ (self.components / np.sqrt(self.eigenvalues))


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with L @ L.T = a, of as many columns as a has rank; its rows are in a's order, triangular in the order of the pivots.

    A pivot below the rounding of its diagonal entry counts as zero.
    """
    d = len(a)
    rest, least, out = a.diagonal().astype(float).copy(), a.diagonal() * d * 2.0**-52, np.zeros((d, d))
    for k in range(d):
        live = np.where(rest > least, rest, -1.0)
        p = int(live.argmax())
        if live[p] <= 0:
            return out[:, :k]
        column = a[:, p] - out[:, :k] @ out[p, :k]
        column[rest == 0] = 0.0  # pivots before this one
        root = np.sqrt(rest[p])
        out[:, k] = column / root
        out[p, k] = root
        rest = np.maximum(rest - out[:, k] ** 2, 0.0)
        rest[p] = 0.0
    return out


def rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Disjoint pairs of 0 to n - 1, each pair in one round: a tournament."""
    ring = list(range(n + n % 2))
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [(i, j) for i, j in zip(ring[:half], reversed(ring[half:]), strict=True) if max(i, j) < n]
        yield np.array([min(p) for p in pairs], int), np.array([max(p) for p in pairs], int)
        ring = [ring[0], ring[-1], *ring[1:-1]]


def one_sided_jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """factor with its columns rotated in pairs until all are orthogonal; factor @ factor.T stays.

    Disjoint pairs turn at once. Columns stop when every cosine is at the rounding of its sum.
    """
    u, tight = factor.copy(), 2.0**-52 * max(1.0, len(factor) ** 0.5)
    for _ in range(sweeps if u.shape[1] > 1 else 0):
        turned = False
        for i, j in rounds(u.shape[1]):
            a, b = u[:, i], u[:, j]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            on = np.abs(ab) > tight * np.sqrt(aa * bb)
            if not on.any():
                continue
            turned = True
            zeta = (bb - aa) / np.where(on, 2 * ab, 1.0)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            c = np.where(on, 1 / np.sqrt(1 + t * t), 1.0)
            s = np.where(on, c * t, 0.0)
            u[:, i], u[:, j] = c * a - s * b, s * a + c * b
        if not turned:
            break
    return u


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The positive eigenvalues of a covariance, falling, and their unit eigenvectors as columns, the largest entry positive."""
    u = one_sided_jacobi(pivoted_cholesky(a))
    values = (u * u).sum(0)
    order = np.argsort(-values, kind="stable")
    u = u[:, order] / np.sqrt(values[order])
    top = np.abs(u).argmax(0) if u.size else np.zeros(0, int)
    return values[order], u * np.where(u[top, np.arange(u.shape[1])] < 0, -1.0, 1.0)


def _exact_product(y: np.ndarray) -> np.ndarray:
    """y.T @ y of whole numbers without rounding, in Python's numbers."""
    most = float(np.abs(y).max(initial=0)) ** 2 * max(len(y), 1)
    kind = float if most < 2.0**53 else np.int64 if most < 2.0**62 else object
    out = y.astype(kind).T @ y.astype(kind)
    return (out.astype(np.int64) if kind is float else out).astype(object)


def _matrix(column: pa.Array) -> np.ndarray:
    """The whole numbers of a batch of valid vectors, a row each."""
    flat = np.asarray(column.flatten().cast(pa.float64()))
    return np.floor(flat * SCALE).astype(np.int64).reshape(len(column), -1) + OFFSET


def valid(vectors: DataFrame, vector: str, size: int | None = None) -> DataFrame:
    """The rows whose vector has finite entries only, and `size` of them: if None, the length above zero that most such rows
    have (the longer in a tie), for which they are counted by length."""
    entry = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < HUGE)
    cast = vectors.withColumn(vector, F.col(vector).cast("array<double>"))
    finite = cast.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & F.coalesce(F.forall(vector, entry), F.lit(False)))
    if size is None:
        common = finite.groupBy(F.size(vector).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
        size = common["size"] if common else 0
    return finite.where(F.size(vector) == size)


def _summed(rows: DataFrame, per_batch, kind: str) -> dict[tuple[int, int], object]:
    """The sums over all batches of the matrices that per_batch gives: one row per entry and task, one sum per entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = per_batch(batch.column(0))
                total = found if total is None else total + found
        if total is not None:
            i, j = (x.ravel() for x in np.indices(total.shape))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array([str(v) for v in total.ravel()])], ["i", "j", "v"])

    sums = rows.mapInArrow(run, "i int, j int, v string").groupBy("i", "j").agg(F.sum(F.col("v").cast(kind)).alias("v"))
    return {(r["i"], r["j"]): r["v"] for r in sums.toLocalIterator()}


def fit(vectors: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """The whitening of the valid vectors, see valid().

    Two passes, of sums and of products, and both exact: the products are of whole numbers less a whole number near the
    mean, and what that number misses of the mean is taken out in whole numbers. So the model does not depend on how rows
    are dealt out. Only a row per pair of dimensions reaches the driver. Without vectors, or if all are equal, there is no
    component.
    """
    rows = valid(vectors.select(vector), vector)
    sums = _summed(rows, lambda c: np.vstack([(x := _matrix(c)).astype(object).sum(0), np.full(x.shape[1], len(x), object)]), "decimal(38,0)")
    if not sums:
        return Whitening()
    d, n = 1 + max(j for _, j in sums), int(sums[1, 0])
    s = [int(sums[0, j]) for j in range(d)]
    near = [(2 * x + n) // (2 * n) for x in s]
    totals = [x - n * m for x, m in zip(s, near, strict=True)]
    shift = np.array(near, np.int64)
    products = _summed(rows, lambda c: _exact_product(_matrix(c) - shift), "decimal(38,0)")
    v = np.array([[(n * int(products[i, j]) - totals[i] * totals[j]) / (n * n) for j in range(d)] for i in range(d)])
    values, vectors_ = eigen(v)
    return Whitening(n, near, totals, values[:components], vectors_[:, :components], float(np.trace(v)))


def whiten(vectors: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """The valid vectors' rows with deviation (long, exact; null where it does not fit) and whitened (array of doubles, an entry
    for each component), which replace columns of these names.

    Rows of vectors of another length than the model's are left out, as are invalid ones. Repeated rows and ties stay.
    """
    kept = [c for c in vectors.columns if c.lower() not in ("deviation", "whitened")]
    rows = valid(vectors.select(kept), vector, model.size)
    place = rows.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = model.deviations(_matrix(batch.column(place))) if batch.num_rows else np.zeros((0, model.size), np.int64)
            if (d.astype(float) ** 2).sum(1).max(initial=0.0) < 2.0**62:
                spread = pa.array((d.astype(np.int64) ** 2).sum(1), pa.int64())
            else:
                exact = [sum(int(x) ** 2 for x in row) for row in d]
                spread = pa.array([x if x < 1 << 63 else None for x in exact], pa.int64())
            w = model.whitened(d)
            ends = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, spread, pa.ListArray.from_arrays(pa.array(ends), pa.array(w.ravel()))], [*batch.schema.names, "deviation", "whitened"])

    schema = rows.withColumns({"deviation": F.lit(None).cast("long"), "whitened": F.lit(None).cast("array<double>")}).schema
    return rows.mapInArrow(run, schema)


def identity_error(vectors: DataFrame, model: Whitening, vector: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity, by a pass over all of them; 0 without components."""
    k = len(model.eigenvalues)
    if not k:
        return 0.0

    def both(column: pa.Array) -> np.ndarray:
        w = model.whitened(model.deviations(_matrix(column)))
        return np.vstack([w.T @ w, w.sum(0)])

    sums = _summed(valid(vectors.select(vector), vector, model.size), both, "double")
    at = np.array([[float(sums[i, j]) for j in range(k)] for i in range(k + 1)])
    means = at[k] / model.n
    return float(np.abs(at[:k] / model.n - np.outer(means, means) - np.eye(k)).max())


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every valid vector's whitened coordinates, a row for each component, by a model of all of them."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = fit(vectors)
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.eigenvalues]).cast("array<double>")
    each = whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(share, F.col("at")).alias("explained"), F.lit(identity_error(vectors, model)).alias("identity_error"),
    )
