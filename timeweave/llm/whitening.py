"""Whitening of embeddings along their leading principal components.

Each entry c of a vector becomes the whole number x = floor(256 * c). The fit list holds every distinct x vector once. Its sums and
its covariance are exact: tasks add whole-number products of vectors that are centred on the whole number next to the mean, and
the rest of the mean is settled in fractions, so the result depends neither on the partitioning nor on the order of rows. The driver
gets one number for each pair of dimensions. There Householder reflections bring the covariance to tridiagonal form, Sturm counts
bisect the leading eigenvalues, and inverse iteration (orthogonal to the vectors already found of a cluster of eigenvalues)
gives the components, which every task uses to project its rows.

Left out: rows whose vector is null or empty, holds null, non-finite entries or any whose x is not below 2^53 in size, or has another length
than most rows (ties: the longer). Repeated rows are all returned, and count once in the fit. A null id stays null. Components whose
eigenvalue is not above rounding (equal vectors, fewer distinct vectors than dimensions) are left out, so without any row, or with equal
rows only, the result is empty. Equal eigenvalues: any orthonormal pair of their space, the same for all rows. A deviation
beyond a long is null. Other columns, whatever their names, are not read. Vectors of over DIMENSIONS entries are refused: the
driver holds the square of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

DIMENSIONS = 4096
_ROWS = 2048
_EXACT = 1 << 53
_FAN = 64


@dataclass(frozen=True)
class Whitening:
    """n vectors of the fit list with their sums; unit components as columns, falling eigenvalues, the covariance's trace."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float = 0.0

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S in whole numbers: as longs if they fit, else as Python's."""
        most = self.n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, self.sums), default=0)
        kind = np.int64 if most < 1 << 62 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def project(self, centred: np.ndarray) -> np.ndarray:
        return (centred.astype(np.float64) / self.n) @ self.components / np.sqrt(self.eigenvalues)


# ---------------------------------------------------------------- symmetric eigenproblem


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, off-diagonal and the unit Householder vectors that bring a symmetric matrix there."""
    a, n, reflectors = np.array(a, np.float64), len(a), []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        v = np.zeros_like(x)
        if size > 0 and np.any(x[1:]):
            v = x / size
            v[0] += np.copysign(1.0, v[0])
            v /= np.linalg.norm(v)
            rest = a[k + 1 :, k + 1 :]
            p = rest @ v
            w = 2 * (p - (v @ p) * v)
            rest -= np.outer(v, w) + np.outer(w, v)
            a[k + 1 :, k] = a[k, k + 1 :] = x - 2 * v * (v @ x)
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def counts_below(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal matrix lie below each x: the Sturm sequence's changes of sign."""
    tiny = np.finfo(float).tiny / np.finfo(float).eps
    e2, q, below = e * e, d[0] - x, np.zeros(len(x), np.int64)
    for i in range(len(d)):
        if i:
            q = d[i] - x - e2[i - 1] / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        below += q < 0
    return below


def leading_eigenvalues(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The k largest, falling, bisected until no double lies between their bounds (or for 200 halvings)."""
    reach = np.concatenate([[0], np.abs(e)]) + np.concatenate([np.abs(e), [0]])
    slack = np.finfo(float).eps * (np.abs(d).max() + reach.max()) * len(d)
    lo, hi = np.full(k, (d - reach).min() - slack), np.full(k, (d + reach).max() + slack)
    place = len(d) - 1 - np.arange(k)
    for _ in range(200):
        mid = lo + (hi - lo) / 2
        if np.all((mid <= lo) | (mid >= hi)):
            break
        above = counts_below(d, e, mid) > place
        lo, hi = np.where(above, lo, mid), np.where(above, mid, hi)
    return lo + (hi - lo) / 2


def solve_shifted(d: np.ndarray, e: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """y with (T - shift) y = b, by elimination with row exchanges; a pivot of zero counts as a tiny one."""
    n, small = len(d), np.finfo(float).eps * max(np.abs(d).max() + 2 * np.abs(e).max(initial=0), np.finfo(float).tiny)
    u, v, w, y = np.zeros(n), np.zeros(n), np.zeros(n), b.astype(float).copy()
    row = [d[0] - shift, e[0] if n > 1 else 0.0]
    for i in range(n - 1):
        below, diag, after = e[i], d[i + 1] - shift, e[i + 1] if i + 2 < n else 0.0
        if abs(below) > abs(row[0]):
            u[i], v[i], w[i] = below, diag, after
            y[i], y[i + 1] = y[i + 1], y[i]
            f = row[0] / below
            row = [row[1] - f * diag, -f * after]
        else:
            u[i], v[i] = row[0] if abs(row[0]) > small else np.copysign(small, row[0]), row[1]
            f = below / u[i]
            row = [diag - f * row[1], after]
        y[i + 1] -= f * y[i]
    u[-1] = row[0] if abs(row[0]) > small else np.copysign(small, row[0])
    for i in range(n - 1, -1, -1):
        y[i] = (y[i] - (v[i] * y[i + 1] if i + 1 < n else 0) - (w[i] * y[i + 2] if i + 2 < n else 0)) / u[i]
    return y


def eigenvectors(d: np.ndarray, e: np.ndarray, values: np.ndarray, steps: int = 6) -> np.ndarray:
    """Unit vectors by inverse iteration, as columns; those of one cluster of eigenvalues are made orthogonal at each step."""
    size = max(np.abs(d).max() + 2 * np.abs(e).max(initial=0), np.finfo(float).tiny)
    rng, out, first = np.random.default_rng(11), np.zeros((len(d), len(values))), 0
    shift = np.inf
    for k, value in enumerate(values):
        if k and values[k - 1] - value > 1e-3 * size:
            first = k
        shift = min(value, shift - 4 * np.finfo(float).eps * size) if k > first else value
        y = rng.standard_normal(len(d))
        for _ in range(steps):
            y = solve_shifted(d, e, shift, y / np.linalg.norm(y))
            y /= np.abs(y).max()
            for _ in range(2):
                y -= out[:, first:k] @ (out[:, first:k].T @ y)
        out[:, k] = y / np.linalg.norm(y)
    return out


def leading_components(covariance: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k leading eigenvalues, falling, and their unit vectors as columns (largest entry positive)."""
    if len(covariance) == 1:
        return covariance[0].copy(), np.ones((1, 1))
    d, e, reflectors = tridiagonal(covariance)
    values = leading_eigenvalues(d, e, min(k, len(d)))
    q = eigenvectors(d, e, values)
    for i in range(len(reflectors) - 1, -1, -1):
        v = reflectors[i]
        q[i + 1 :] -= 2 * np.outer(v, v @ q[i + 1 :])
    q /= np.linalg.norm(q, axis=0)
    return values, q * np.sign(q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])])


# ---------------------------------------------------------------- passes over the vectors


def _blocks(batches: Iterator[pa.RecordBatch], column: str = "x") -> Iterator[np.ndarray]:
    for b in batches:
        x = b.column(b.schema.get_field_index(column))
        flat = x.flatten().to_numpy(zero_copy_only=False)
        wide = len(flat) // len(x) if len(x) else 0
        for lo in range(0, len(x), _ROWS):
            yield flat[lo * wide : (lo + _ROWS) * wide].reshape(-1, wide)


def _products(y: np.ndarray) -> np.ndarray:
    """y.T @ y in whole numbers; by the machine's matrix product wherever that is exact."""
    most = int(np.abs(y).max(initial=0)) ** 2 * len(y)
    if most < _EXACT:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    y = y.astype(object)
    return y.T @ y


def whole(df: DataFrame, vector: str, scale: int = 256) -> DataFrame:
    """df with x: its usable vectors as whole numbers; other rows go."""
    v = F.col(vector)
    fine = F.forall(v, lambda e: F.coalesce(~F.isnan(e.cast("double")) & (F.abs(e.cast("double") * scale) < float(_EXACT)), F.lit(False)))
    df = df.where(v.isNotNull() & (F.size(v) > 0) & fine)
    lengths = df.groupBy(F.size(v).alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1).collect()
    if lengths and lengths[0]["length"] > DIMENSIONS:
        raise ValueError(f"vectors have {lengths[0]['length']} entries; at most {DIMENSIONS} can be whitened")
    df = df.where(F.size(v) == (lengths[0]["length"] if lengths else 0))
    return df.withColumn("x", F.transform(v, lambda e: F.floor(e.cast("double") * scale).cast("long")))


def _sums(distinct: DataFrame) -> tuple[int, list[int]]:
    def add(batches):
        n, total = 0, None
        for x in _blocks(batches):
            n += len(x)
            own = x.sum(axis=0) if int(np.abs(x).max(initial=0)) * len(x) < 1 << 62 else x.astype(object).sum(axis=0)
            total = own.astype(object) if total is None else total + own
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "s": [[str(v) for v in total]]}, pa.schema([("n", pa.int64()), ("s", pa.list_(pa.string()))]))

    parts = distinct.mapInArrow(add, "n long, s array<string>").select("n", F.posexplode("s").alias("j", "v"))
    rows = parts.groupBy("j").agg(F.sum("n").alias("n"), F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).orderBy("j").collect()
    return (rows[0]["n"], [int(r["s"]) for r in rows]) if rows else (0, [])


def _added(table: pa.Table, *keys: str) -> pa.Table:
    total = None
    for row in table.column("row").to_pylist():
        own = [int(v) for v in row]
        total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
    return pa.table({**{k: pa.array([table.column(k)[0].as_py()], pa.int32()) for k in keys}, "row": pa.array([[str(v) for v in total]], pa.list_(pa.string()))})


def _covariance(distinct: DataFrame, n: int, sums: list[int]) -> tuple[np.ndarray, float]:
    """The covariance rounded once from exact fractions, and its trace."""
    pivot = [(2 * s + n) // (2 * n) for s in sums]

    def add(batches):
        total = None
        for x in _blocks(batches):
            own = _products(x - np.array(pivot, np.int64))
            total = own if total is None else total + own
        if total is not None:
            d = len(total)
            yield pa.RecordBatch.from_pydict({"i": pa.array(range(d), pa.int32()), "fan": pa.array([TaskContext.get().partitionId() % _FAN] * d, pa.int32()), "row": pa.array([[str(v) for v in r] for r in total], pa.list_(pa.string()))})

    parts = distinct.mapInArrow(add, "i int, fan int, row array<string>")
    parts = parts.groupBy("i", "fan").applyInArrow(lambda t: _added(t, "i", "fan"), "i int, fan int, row array<string>")
    rows = parts.groupBy("i").applyInArrow(lambda t: _added(t, "i"), "i int, row array<string>").collect()
    a = {r["i"]: [int(v) for v in r["row"]] for r in rows}
    rest = [s - n * p for s, p in zip(sums, pivot, strict=True)]
    of = lambda i, j: Fraction(n * a[i][j] - rest[i] * rest[j], n * n)
    d = range(len(sums))
    return np.array([[float(of(min(i, j), max(i, j))) for j in d] for i in d]), float(sum(of(i, i) for i in d))


def _identity_error(distinct: DataFrame, model: Whitening) -> float:
    """The largest entry by which the whitened fit list's covariance differs from the identity."""
    k = len(model.eigenvalues)

    def add(batches):
        total, products = np.zeros(k), np.zeros((k, k))
        for x in _blocks(batches):
            w = model.project(model.centred(x))
            total += w.sum(axis=0)
            products += w.T @ w
        flat = np.concatenate([total, products.ravel()])
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(flat)), pa.int32()), "v": flat})

    rows = distinct.mapInArrow(add, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    flat = np.array([r["v"] for r in rows]) / model.n
    return float(np.abs(flat[k:].reshape(k, k) - np.outer(flat[:k], flat[:k]) - np.eye(k)).max())


def fit(df: DataFrame, vector: str = "embedding", k: int = 4, scale: int = 256) -> Whitening | None:
    """The whitening of the distinct vectors of df; None without any component."""
    path = c.new_path(df.sparkSession, "whitening")
    whole(df.select(F.col(vector).alias("v")), "v", scale).select("x").distinct().write.parquet(path)
    distinct = df.sparkSession.read.parquet(path)
    n, sums = _sums(distinct)
    if not n:
        return None
    v, trace = _covariance(distinct, n, sums)
    if not trace > 0:
        return None
    values, q = leading_components(v, k)
    real = values > np.finfo(float).eps * len(v) * trace
    if not real.any():
        return None
    model = Whitening(n, tuple(sums), q[:, real], values[real], trace)
    return Whitening(n, tuple(sums), q[:, real], values[real], trace, _identity_error(distinct, model))


def apply(df: DataFrame, model: Whitening | None, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    schema = "id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole(df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")), "v", scale).select("id", "x")
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    k, explained = len(model.eigenvalues), model.eigenvalues / model.trace

    def project(batches):
        for b in batches:
            lo = 0
            for x in _blocks([b]):
                y, m = model.centred(x), len(x)
                if y.dtype != object and int(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < 1 << 63:
                    dev = (y * y).sum(axis=1)
                else:
                    exact = [sum(int(v) ** 2 for v in r) for r in y]
                    dev = np.array([v if v < 1 << 63 else None for v in exact], object)
                yield pa.RecordBatch.from_pydict({
                    "id": b.column(0).slice(lo, m).take(pa.array(np.repeat(np.arange(m), k))),
                    "component": pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    "n": pa.array(np.full(m * k, model.n), pa.int64()),
                    "deviation": pa.array(np.repeat(dev, k), pa.int64()),
                    "whitened": model.project(y).ravel(),
                    "explained": np.tile(explained, m),
                    "identity_error": np.full(m * k, model.identity_error),
                })
                lo += m

    return rows.mapInArrow(project, schema)
