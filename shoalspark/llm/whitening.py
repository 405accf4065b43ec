"""Operator 13, embedding whitening by spectrum slicing.

1. ``grid_points``: entries as whole numbers, floor(scale * entry), so that sums are exact.
2. Each distinct point counts once in the fit: ``moments`` adds up exact sums, then products
   of centred entries, by task, and tasks' matrices by groups. Only the sums and one matrix
   (width x width) reach the driver.
3. ``leading_components``, on that matrix: an LDL' factorisation of the covariance less a shift has as
   many positive pivots as there are eigenvalues above the shift. Bisection on
   these counts isolates each leading eigenvalue, Rayleigh quotient iteration takes it to
   double precision, and counts on both sides of the result certify its number.
   Eigenvalues that no double separates share one interval, whose vectors are found by
   inverse iteration, each orthogonal to the former.
4. ``whiten``: each row's deviation (exact) and its centred point on each
   component, over the root of the eigenvalue. The covariance of these over the fit list is measured by
   Spark and must be the identity.

Defined cases: rows whose vector is null or empty, holds a null, NaN, infinite entry or one
beyond 2 ** 45 (whose grid value no double holds exactly) or has another width than most (ties: the wider)
are left out; repeated rows are given back each but fit once; null ids are kept;
components whose eigenvalue is zero but for rounding don't exist, so a table of one distinct vector
gives no row, nor does an empty one; a deviation beyond 64 bits is null; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoalspark.llm.common import map_batches, materialise, type_of

COMPONENTS, SCALE = 4, 256
#: Entries beyond this have no exact grid value.
LARGEST = float(1 << 45)
_EPS = np.finfo(np.float64).eps


# -- the spectrum of one matrix


def count_above(a: np.ndarray, shift: float) -> int:
    """Eigenvalues of the symmetric ``a`` above ``shift``: positive pivots of the LDL' factorisation of ``a - shift``."""
    m = a - shift * np.eye(len(a))
    alpha, above = (1 + 17**0.5) / 8, 0  # the bound that keeps the growth of pivots least
    while len(m):
        column = np.abs(m[1:, 0])
        largest = column.max() if len(column) else 0.0
        size = 1
        if abs(m[0, 0]) < alpha * largest:
            r = 1 + int(column.argmax())
            row = np.abs(m[r])
            row[r] = 0
            if abs(m[0, 0]) * row.max() < alpha * largest**2:
                size = 1 if abs(m[r, r]) >= alpha * row.max() else 2
                at = size - 1
                m[[at, r]] = m[[r, at]]
                m[:, [at, r]] = m[:, [r, at]]
        pivot, side = m[:size, :size], m[size:, :size]
        above += int((np.linalg.eigvalsh(pivot) > 0).sum()) if size == 2 else int(pivot[0, 0] > 0)
        rest = m[size:, size:]
        m = rest - side @ np.linalg.solve(pivot, side.T) if pivot.any() else rest
    return above


def _orthogonal(x: np.ndarray, to: list[np.ndarray]) -> np.ndarray:
    for _ in range(2):
        for v in to:
            x = x - v * (v @ x)
    return x / np.linalg.norm(x)


def _solved(a: np.ndarray, shift: float, x: np.ndarray, noise: float) -> np.ndarray:
    """``x`` by one step of inverse iteration; a shift that is an eigenvalue is moved by the least amount that helps."""
    while True:
        try:
            y = np.linalg.solve(a - shift * np.eye(len(a)), x)
            if np.isfinite(y).all():
                return y
        except np.linalg.LinAlgError:
            pass
        shift, noise = shift + noise, 2 * noise


def leading_components(a: np.ndarray, k: int) -> list[tuple[float, np.ndarray]]:
    """``(eigenvalue, unit vector)`` of the ``k`` largest eigenvalues of a covariance, those above rounding, from the largest."""
    scale = float(np.abs(a).sum(axis=1).max()) if len(a) else 0.0  # no eigenvalue is larger
    noise = 4 * len(a) * _EPS * scale
    found: list[tuple[float, np.ndarray]] = []
    total = count_above(a, noise) if scale > 0 else 0
    rng = np.random.default_rng(len(a))
    while len(found) < min(k, total):
        n = len(found)  # n eigenvalues are above high, more than n above low
        low, high, n_low = noise, scale + noise, total
        vectors = [v for _, v in found]
        while True:
            alone = n_low == n + 1
            x = _orthogonal(rng.standard_normal(len(a)), vectors)
            got = _rayleigh(a, low, high, x, vectors, noise, alone)
            if got is not None and (not alone or _certified(a, got[0], n, noise)):
                found.append(got)
                break
            while True:  # narrower, until alone or as narrow as rounding
                middle = (low + high) / 2
                above = count_above(a, middle)
                low, high, n_low = (middle, high, above) if above > n else (low, middle, n_low)
                if high - low <= noise or n_low == n + 1:
                    break
    return found


def _rayleigh(a: np.ndarray, low: float, high: float, x: np.ndarray, vectors: list[np.ndarray], noise: float, alone: bool) -> tuple[float, np.ndarray] | None:
    """The eigenvalue in (low, high] by Rayleigh quotient iteration, or None if it strays from there."""
    if not alone and high - low > noise:
        return None
    middle = (low + high) / 2
    for _ in range(3):  # into the interval's own space
        x = _orthogonal(_solved(a, middle, x, noise / 4), vectors)
    if not alone:  # values that no double separates: any vector of their space will do
        return float(x @ a @ x), x
    for _ in range(12):
        value = float(x @ a @ x)
        if not low - noise <= value <= high + noise:
            return None
        if np.linalg.norm(a @ x - value * x) <= noise / 4:
            return value, x
        x = _orthogonal(_solved(a, value, x, noise / 64), vectors)
    value = float(x @ a @ x)
    return (value, x) if np.linalg.norm(a @ x - value * x) <= noise and low - noise <= value <= high + noise else None


def _certified(a: np.ndarray, value: float, n: int, noise: float) -> bool:
    """Whether ``n`` eigenvalues are above ``value`` and more are not below it, but for rounding."""
    return count_above(a, value + noise) <= n < count_above(a, value - noise)


# -- tables


def grid_points(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> tuple[DataFrame, int]:
    """``(id, x)``, little-endian 64-bit grid points of the valid vectors, and their width."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            ids, xs, widths = [], [], []
            for at, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                c = c.values  # an Arrow array, or None
                if c is None or not len(c) or c.null_count:
                    continue
                entries = np.asarray(c.to_numpy(zero_copy_only=False), np.float64)
                if (np.abs(entries) < LARGEST).all():  # false for NaN too
                    ids.append(at)
                    xs.append(np.floor(scale * entries).astype("<i8").tobytes())
                    widths.append(len(entries))
            yield {"id": ids, "x": xs, "width": widths}

    found = materialise(map_batches(table.select(F.col(id_col), F.col(vector_col)), run, f"id {type_of(table, id_col)}, x binary, width int"), "points")
    most = found.groupBy("width").count().orderBy(F.desc("count"), F.desc("width")).first()
    width = most["width"] if most else 0
    return found.where(F.col("width") == width).select("id", "x"), width


def _matrix(batch: pa.RecordBatch, width: int, column: int = 0) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column).to_pylist()), "<i8").reshape(-1, width)


def moments(fit: DataFrame, width: int) -> tuple[int, list[int], np.ndarray]:
    """Rows, exact sums, and covariance (centred first, divisor n) of distinct points ``(x)``."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        n, total = 0, np.zeros(width, object)
        for b in batches:
            for part in np.array_split(_matrix(b, width), max(1, b.num_rows >> 12)):  # 2 ** 13 entries below 2 ** 53 fit in 64 bits or go as they are
                total += part.sum(axis=0) if not len(part) or np.abs(part).max() < 1 << 49 else part.astype(object).sum(axis=0)
                n += len(part)
        yield {"dim": range(width + 1), "total": [Decimal(int(t)) for t in (*total, n)]}

    found = {r["dim"]: int(r["total"]) for r in map_batches(fit, sums, "dim int, total decimal(38,0)").groupBy("dim").agg(F.sum("total").alias("total")).collect()}
    n, total = found.get(width, 0), [found.get(i, 0) for i in range(width)]
    if not n:
        return 0, total, np.zeros((width, width))
    mean = np.array([t / n for t in total])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        seen = np.zeros((width, width))
        for b in batches:
            y = _matrix(b, width) - mean
            seen += y.T @ y
        yield {"i": range(width), "line": [r.astype("<f8").tobytes() for r in seen]}

    def added(group: pa.Table) -> pa.Table:
        lines = group.column("line")
        total = np.zeros(width)
        for line in lines:
            total += np.frombuffer(line.as_py(), "<f8")
        return pa.table({"i": group.column("i")[:1], "line": pa.array([total.astype("<f8").tobytes()])}, schema=pa.schema([("i", pa.int32()), ("line", pa.binary())]))

    lines = map_batches(fit, products, "i int, line binary")
    lines = lines.groupBy("i", (F.spark_partition_id() % 64).alias("task")).applyInArrow(added, "i int, line binary")
    lines = lines.groupBy("i").applyInArrow(added, "i int, line binary")
    seen = np.zeros((width, width))
    for r in lines.collect():  # one row a dimension
        seen[r["i"]] = np.frombuffer(r["line"], "<f8")
    return n, total, (seen + seen.T) / 2 / n


def _projected(x: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    return (x - mean) @ axes


def _deviations(x: np.ndarray, n: int, total: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - total) ** 2, exact; null beyond 64 bits."""
    bound = n * int(np.abs(x).max(initial=0)) + max(map(abs, total))
    if bound**2 * len(total) < 1 << 63:
        return ((n * x - np.array(total, np.int64)) ** 2).sum(axis=1).tolist()
    exact = ((n * x.astype(object) - np.array(total, object)) ** 2).sum(axis=1)
    return [v if v < 1 << 63 else None for v in exact]


def identity_error(fit: DataFrame, mean: np.ndarray, axes: np.ndarray, width: int) -> float:
    """Largest absolute entry of the covariance of the projected fit list less the identity."""
    k = axes.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            w = _projected(_matrix(b, width), mean, axes)
            yield {f"w{i}": w[:, i] for i in range(k)}

    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    projected = map_batches(fit, run, ", ".join(f"w{i} double" for i in range(k)))
    found = projected.agg(*(F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs, strict=True))


def whiten(table: DataFrame, components: int = COMPONENTS, scale: int = SCALE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)`` of each valid row and component."""
    points, width = grid_points(table, id_col, vector_col, scale)
    fit = materialise(points.select("x").distinct(), "fit")
    n, total, covariance = moments(fit, width)
    leading = leading_components(covariance, components) if n else []
    schema = f"`{id_col}` {type_of(table, id_col)}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not leading:
        return table.sparkSession.createDataFrame([], schema)
    mean = np.array([t / n for t in total])
    signed = [(e, v * np.sign(v[np.abs(v).argmax()])) for e, v in leading]
    axes = np.stack([v / e**0.5 for e, v in signed], axis=1)
    explained = [e / float(np.trace(covariance)) for e, _ in signed]
    error, k = identity_error(fit, mean, axes, width), len(leading)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            x = _matrix(b, width, 1)
            deviation, w = _deviations(x, n, total), _projected(x, mean, axes)
            for i in range(k):
                rows = b.num_rows
                yield {id_col: b.column(0), "component": [i + 1] * rows, "n": [n] * rows, "deviation": deviation, "whitened": w[:, i], "explained": [explained[i]] * rows, "identity_error": [error] * rows}

    return map_batches(points, run, schema)
