"""Operator 13, embedding whitening: spectrum slicing.

Vectors are quantised (``floor(64 * c)`` of every entry as a double), so that all sums are whole numbers. Tasks sum up counts, entries
and products of entries of their rows; Spark adds those up by (i, j). The d sums and d * d sums of products, a number that depends on
the dimension alone, are read by the driver: the covariance is exact before it is rounded once, to doubles.

Its leading eigenpairs are found by slicing the spectrum. How many eigenvalues lie above a shift is the number of positive pivots of
LDLᵀ of the shifted matrix (with Bunch-Kaufman pivots, so that any shift will do). Bisection by these counts isolates an eigenvalue;
Rayleigh quotient iteration, kept orthogonal to what was found, converges to it cubically; and counts at both sides of the value say
that it is the one of its number, else the bisection goes on. Eigenvalues that no double can tell apart form one slice, whose vectors
are any basis of it.

Whitened vectors are computed where the rows are. Their covariance is measured in a pass of its own.

Defined cases: a null vector, and one with a null or non-finite entry, is dropped; rows that repeat an id count and are returned each by
itself, as do equal vectors; a null id stays null; shorter vectors, also empty ones, count as if zeros followed; components
without variance (``RANK_TOLERANCE``) have nothing to whiten and are left out, so that equal vectors, a single one and an empty table give no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import map_batches

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
#: Components with less than this share of the whole variance are taken to have none.
RANK_TOLERANCE = 1e-12
#: Sums are sent as two numbers: multiples of this one, and the rest.
_LIMB = 1 << 62
_WIDE = pa.decimal128(38, 0)


@dataclass(frozen=True)
class Spectrum:
    """Fitted on ``n`` vectors with ``sums`` of quantised entries: ``vectors`` are unit rows, by falling ``values``."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def _quantised(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are whole, and their entries as whole numbers, padded with zeros: int64, or Python's integers where those are too small."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column).cast(pa.float64())
    values = flat.to_numpy(zero_copy_only=False)  # null entries become nan
    rows = np.repeat(np.arange(len(column)), lengths)
    whole = pc.is_valid(column).to_numpy(zero_copy_only=False).copy()
    whole[rows[~np.isfinite(values)]] = False
    width = int(lengths[whole].max(initial=0))
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    kept = whole[rows]
    new = np.cumsum(whole) - 1
    scaled = np.floor(values[kept] * SCALE)
    huge = np.abs(scaled).max(initial=0) >= 2.0**30
    out = np.zeros((int(whole.sum()), width), object if huge else np.int64)
    out[new[rows[kept]], place[kept]] = [int(x) for x in scaled] if huge else scaled.astype(np.int64)
    return whole, out


def _products(entries: np.ndarray) -> np.ndarray:
    """Sums of products of columns, exact."""
    if entries.dtype == object:
        return entries.T @ entries
    most = int(np.abs(entries).max(initial=0))
    if most * most * len(entries) < 1 << 53:  # doubles hold every partial sum
        f = entries.astype(np.float64)
        return (f.T @ f).astype(np.int64)
    return entries.T @ entries if most * most * len(entries) < 1 << 62 else entries.astype(object).T @ entries.astype(object)


_SUMS = "i int, j int, high decimal(38,0), low decimal(38,0)"


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums: products at (i, j) with i <= j, entries at (-1, j), the count at (-1, -1)."""
    n, total, product = 0, np.zeros(0, object), np.zeros((0, 0), object)
    for batch in batches:
        _, entries = _quantised(batch.column(0))
        d = max(len(total), entries.shape[1])
        total = np.concatenate([total, np.zeros(d - len(total), object)])
        grown = np.zeros((d, d), object)
        grown[: len(product), : len(product)] = product
        product = grown
        n += len(entries)
        k = entries.shape[1]
        total[:k] += entries.astype(object).sum(axis=0) if entries.dtype == object else entries.sum(axis=0).astype(object)
        product[:k, :k] += _products(entries).astype(object)
    d = len(total)
    rows = [(-1, -1, n)] + [(-1, j, int(total[j])) for j in range(d)] + [(i, j, int(product[i, j])) for i in range(d) for j in range(i, d)]
    limbs = [divmod(v, _LIMB) for _, _, v in rows]
    wide = lambda k: pa.array([Decimal(x[k]) for x in limbs], _WIDE)
    yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), wide(0), wide(1)], ["i", "j", "high", "low"])


def inertia(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix lie above ``shift``: the positive pivots of LDLᵀ with Bunch-Kaufman pivoting."""
    a = matrix - shift * np.eye(len(matrix))
    ratio = (1 + 17**0.5) / 8
    n, k, positive = len(a), 0, 0

    def swap(x: int, y: int) -> None:
        a[[x, y]] = a[[y, x]]
        a[:, [x, y]] = a[:, [y, x]]

    while k < n:
        one, own = True, abs(a[k, k])
        if k + 1 < n:
            r = k + 1 + int(np.argmax(np.abs(a[k + 1 :, k])))
            most = abs(a[r, k])
            if own < ratio * most:
                row = np.abs(a[r, k:])
                row[r - k] = 0
                other = row.max()
                if own * other < ratio * most * most:
                    if abs(a[r, r]) >= ratio * other:
                        swap(k, r)
                    else:
                        swap(k + 1, r)
                        one = False
        if one:
            pivot = a[k, k]
            positive += pivot > 0
            if pivot:
                below = a[k + 1 :, k].copy()
                a[k + 1 :, k + 1 :] -= np.outer(below / pivot, below)
            k += 1
        else:
            positive += 1  # a pivot of two rows has an eigenvalue of either sign
            below = a[k + 2 :, k : k + 2].copy()
            a[k + 2 :, k + 2 :] -= below @ np.linalg.solve(a[k : k + 2, k : k + 2], below.T)
            k += 2
    return int(positive)


class Slices:
    """Counts of eigenvalues above shifts, each computed once."""

    def __init__(self, matrix: np.ndarray):
        self.matrix = matrix
        self.size = float(np.abs(matrix).sum(axis=1).max(initial=0.0))
        self.held: dict[float, int] = {-self.size * 1.01: len(matrix), self.size * 1.01: 0}

    def above(self, shift: float) -> int:
        if shift not in self.held:
            self.held[shift] = inertia(self.matrix, shift)
        return self.held[shift]

    def around(self, number: int) -> tuple[float, float]:
        """The narrowest slice known that holds the eigenvalue ``number``, the largest being 1."""
        return max(s for s, c in self.held.items() if c >= number), min(s for s, c in self.held.items() if c < number)


def _solved(matrix: np.ndarray, shift: float, x: np.ndarray) -> np.ndarray | None:
    try:
        y = np.linalg.solve(matrix - shift * np.eye(len(matrix)), x)
    except np.linalg.LinAlgError:
        return None
    return y if np.isfinite(y).all() else None


def _cleared(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    """``x`` at length one and orthogonal to the rows of ``found``."""
    for _ in range(2):
        x = x - found.T @ (found @ x)
        x = x / np.linalg.norm(x)
    return x


def _refined(matrix: np.ndarray, start: np.ndarray, shift: float, found: np.ndarray, steps: int = 12) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from two steps of inverse iteration at ``shift``; the value and the vector with the least residual."""
    x, best = _cleared(start, found), None
    for step in range(steps):
        value = float(x @ matrix @ x)
        left = float(np.linalg.norm(matrix @ x - value * x))
        if step >= 2 and (best is None or left < best[0]):
            best = (left, value, x)
        elif step > 3:
            break  # rounding is all that is left
        y = _solved(matrix, shift if step < 2 else value, x)
        if y is None:  # the shift is an eigenvalue to the last bit
            y = _solved(matrix, (shift if step < 2 else value) + 1e-15 * np.abs(matrix).max(), x)
            if y is None:
                break
        x = _cleared(y / np.linalg.norm(y), found)
    return (best[1], best[2]) if best else (float(x @ matrix @ x), x)


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, unit vectors as rows) of the ``most`` largest eigenvalues above ``RANK_TOLERANCE`` of the trace, by falling value."""
    n, trace = len(matrix), float(np.trace(matrix))
    values, vectors = [], np.zeros((0, n))
    if n == 0 or trace <= 0:
        return np.zeros(0), vectors
    slices = Slices(matrix)
    rank = min(most, slices.above(trace * RANK_TOLERANCE))
    rng = np.random.default_rng(13)
    narrow = 8 * n * np.finfo(float).eps * slices.size
    while len(values) < rank:
        number = len(values) + 1
        low, high = slices.around(number)
        single = slices.above(low) == number and slices.above(high) == number - 1
        if single or high - low <= narrow:
            middle = (low + high) / 2
            value, vector = _refined(matrix, rng.standard_normal(n), middle, vectors)
            # counts at both sides say whether this is the eigenvalue of that number
            near = max(narrow, 1e-9 * abs(value))
            if high - low <= narrow or slices.above(value - near) >= number > slices.above(value + near):
                values.append(value)
                vectors = np.vstack([vectors, vector])
                continue
        slices.above((low + high) / 2)
    order = np.argsort(-np.array(values), kind="stable")  # members of one slice differ by rounding
    return np.array(values)[order], vectors[order]


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Spectrum:
    """The spectrum of the covariance of all whole vectors, divisor n. What reaches the driver are the sums, d * d of them."""
    rows = map_batches(vectors.select(F.col(f"`{column}`").cast("array<double>").alias("v")), _moments, _SUMS)
    sums = {(r.i, r.j): int(r.high) * _LIMB + int(r.low) for r in rows.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()}
    n = sums.get((-1, -1), 0)
    d = 1 + max((j for i, j in sums if i == -1), default=-1)
    total = [sums[-1, j] for j in range(d)]
    covariance = np.zeros((d, d))
    for i in range(d if n else 0):
        for j in range(i, d):
            covariance[i, j] = covariance[j, i] = (n * sums[i, j] - total[i] * total[j]) / (n * n)  # integers, rounded once
    values, units = leading(covariance, components)
    return Spectrum(n, total, values, units, float(np.trace(covariance)))


def _padded(entries: np.ndarray, s: Spectrum) -> np.ndarray:
    return np.pad(entries, ((0, 0), (0, len(s.sums) - entries.shape[1])))


def _projected(entries: np.ndarray, s: Spectrum) -> np.ndarray:
    """The whitened components of padded rows."""
    mean = np.array([x / s.n for x in s.sums])
    return (entries.astype(np.float64) - mean) @ (s.vectors / np.sqrt(s.values)[:, None]).T


def _spread(entries: np.ndarray, s: Spectrum) -> pa.Array:
    """Sums over dimensions of ``(n * x - S)`` squared, of padded rows."""
    most = max([abs(x) for x in s.sums], default=0) + s.n * int(np.abs(entries).max(initial=0))
    if len(s.sums) * most * most < 1 << 62:
        off = s.n * entries - np.array(s.sums, np.int64)
        return pa.array((off * off).sum(axis=1)).cast(_WIDE)
    off = s.n * entries.astype(object) - np.array(s.sums, object)
    return pa.array([_wide(int(x)) for x in (off * off).sum(axis=1)], _WIDE)


def _wide(x: int) -> Decimal | None:
    return Decimal(x) if x < 10**38 else None


def _identity(s: Spectrum):
    """A task's sums of products of whitened components, at (i, j), and of components, at (-1, j)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(s.values)
        total, product = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            w = _projected(_padded(_quantised(batch.column(0))[1], s), s)
            total += w.sum(axis=0)
            product += w.T @ w
        at = [(-1, j, total[j]) for j in range(k)] + [(i, j, product[i, j]) for i in range(k) for j in range(i, k)]
        yield pa.record_batch([pa.array([r[0] for r in at], pa.int32()), pa.array([r[1] for r in at], pa.int32()), pa.array([r[2] for r in at], pa.float64())], ["i", "j", "x"])

    return run


def identity_error(vectors: DataFrame, s: Spectrum, column: str = "embedding") -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity, measured over all vectors."""
    rows = map_batches(vectors.select(F.col(f"`{column}`").cast("array<double>").alias("v")), _identity(s), "i int, j int, x double")
    held = {(r.i, r.j): r.x / s.n for r in rows.groupBy("i", "j").agg(F.sum("x").alias("x")).collect()}
    return max((abs(x - held[-1, i] * held[-1, j] - (i == j)) for (i, j), x in held.items() if i >= 0), default=0.0)


def _whiten(s: Spectrum, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, entries = _quantised(batch.column(1))
            entries = _padded(entries, s)
            w = _projected(entries, s)
            k = w.shape[1]
            parts = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * k), pa.array(w.reshape(-1)))
            yield pa.record_batch([batch.column(0).filter(pa.array(whole)).cast(kind), _spread(entries, s), parts], ["vec_id", "deviation", "whitened"])

    return run


def whiten(vectors: DataFrame, s: Spectrum, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(vec_id, deviation, whitened) of every whole vector: the sum over dimensions of ``(n * x - S)`` squared, exact (null from 38
    digits on), and the components, by falling eigenvalue."""
    rows = vectors.select(F.col(f"`{key}`").cast("bigint").alias("vec_id"), F.col(f"`{column}`").cast("array<double>").alias("v"))
    return map_batches(rows, _whiten(s, pa.int64()), "vec_id long, deviation decimal(38,0), whitened array<double>")


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    s = fit(vectors)
    error = identity_error(vectors, s)
    share = F.array(*[F.lit(float(e / s.trace)) for e in s.values]).cast("array<double>")
    rows = whiten(vectors, s).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(s.n).cast("bigint").alias("n"), F.col("deviation").try_cast("bigint").alias("deviation"),
        "whitened", F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
