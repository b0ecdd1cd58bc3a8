"""Embedding whitening by Chebyshev-filtered subspace iteration.

The covariance is never formed. A pass over the vectors multiplies it with a narrow block of columns: every task centres its
rows, computes ``C'(C B)`` and returns one matrix of the block's size. A Chebyshev polynomial of the covariance, by its
three-term recurrence, damps the unwanted end of the spectrum; QR and Rayleigh-Ritz follow, until the residuals certify
the wanted pairs. A Lanczos vector rides along in each pass and bounds the spectrum from below.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Columns of the subspace beside the wanted ones, so that the last wanted value has a gap to what is damped.
GUARD = 16
DEGREE = 8
#: Largest residual of a wanted pair, as a share of the largest eigenvalue.
TOLERANCE = 2e-13
#: A value at most this share of the largest is zero: its direction can't be scaled to unit variance.
ZERO = 1e-11
ROUNDS = 60
_OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def _integers(c):
    """Entries as longs, ``floor(64*c) + 1000000``, packed into eight bytes each."""
    values = np.floor(SCALE * np.asarray(c, dtype=np.float64))
    if values.size and np.abs(values).max() >= 2.0**62:
        raise ValueError("64 times an entry exceeds a long")
    return values.astype(np.int64) + SHIFT


def _rows(batch, d):
    """The vectors of a batch as a matrix of longs."""
    column = batch.column(batch.schema.get_field_index("x"))
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array([np.frombuffer(v, dtype=np.int64) for v in column.to_pylist()], dtype=np.int64).reshape(len(column), d)


def _pack(batches, d):
    for batch in batches:
        values = batch.column(batch.schema.get_field_index("c"))
        x = _integers(values.flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, d)
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("vec_id")), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "x"])


def _moments(batches, d):
    """Count, sums and sum of squares of ``x - 1000000`` in this task, as decimal texts: exact at any size."""
    n, sums, squares = 0, [0] * d, 0
    for batch in batches:
        y = _rows(batch, d) - SHIFT
        if not len(y):
            continue
        n += len(y)
        top = int(np.abs(y).max())
        small = top < 2**20 and len(y) * d < 2**22
        sums = [a + int(b) for a, b in zip(sums, y.sum(axis=0) if small else y.astype(object).sum(axis=0))]
        squares += int((y * y).sum()) if small else sum(int(v) ** 2 for v in y.ravel())
    if n:
        yield pa.RecordBatch.from_pylist([{"part": " ".join(map(str, [n, squares, *sums]))}])


def _centred(batch, d, n, sums):
    """``(n*x - S) / n``, the numerator exact."""
    x = _rows(batch, d)
    if n < 2**62 // max(1, int(np.abs(x).max(initial=0))):
        return (n * x - sums) / n
    return ((n * x.astype(object) - sums) / n).astype(np.float64)


def _product(batches, d, n, sums, block):
    """The task's share of ``V B``: one row of bytes."""
    total, seen = np.zeros((d, block.shape[1])), False
    for batch in batches:
        if batch.num_rows:
            c = _centred(batch, d, n, sums)
            total += c.T @ (c @ block)
            seen = True
    if seen:
        yield pa.RecordBatch.from_pydict({"part": pa.array([(total / n).tobytes()], pa.binary())})


def _second_moments(batches, d, n, sums, directions):
    """The task's share of the sums and products of whitened values: one row of bytes."""
    k = directions.shape[1]
    total, seen = np.zeros((k + 1, k)), False
    for batch in batches:
        if batch.num_rows:
            z = _centred(batch, d, n, sums) @ directions
            total[0] += z.sum(axis=0)
            total[1:] += z.T @ z
            seen = True
    if seen:
        yield pa.RecordBatch.from_pydict({"part": pa.array([(total / n).tobytes()], pa.binary())})


def _added(batches):
    total = None
    for batch in batches:
        for part in batch.column(0).to_pylist():
            values = np.frombuffer(part)
            total = values if total is None else total + values
    if total is not None:
        yield pa.RecordBatch.from_pydict({"part": pa.array([total.tobytes()], pa.binary())})


def _summed(df: DataFrame, task, shape) -> np.ndarray:
    """The sum of all tasks' matrices. More than 64 of them are added up by tasks first, so few of fixed size reach the driver."""
    parts = df.select("x").mapInArrow(task, "part binary")
    tasks = df.rdd.getNumPartitions()
    if tasks > 64:
        parts = parts.repartition(math.isqrt(tasks)).mapInArrow(_added, "part binary")
    total = np.zeros(shape)
    for row in parts.collect():
        total += np.frombuffer(row.part).reshape(shape)
    return total


class _LowerEnd:
    """Lanczos on one vector that rides along with the blocks: an estimate of the least eigenvalue, less its residual."""

    def __init__(self, d: int, rng) -> None:
        v = rng.standard_normal(d)
        self.vectors, self.alphas, self.betas = [v / np.linalg.norm(v)], [], []

    def take(self, product: np.ndarray) -> None:
        if len(self.alphas) == len(self.vectors):
            return  # the vector's Krylov space is exhausted
        v = self.vectors[-1]
        self.alphas.append(float(v @ product))
        basis = np.array(self.vectors).T
        w = product
        for _ in range(2):
            w = w - basis @ (basis.T @ w)
        size = float(np.linalg.norm(w))
        self.betas.append(size)
        if size > 1e-10 * max(self.alphas) and len(self.vectors) < len(v):
            self.vectors.append(w / size)

    def value(self) -> float:
        k = len(self.alphas)
        off = self.betas[: k - 1]
        values, vectors = np.linalg.eigh(np.diag(self.alphas) + np.diag(off, 1) + np.diag(off, -1))
        return max(0.0, float(values[0]) - self.betas[-1] * abs(float(vectors[-1, 0])))


def components(x: DataFrame, d: int, n: int, sums: np.ndarray, k: int, seed: int = 7):
    """The ``k`` largest eigenvalues of the covariance and their unit vectors, as ``(values, vectors)``.

    ``x`` is a stored table. A round is one filter of ``DEGREE`` passes, a QR and a Rayleigh-Ritz pass. It ends when every
    wanted residual is at most ``TOLERANCE`` of the largest value, or when rounding keeps residuals from falling any
    further, but not above 1e-10; beyond that, or after ``ROUNDS``, it raises.
    """
    rng = np.random.default_rng(seed)
    width = min(d, k + GUARD)
    low = _LowerEnd(d, rng)

    def times(block):
        both = np.column_stack([block, low.vectors[-1]])
        out = _summed(x, functools.partial(_product, d=d, n=n, sums=sums, block=both), both.shape)
        low.take(out[:, -1])
        return out[:, :-1]

    def ritz(block):
        q, _ = np.linalg.qr(block)
        w = times(q)
        h = q.T @ w
        values, u = np.linalg.eigh((h + h.T) / 2)
        order = np.argsort(-values)
        values, u = values[order], u[:, order]
        q, w = q @ u, w @ u
        return values, q, w, np.linalg.norm(w - q * values, axis=0)

    values, q, w, residuals = ritz(rng.standard_normal((d, width)))
    best, stuck = math.inf, 0
    for _ in range(ROUNDS):
        top = max(float(values[0]), 0.0)
        worst = float(residuals[:k].max(initial=0.0))
        stuck = stuck + 1 if worst > best / 4 else 0
        best = min(best, worst)
        if top == 0.0 or worst <= TOLERANCE * top or (stuck >= 2 and worst <= 1e-10 * top):
            return np.maximum(values[:k], 0.0), q[:, :k]
        cut, floor = float(values[-1]), min(low.value(), float(values[-1]))
        half, middle = (cut - floor) / 2, (cut + floor) / 2
        if half <= 1e-9 * top or width == d:
            values, q, w, residuals = ritz(w)  # nothing left to damp: a plain step
            continue
        # three-term recurrence, scaled so that the largest value keeps size one
        sigma = first = half / (top - middle)
        before, block = q, (w - middle * q) * (sigma / half)
        for _ in range(2, DEGREE + 1):
            following = 1 / (2 / first - sigma)
            product = times(block)
            before, block = block, (product - middle * block) * (2 * following / half) - before * (sigma * following)
            sigma = following
        values, q, w, residuals = ritz(block)
    raise RuntimeError(f"residuals stay at {best} of {float(values[0])}")


def _whitened(batches, d, n, sums, directions, explained, error):
    k = directions.shape[1]
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            rows = part.num_rows
            x = _rows(part, d)
            z = _centred(part, d, n, sums) @ directions
            wide = n * int(np.abs(x).max(initial=0)) >= 2**61
            far = n * x.astype(object) - sums if wide else n * x - sums
            if wide or d * int(np.abs(far).max(initial=0)) ** 2 >= 2**62:
                deviation = [sum(int(v) ** 2 for v in r) for r in far]
                if max(deviation) >= 2**63:
                    raise OverflowError("deviation exceeds a long")
                deviation = np.array(deviation, dtype=np.int64)
            else:
                deviation = (far * far).sum(axis=1)
            again = pa.array(np.repeat(np.arange(rows), k))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(part.schema.get_field_index("vec_id")).take(again),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, n, dtype=np.int64)),
                    pa.array(np.repeat(deviation, k)),
                    pa.array(z.ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )


def whiten(vectors: DataFrame, k: int = COMPONENTS, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """One row per kept vector and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Vectors that are null, or hold null, NaN or infinite entries, are dropped. So are vectors without entries, and those whose
    length isn't the commonest (of equally common ones the largest). Repeated rows and null ids are kept and count each. Other
    columns are ignored. Components whose variance is zero can't be scaled and have no rows, so an empty table, a single
    vector and equal vectors give none. An entry whose 64-fold exceeds 2^62, or a deviation that exceeds a long, raises.

    The vectors are stored once, as integers; passes read them from the shared folder, so lost executors cost a task.
    """
    spark = vectors.sparkSession
    c = F.col(f"`{vector}`").cast("array<double>")
    good = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.where(good).select(F.col(f"`{vec_id}`").alias("vec_id"), c.alias("c"))
    id_type = kept.schema["vec_id"].dataType
    out = T.StructType([T.StructField("vec_id", id_type), *T._parse_datatype_string(_OUT).fields])
    length = kept.groupBy(F.size("c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if length is None:
        return spark.createDataFrame([], out)
    d = length.d
    packed = T.StructType([T.StructField("vec_id", id_type), T.StructField("x", T.BinaryType())])
    x = stored(kept.where(F.size("c") == d).mapInArrow(functools.partial(_pack, d=d), packed), "vectors")
    n, squares, sums = 0, 0, [0] * d
    for row in _text_parts(x, d):
        m, s, *each = map(int, row.split())
        n, squares, sums = n + m, squares + s, [a + b for a, b in zip(sums, each)]
    trace = (n * squares - sum(s * s for s in sums)) / (n * n)
    total = np.array([s + n * SHIFT for s in sums], dtype=np.int64)
    values, directions = components(x, d, n, total, min(k, d))
    found = int((values > ZERO * max(values[0], 0.0)).sum()) if trace > 0 else 0
    if not found:
        return spark.createDataFrame([], out)
    values, directions = values[:found], directions[:, :found]
    directions = directions * np.where(directions[np.abs(directions).argmax(axis=0), np.arange(found)] < 0, -1.0, 1.0)
    scaled = directions / np.sqrt(values)
    moments = _summed(x, functools.partial(_second_moments, d=d, n=n, sums=total, directions=scaled), (found + 1, found))
    error = float(np.abs(moments[1:] - np.outer(moments[0], moments[0]) - np.eye(found)).max())
    return x.mapInArrow(functools.partial(_whitened, d=d, n=n, sums=total, directions=scaled, explained=values / trace, error=error), out)


def _more_texts(batches, d):
    n, squares, sums = 0, 0, [0] * d
    for batch in batches:
        for part in batch.column(0).to_pylist():
            m, s, *each = map(int, part.split())
            n, squares, sums = n + m, squares + s, [a + b for a, b in zip(sums, each)]
    if n:
        yield pa.RecordBatch.from_pylist([{"part": " ".join(map(str, [n, squares, *sums]))}])


def _text_parts(x: DataFrame, d: int) -> list[str]:
    parts = x.select("x").mapInArrow(functools.partial(_moments, d=d), "part string")
    tasks = x.rdd.getNumPartitions()
    if tasks > 64:
        parts = parts.repartition(math.isqrt(tasks)).mapInArrow(functools.partial(_more_texts, d=d), "part string")
    return [row.part for row in parts.collect()]
