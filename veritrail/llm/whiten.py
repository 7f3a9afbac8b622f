"""Whitening of embeddings: a distributed centred scatter, cyclic Jacobi rotations on the driver, a broadcast whitening matrix.

1. Each task sums its vectors; the sums per dimension are exact whatever the order.
2. Each task centres its vectors and multiplies them into one d x d scatter matrix; Spark adds the matrices entry by entry.
3. The driver holds d x d numbers alone.  It rotates pairs of dimensions, d / 2 disjoint pairs at a time in tournament order so that every sweep meets each pair once,
   until every off-diagonal entry is negligible beside its two diagonal ones; this test is relative, so small eigenvalues are as accurate as large ones.
4. The matrix of the first components, d x 8 numbers, goes to the tasks.  One pass measures the covariance of the whitened rows, the last returns them.

Defined results: vectors that are null, empty, or hold null or non-finite entries, or entries beyond +-2**52 (which have no exact long), are left out, as are vectors whose length
is not the most common one (of equally common lengths the greatest), which have no covariance with the others.  Repeated rows and rows without an id count as often as
they come.  A component without variance (to 1e-13 of the trace) has a null ``whitened`` and explains 0; ``identity_error`` is over the others, null if there are none.
``deviation`` is null where it is beyond a long.  Without any vector the result is empty; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the integer scale.
FACTOR, SHIFT = 1024, 100_000
COMPONENTS = 8
LIMIT = 2.0**52
FLAT = 1e-13
RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def scaled(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which rows remain, the rows' lengths, all entries one after the other as scaled longs)."""
    lengths = pa.compute.list_value_length(column).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pa.compute.list_flatten(column).cast(pa.float64())
    values = FACTOR * flat.to_numpy(zero_copy_only=False)  # nulls are NaN
    bad = ~(np.abs(values) < LIMIT)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    good = lengths > 0
    good[owner[bad]] = False
    values = np.where(bad, 0.0, values)
    return good, lengths, (np.floor(values).astype(np.int64) + SHIFT)


def matrices(batches: Iterator[pa.RecordBatch], d: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(batch, places in it, their x vectors as rows), one matrix per batch and length; with ``d`` of that length alone.  The vectors are the last column."""
    for batch in batches:
        good, lengths, x = scaled(batch.column(batch.num_columns - 1))
        begin = np.cumsum(lengths) - lengths
        for length in np.unique(lengths[good]).tolist() if d is None else [d]:
            rows = np.flatnonzero(good & (lengths == length))
            if len(rows):
                yield batch, rows, x[begin[rows][:, None] + np.arange(length)]


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per length: count and sums, as decimal strings so that no sum overflows."""
    found: dict[int, tuple[int, list[int]]] = {}
    for _, rows, x in matrices(batches):
        d = x.shape[1]
        low, high = x & ((1 << 26) - 1), x >> 26
        sums = [int(a) + (int(b) << 26) for a, b in zip(low.sum(0), high.sum(0), strict=True)]
        n, held = found.get(d, (0, [0] * d))
        found[d] = n + len(rows), [a + b for a, b in zip(held, sums, strict=True)]
    out = [(d, n, i, str(s)) for d, (n, sums) in found.items() for i, s in enumerate(sums)]
    columns = zip(*out, strict=True) if out else [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.string()), strict=True)], names=["d", "n", "i", "s"])


def _scatter(batches: Iterator[pa.RecordBatch], mean: np.ndarray, matrix: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """The task's scatter of centred rows, or of their projections, as (row, values)."""
    total = None
    for _, _, x in matrices(batches, len(mean)):
        y = x - mean
        if matrix is not None:
            y = y @ matrix
        total = y.T @ y + (0 if total is None else total)
    rows = [] if total is None else total.tolist()
    yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["i", "v"])


def _summed(parts: DataFrame, d: int) -> np.ndarray:
    entries = parts.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros((d, d))
    out[entries["i"].to_numpy(), entries["j"].to_numpy()] = entries["v"].to_numpy()
    return (out + out.T) / 2


def _rounds(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A sweep in tournament order: rounds of disjoint pairs that meet each pair of dimensions once."""
    places = list(range(d + d % 2))
    out = []
    for _ in range(len(places) - 1):
        half = len(places) // 2
        pairs = [(min(a, b), max(a, b)) for a, b in zip(places[:half], places[:half - 1:-1], strict=True) if max(a, b) < d]
        out.append((np.array([p for p, _ in pairs], int), np.array([q for _, q in pairs], int)))
        places = [places[0], places[-1], *places[1:-1]]
    return out


def jacobi(matrix: np.ndarray, tolerance: float = 1e-15, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of a symmetric positive semidefinite matrix."""
    a, d = matrix.astype(float).copy(), len(matrix)
    vectors = np.eye(d)
    rounds = _rounds(d) if d > 1 else []
    floor = np.trace(a) * 1e-18  # of no weight beside the whole
    for _ in range(sweeps):
        rotated = False
        for p, q in rounds:
            app, aqq, apq = a[p, p], a[q, q], a[p, q]
            turn = np.abs(apq) > np.maximum(tolerance * np.sqrt(np.abs(app * aqq)), floor)
            if not turn.any():
                continue
            rotated = True
            theta = np.where(turn, (aqq - app) / (2 * np.where(turn, apq, 1.0)), 0.0)
            t = np.where(turn, np.where(theta >= 0, 1.0, -1.0) / (np.abs(theta) + np.hypot(theta, 1.0)), 0.0)
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            for m in (a, vectors):  # columns
                left, right = m[:, p].copy(), m[:, q].copy()
                m[:, p], m[:, q] = left * c - right * s, left * s + right * c
            left, right = a[p].copy(), a[q].copy()
            a[p], a[q] = left * c[:, None] - right * s[:, None], left * s[:, None] + right * c[:, None]
            a[p, q] = a[q, p] = np.where(turn, 0.0, a[p, q])
        if not rotated:
            break
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n x - S)**2, null beyond a long."""
    near = [round(s / n) if abs(s) < 2**52 else s // n for s in sums]
    rest = [n * a - s for a, s in zip(near, sums, strict=True)]  # n x - S = n (x - near) + rest
    y = x - np.array(near, np.int64)
    if max(1, int(np.abs(y).max(initial=0)) * n + max(map(abs, rest))) ** 2 * len(sums) < 2**63:
        z = y * n + np.array(rest, np.int64)
        return (z * z).sum(1).tolist()
    exact = (sum((n * v + r) ** 2 for v, r in zip(row, rest, strict=True)) for row in y.tolist())
    return [v if v < 2**63 else None for v in exact]


def _whitened(batches: Iterator[pa.RecordBatch], n: int, sums: list[int], mean: np.ndarray, matrix: np.ndarray, shares: list[float], flat: list[bool], error: float | None) -> Iterator[pa.RecordBatch]:
    k = matrix.shape[1]
    for batch, rows, x in matrices(batches, len(mean)):
        values = ((x - mean) @ matrix).reshape(-1)
        m = len(rows)
        yield pa.RecordBatch.from_arrays([
            batch.column(0).take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
            pa.array([v for v in _deviations(x, n, sums) for _ in range(k)], pa.int64()), pa.array(values, mask=np.tile(flat, m)), pa.array(np.tile(shares, m)),
            pa.array([error] * (m * k), pa.float64()),
        ], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whitening(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """Per remaining row and component: the key, ``component`` (from 1 by falling eigenvalue), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    spark = vectors.sparkSession
    narrow = vectors.select(F.col(vector).cast("array<double>").alias("v"))
    sums = narrow.mapInArrow(_sums, "d int, n long, i int, s string").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    commonest = sums.where("i = 0").orderBy(F.desc("n"), F.desc("d")).limit(1).select("d")
    found = sorted((r.i, r.n, int(r.s)) for r in sums.join(commonest, "d", "left_semi").collect())  # one row per dimension
    if not found:
        return spark.createDataFrame([], RESULT)
    n, total = found[0][1], [s for _, _, s in found]
    d = len(total)
    mean = np.array([s // n + s % n / n for s in total])
    covariance = _summed(narrow.mapInArrow(lambda b: _scatter(b, mean), "i int, v array<double>"), d) / n
    values, basis = jacobi(covariance)
    trace = float(np.trace(covariance))
    k = min(components, d)
    flat = [not v > FLAT * trace for v in values[:k].tolist()]
    matrix = basis[:, :k] / np.sqrt(np.where(flat, 1.0, values[:k]))
    shares = [0.0 if f else float(v / trace) for f, v in zip(flat, values, strict=False)]
    keep = [i for i, f in enumerate(flat) if not f]
    whole = _summed(narrow.mapInArrow(lambda b: _scatter(b, mean, matrix), "i int, v array<double>"), k) / n
    error = float(np.abs(whole[np.ix_(keep, keep)] - np.eye(len(keep))).max()) if keep else None
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return rows.mapInArrow(lambda b: _whitened(b, n, total, mean, matrix, shares, flat, error), RESULT)
