"""Embedding whitening by matrix-free block subspace iteration.

The covariance is never built. With X the centred rows, every pass over the vectors is a Spark job that gives
Xᵀ(XQ) for a thin basis Q: tasks hold one block of rows and one matrix of the size of Q, and sums of the tasks'
matrices are added up by Spark, cell by cell. The driver orthogonalises the small matrices (QR), takes Rayleigh-Ritz
vectors and stops when the residual of each of the first k certifies it. Where passes converge slowly the basis grows,
to the full dimension at last, at which one pass is exact.

Components become integers before anything is multiplied, so counts, sums and deviations are exact, and centring is
(n x - S) / n with an exact numerator.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
#: Columns of the first basis for each component asked for.
OVERSAMPLED = 2
#: A component is certified when its residual is below this part of the largest eigenvalue.
RESIDUAL = 1e-12
#: A pass that leaves more than this part of the largest residual makes the basis grow.
SLOW = 0.3
PASSES = 200
#: Fixed values of the integer form.
SCALE, OFFSET = 64, 1_000_000
#: Eigenvalues below this part of the largest are rounding: such directions have no variance to whiten.
NOTHING = 1e-13


def integers(cells: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1000000 of doubles as int64, or as Python integers where they do not fit."""
    with np.errstate(over="ignore"):
        x = np.floor(SCALE * cells)
    if not x.size or np.abs(x).max() < 2**52:
        return x.astype(np.int64) + OFFSET
    return np.vectorize(lambda c: int(np.floor(c)) * SCALE + int(np.floor((c - np.floor(c)) * SCALE)) + OFFSET, otypes=[object])(cells)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: int64 where all of it fits, else Python integers."""
    most = max([int(np.abs(x).max()) if x.size else 0, *(abs(s) // n for s in sums)])
    if x.dtype == object or most * n >= 2**61:
        return x.astype(object) * n - np.array(sums, dtype=object)
    return x * n - np.array(sums, dtype=np.int64)


def deviations(z: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exact; null where it does not fit a long."""
    most = int(np.abs(z).max()) if z.size else 0
    if z.dtype != object and most * most * z.shape[1] < 2**63:
        return (z * z).sum(axis=1).tolist()
    exact = (z.astype(object) ** 2).sum(axis=1) if z.shape[1] else np.zeros(len(z), int)
    return [int(v) if v < 2**63 else None for v in exact]


def matrices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, integer rows) of batches with the columns id and cells."""
    for batch in batches:
        if batch.num_rows:
            cells = batch.column("cells").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, width)
            yield batch.column("id"), integers(cells)


def sums(vectors: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of rows and exact sums of their integers by dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, dtype=object)
        for _, x in matrices(batches, width):
            n += len(x)
            total = total + (x.sum(axis=0) if x.dtype == object or np.abs(x).max() < 2**62 // len(x) else x.astype(object).sum(axis=0))
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(width + 1), pa.int32()), "part": pa.array([str(n), *(str(int(v)) for v in total)], pa.string())})

    # A task's sums fit 38 digits, and so do those of all tasks, but for components far beyond any embedding: these stay strings.
    parts = vectors.mapInArrow(add, "at int, part string")
    whole = parts.groupBy("at").agg(F.sum(F.expr("try_cast(part AS decimal(38, 0))")).alias("v"), F.collect_set(F.when(F.expr("try_cast(part AS decimal(38, 0)) IS NULL"), F.col("part"))).alias("wide"))
    got = {r["at"]: int(r["v"] or 0) + sum(map(int, r["wide"])) for r in whole.collect()}  # a row for each dimension
    return got.get(0, 0), [got.get(i + 1, 0) for i in range(width)]


def added(vectors: DataFrame, width: int, shape: tuple[int, int], part) -> np.ndarray:
    """Sum over all rows of part(integer rows), a matrix of that shape: each task adds its own, Spark adds the tasks' cells."""
    rows, cols = shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, x in matrices(batches, width):
            total += part(x)
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(rows), pa.int32()), "v": pa.array(total.tolist(), pa.list_(pa.float64()))})

    cells = vectors.mapInArrow(add, "at int, v array<double>")
    whole = cells.groupBy("at").agg(*[F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(cols)])
    out = np.zeros(shape)
    for r in whole.collect():  # a row for each dimension
        out[r["at"]] = r[1:]
    return out


def subspace(vectors: DataFrame, width: int, n: int, s: list[int], k: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    """(components as columns, eigenvalues, trace, passes) of the covariance: the k largest, certified."""
    rng = np.random.default_rng(12)
    size = min(width, OVERSAMPLED * k)
    q, _ = np.linalg.qr(rng.standard_normal((width, size)))
    trace, last = 0.0, np.inf
    for passes in range(1, PASSES + 1):

        def part(x: np.ndarray, q: np.ndarray = q) -> np.ndarray:
            z = (centred(x, n, s) / n).astype(float)
            # The last column carries the squares of each dimension, whose sum is the trace.
            return np.column_stack([z.T @ (z @ q), (z * z).sum(axis=0)])

        y = added(vectors, width, (width, q.shape[1] + 1), part) / n
        trace, y = float(y[:, -1].sum()), y[:, :-1]
        small = q.T @ y
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, image = q @ turn, y @ turn
        left = np.linalg.norm(image[:, :k] - ritz[:, :k] * values[:k], axis=0).max(initial=0.0)
        if left <= RESIDUAL * max(values[0], 0.0) or (q.shape[1] == width and passes > 1):
            return ritz[:, :k], values[:k], trace, passes
        q = image
        if q.shape[1] < width and left > SLOW * last:
            q = np.column_stack([q, rng.standard_normal((width, min(q.shape[1], width - q.shape[1]))) * max(values[0], 1.0)])
        last = left
        q, _ = np.linalg.qr(q)
    raise ArithmeticError(f"{k} components were not certified in {PASSES} passes")


def usable(vec: str) -> Column:
    return F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The whitened coordinates of every vector, a row for each vector and component.

    Returns the id, component (from 1, by falling eigenvalue), n, deviation, whitened, explained and identity_error.
    Vectors that are null, empty or hold null or non-finite entries take no part. Vectors of each length are a fit of
    their own. Directions without variance are no components: equal vectors, or a single one, give no rows, as do no
    vectors. Repeated rows and null ids are vectors of their own. deviation is null where it does not fit a long.
    A component's sign is the one that makes its largest entry positive. Other columns play no part.
    """
    spark = vectors.sparkSession
    base = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("cells")).where(usable("cells"))
    kind = base.schema["id"].dataType.simpleString()
    shape = f"`{id_col}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    lengths = sorted(r[0] for r in base.groupBy(F.size("cells")).count().collect() if r[0])
    out = spark.createDataFrame([], shape)
    for width in lengths:
        own = base.where(F.size("cells") == width)
        n, s = sums(own, width)
        vectors_, values, trace, _ = subspace(own, width, n, s, min(components, width))
        keep = values > NOTHING * max(values[0], 0.0) if values[0] > 0 else np.zeros(len(values), bool)
        if not keep.any():
            continue
        axes, values = vectors_[:, keep], values[keep]
        axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
        to = axes / np.sqrt(values)
        m = len(values)

        def white(x: np.ndarray, n: int = n, s: list[int] = s, to: np.ndarray = to) -> tuple[np.ndarray, np.ndarray]:
            z = centred(x, n, s)
            return z, (z / n).astype(float) @ to

        def gram(x: np.ndarray, white=white) -> np.ndarray:
            w = white(x)[1]
            return np.column_stack([w.T @ w, w.sum(axis=0)])

        whole = added(own, width, (m, m + 1), gram) / n
        error = float(np.abs(whole[:, :-1] - np.outer(whole[:, -1], whole[:, -1]) - np.eye(m)).max())

        def project(batches: Iterator[pa.RecordBatch], white=white, m: int = m, n: int = n, error: float = error, width: int = width, explained: np.ndarray = values / trace) -> Iterator[pa.RecordBatch]:
            for ids, x in matrices(batches, width):
                z, w = white(x)
                each = np.repeat(np.arange(len(x)), m)
                total = len(each)
                columns = [ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))), pa.array(np.full(total, n)), pa.array(deviations(z), pa.int64()).take(pa.array(each)), pa.array(w.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(total, error))]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

        out = out.unionByName(own.mapInArrow(project, shape))
    return out
