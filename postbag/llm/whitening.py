"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The leading eigenvectors of a covariance are found without the covariance: a small block of vectors Q is multiplied by
it, X'(XQ)/n over the centred rows X, one pass over the distributed table for each product. Between two looks at the
block a Chebyshev polynomial of the covariance is applied by its three-term recurrence: it stays small on the part of
the spectrum that isn't wanted (from 0 to the block's smallest Ritz value) and grows fastest beyond. QR makes the block
orthonormal again and Rayleigh-Ritz finds its best eigenvectors. A component is certified by its residual
||Vq - eq||, which bounds how far e is from an eigenvalue; the iteration ends when all wanted ones are certified.

Entries are made whole numbers first, so that counts, sums and deviations are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postbag.session import pin

#: Components returned, vectors of the block, degree of the polynomial, rounds at most.
COMPONENTS, BLOCK, DEGREE, ROUNDS = 4, 32, 12, 60
#: Entries are multiplied by this and rounded down.
SCALE = 256
#: Residual, as a share of the largest eigenvalue, that certifies a component; and the largest that is let pass where
#: rounding errors keep it from getting smaller.
CERTIFIED, LEAST = 2e-14, 1e-9
#: Eigenvalues below this share of the largest are rounding errors of 0: there is no such component.
NO_VARIANCE = 1e-11

Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


@dataclass
class Fit:
    n: int  # vectors fitted to
    sums: list[int]
    trace: float
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # columns
    residuals: np.ndarray  # shares of the largest eigenvalue
    rounds: int
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def whole(c: Column, scale: int = SCALE) -> Column:
    """Entries as whole numbers."""
    return F.transform(c.cast("array<double>"), lambda v: F.floor(v * F.lit(float(scale))).cast("bigint") + F.lit(0).cast("bigint"))


def usable(c: Column) -> Column:
    """Neither NULL nor empty, nor with entries that are NULL or no finite number."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return c.isNotNull() & (F.size(c) > 0) & ~F.exists(c.cast("array<double>"), bad)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _moments(width: int) -> Batches:
    """Rows, sums and sums of squares of a task's vectors. Squares are summed in two halves, which cannot overflow."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), width)
            squares = x * x
            low, high = squares & 0xFFFFFFFF, squares >> 32
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(width)), pa.array([len(x)] * width, pa.int64()), pa.array(x.sum(0)), pa.array(low.sum(0)), pa.array(high.sum(0))],
                ["i", "n", "total", "low", "high"],
            )

    return moments


def _product(mean: np.ndarray, block: np.ndarray) -> Batches:
    """X'(XQ) over a task's vectors: one row for each dimension."""
    width, names = len(mean), ["i", *[f"c{k}" for k in range(block.shape[1])]]

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(block.shape)
        for batch in batches:
            x = _matrix(batch.column(0), width) - mean
            total += x.T @ (x @ block)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), *[pa.array(c) for c in total.T.copy()]], names)

    return product


def covariance_times(fit: DataFrame, mean: np.ndarray, n: int, block: np.ndarray) -> np.ndarray:
    """One pass: the covariance of ``fit`` (column x) times a block. As many rows come back as there are dimensions."""
    columns = [f"c{k}" for k in range(block.shape[1])]
    parts = fit.mapInArrow(_product(mean, block), T.StructType([T.StructField("i", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in columns]]))
    sums = parts.groupBy("i").agg(*[F.sum(c).alias(c) for c in columns]).toPandas().sort_values("i")
    return sums[columns].to_numpy() / n


def chebyshev(times: Callable[[np.ndarray], np.ndarray], block: np.ndarray, first: np.ndarray, degree: int, upper: float, top: float) -> np.ndarray:
    """A Chebyshev polynomial of the operator, small on [0, upper], applied to the block; scaled by its value at ``top``.

    ``first`` is the operator times the block.
    """
    centre = half = upper / 2
    sigma = first_sigma = half / (top - centre)
    before, now = block, (first - centre * block) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first_sigma - sigma)
        before, now = now, (times(now) - centre * now) * (2 * following / half) - before * (sigma * following)
        sigma = following
    return now


def principal_components(fit: DataFrame, components: int = COMPONENTS, block: int = BLOCK, degree: int = DEGREE, seed: int = 0) -> Fit | None:
    """Leading components of ``fit``, a written table of distinct vectors of whole numbers (column x), all of one width.

    None if there are no vectors. Fewer components come back if there are fewer dimensions, or no variance is left.
    """
    width = fit.select(F.size("x").alias("w")).limit(1).collect()
    if not width:
        return None
    width = width[0]["w"]
    parts = fit.mapInArrow(_moments(width), "i bigint, n bigint, total bigint, low bigint, high bigint")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "total", "low", "high")]
    moments = parts.groupBy("i").agg(*exact).orderBy("i").collect()  # a row per dimension
    n, sums = int(moments[0]["n"]), [int(m["total"]) for m in moments]
    squares = sum((int(m["high"]) << 32) + int(m["low"]) for m in moments)
    trace = (n * squares - sum(s * s for s in sums)) / n**2  # of whole numbers until the last step
    found = Fit(n, sums, trace, np.zeros(0), np.zeros((width, 0)), np.zeros(0), 0)
    wanted = min(components, width)
    if trace <= 0 or wanted < 1:
        return found
    times = lambda q: covariance_times(fit, found.mean, n, q)
    size = min(width, max(block, 2 * wanted))
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, size)))[0]
    worst = np.inf
    for found.rounds in range(1, ROUNDS + 1):
        product = times(q)
        ritz = q.T @ product
        values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, product = q @ turn, product @ turn
        residuals = np.linalg.norm(product - q * values, axis=0)[:wanted] / values[0]
        done = residuals.max() <= CERTIFIED or (residuals.max() <= LEAST and residuals.max() > worst / 2)
        worst = residuals.max()
        if done:
            break
        upper = max(values[-1], values[0] * 1e-3)
        q = np.linalg.qr(chebyshev(times, q, product, degree, upper, values[0]) if size < width else product)[0]
    else:
        raise ArithmeticError(f"components not certified: residuals {residuals}")
    kept = values[:wanted] > NO_VARIANCE * values[0]
    found.values, found.residuals = values[:wanted][kept], residuals[kept]
    # Either sign is right; the largest entry is made positive.
    vectors = q[:, :wanted][:, kept]
    found.vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    found.identity_error = _identity_error(fit, found)
    return found


def _whitened(x: np.ndarray, fit: Fit) -> np.ndarray:
    return (x - fit.mean) @ (fit.vectors / np.sqrt(fit.values))


def _identity_error(fit: DataFrame, found: Fit) -> float:
    """Largest entry of the covariance of the whitened vectors less the identity; centred by their own mean first."""
    width, k = found.vectors.shape
    names = [f"c{i}" for i in range(k * k)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for batch in batches:
            total += _whitened(_matrix(batch.column(0), width), found).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], names[:k])

    def products(mean: np.ndarray) -> Batches:
        def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((k, k))
            for batch in batches:
                w = _whitened(_matrix(batch.column(0), width), found) - mean
                total += w.T @ w
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total.ravel()], names)

        return multiplied

    def summed(task: Batches, count: int) -> np.ndarray:
        rows = fit.mapInArrow(task, T.StructType([T.StructField(c, T.DoubleType()) for c in names[:count]]))
        return np.array(rows.agg(*[F.sum(c) for c in names[:count]]).first(), float)

    mean = summed(sums, k) / found.n
    return float(np.abs(summed(products(mean), k * k).reshape(k, k) / found.n - np.eye(k)).max())


def usable_rows(embeddings: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """A written table (key, x) of the rows that take part.

    Rows without a vector, with an empty one or with entries that are NULL or no finite number take none. All vectors
    must have one width: that of most rows counts (of several the largest), rows of other widths are left out.
    """
    rows = embeddings.filter(usable(F.col(vector))).select(F.col(key), whole(F.col(vector), scale).alias("x"))
    rows = pin(rows, "whole-vectors")
    # One row for each width.
    widths = rows.groupBy(F.size("x").alias("w")).count().orderBy(F.desc("count"), F.desc("w")).limit(2).collect()
    return rows.filter(F.size("x") == widths[0]["w"]) if len(widths) > 1 else rows


def whitened(
    embeddings: DataFrame, components: int = COMPONENTS, key: str = "vec_id", vector: str = "embedding", block: int = BLOCK, degree: int = DEGREE
) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained and identity_error for every row and component.

    The components are those of the distinct vectors; all rows are projected, repeated ones with equal results. Which
    rows take part says ``usable_rows``. Entries may be up to 2^30 after scaling; ``deviation`` is NULL where it is too
    large for a long. Where vectors have no variance left there is no component: equal vectors alone give no rows.
    """
    rows = usable_rows(embeddings, key, vector)
    # Copies are merged in each task before they are shuffled.
    fit = pin(rows.groupBy("x").agg(F.lit(1).alias("one")).select("x"), "distinct-vectors")
    found = principal_components(fit, components, block, degree)
    schema = T.StructType(
        [
            embeddings.schema[key],
            *[T.StructField(name, kind) for name, kind in (("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()))],
            *[T.StructField(name, T.DoubleType()) for name in ("whitened", "explained", "identity_error")],
        ]
    )
    if found is None:
        return embeddings.sparkSession.createDataFrame([], schema)
    width, k = found.vectors.shape
    n, sums, explained, error = found.n, found.sums, found.values / found.trace, found.identity_error
    most = max(map(abs, sums), default=0)

    def deviations(x: np.ndarray) -> list[int | None]:
        largest = n * int(np.abs(x).max()) + most
        if width * largest**2 < 2**63:
            d = n * x - np.array(sums)
            return (d * d).sum(1).tolist()
        exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x]
        return [d if d < 2**63 else None for d in exact]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            x = _matrix(batch.column(1), width)
            each = np.repeat(np.arange(len(x)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1), len(x)), pa.int32()),
                    pa.array([n] * len(each), pa.int64()),
                    pa.array(deviations(x), pa.int64()).take(pa.array(each)),
                    pa.array(_whitened(x, found).ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array([error] * len(each), pa.float64()),
                ],
                schema.names,
            )

    return rows.select(key, "x").mapInArrow(project, schema)


def whitening_digests(embeddings: DataFrame) -> DataFrame:
    """Query 12: every vector on the first four components of all distinct ones."""
    return whitened(embeddings)
