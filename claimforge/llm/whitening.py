"""Whitening of embedding tables on their leading principal directions.

Entries become whole steps, so that counts and sums are exact. The distinct step vectors are written once and
their covariance is never formed: each product of it with a block of vectors is one Spark job, in which tasks
centre their rows, multiply them and add up; the tasks' sums meet in a shuffle keyed by dimension. The
eigenpairs come from ``eigen.leading_pairs`` over these products. What reaches the driver is as wide as a
vector, whatever the number of rows.

Defined cases: rows whose vector is null, empty or holds a null or non-finite entry are left out, as are rows
of another length than the commonest (of two as common, the longer); entries count as at most 2**40 steps; a
null key and repeated rows are kept; fewer components come out where the points span fewer directions (none for
one point); an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_written, shuffles_dropped, written
from .eigen import EPS, leading_pairs

STEPS_PER_UNIT, MIDDLE, MOST_STEPS = 64, 1_000_000, 2**40


def as_steps(entry: Column) -> Column:
    whole = F.floor(entry.cast("double") * STEPS_PER_UNIT)
    return F.greatest(F.least(whole, F.lit(MOST_STEPS)), F.lit(-MOST_STEPS)) + MIDDLE


def step_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """``_key, _x``: the rows whose vector is whole, as arrays of bigint."""
    finite = F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_v"))
    return rows.where(F.col("_v").isNotNull() & (F.size("_v") > 0) & finite).select("_key", F.transform("_v", as_steps).alias("_x"))


def blocks(batches: Iterator[pa.RecordBatch], width: int, column: str = "_x") -> Iterator[np.ndarray]:
    for batch in batches:
        yield batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def summed(points: DataFrame, partial: Callable[[np.ndarray], np.ndarray], width: int, shape: tuple[int, int]) -> np.ndarray:
    """The sum of ``partial(block)``, a matrix of ``shape``, over blocks of all points.

    A task adds up its own blocks and hands over one matrix; rows of matrices meet by their number.
    """
    rows, columns = shape

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for block in blocks(batches, width):
            total += partial(block)
        data = [pa.array(np.arange(rows), pa.int32()), *[pa.array(total[:, j]) for j in range(columns)]]
        yield pa.RecordBatch.from_arrays(data, ["i", *[f"p{j}" for j in range(columns)]])

    schema = ", ".join(["i int", *[f"p{j} double" for j in range(columns)]])
    parts = points.mapInArrow(tasks, schema).groupBy("i").agg(*[F.sum(f"p{j}").alias(f"p{j}") for j in range(columns)])
    found = parts.toPandas().set_index("i").reindex(range(rows)).fillna(0.0)
    return found.to_numpy()


def exact_sums(points: DataFrame, width: int) -> tuple[int, list[int]]:
    """Number of points and exact sum of each dimension."""

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for block in blocks(batches, width):  # at most 10,000 rows of 41 bits
            n += len(block)
            total = [a + int(b) for a, b in zip(total, block.sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array([str(n), *map(str, total)])], ["i", "s"])

    parts = points.mapInArrow(tasks, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s"))
    found = {r["i"]: int(r["s"]) for r in parts.collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(width)]


@dataclass
class Whitening:
    """What was fitted: ``n`` points with ``sums``, eigenvalues (falling) and unit components as columns."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float

    @property
    def width(self) -> int:
        return len(self.sums)

    def centre(self, x: np.ndarray) -> np.ndarray:
        return centred(x, self.n, self.sums)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centre(x) @ (self.components / np.sqrt(self.values))

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """Exact sum over dimensions of (n x - sum) squared; null where it exceeds a long."""
        whole, rest = parted(self.sums, self.n)
        off = x - whole
        largest = (int(np.abs(off).max(initial=0)) + 1) * self.n
        if largest**2 * self.width < 2**63:
            return ((self.n * off - rest) ** 2).sum(axis=1).tolist()
        exact = ((self.n * off.astype(object) - rest) ** 2).sum(axis=1).tolist()
        return [v if v < 2**63 else None for v in exact]


def parted(sums: list[int], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole part of each mean, and what is left of its sum."""
    return np.array([s // n for s in sums], np.int64), np.array([s % n for s in sums], np.int64)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S/n with the whole part taken off exactly first."""
    whole, rest = parted(sums, n)
    return (x - whole) - rest / n


def fit_whitening(vectors: DataFrame, components: int = 16) -> Whitening | None:
    """Fit on each distinct vector of ``_x`` (``step_vectors``) once; None without rows."""
    spark = vectors.sparkSession
    size = F.size("_x")
    commonest = vectors.groupBy(size.alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("w")).limit(1).collect()
    if not commonest:
        return None
    width = int(commonest[0]["w"])
    with shuffles_dropped(spark):
        points, path = written(vectors.where(size == width).select("_x").distinct(), "points")
    n, sums = exact_sums(points, width)

    def product(u: np.ndarray) -> np.ndarray:
        def partial(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums)
            return c.T @ (c @ u)

        return summed(points, partial, width, u.shape) / n

    trace = summed(points, lambda x: np.array([[(centred(x, n, sums) ** 2).sum()]]), width, (1, 1))[0, 0] / n
    values, vectors_ = leading_pairs(product, width, components)
    real = values > trace * width * EPS
    found = Whitening(n, sums, values[real], vectors_[:, real], values[real] / trace if trace else values[real], 0.0)
    k = int(real.sum())

    def moments(x: np.ndarray) -> np.ndarray:
        w = found.whiten(x)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    if k:
        total = summed(points, moments, width, (k + 1, k)) / n
        found.identity_error = float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())
    drop_written(spark, path)
    return found


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 16) -> tuple[DataFrame, Whitening | None]:
    """``key, deviation, whitened`` (array of double, one entry a component) of each row, and the fit."""
    rows = step_vectors(df, key, vector)
    model = fit_whitening(rows, components)
    kind = rows.schema["_key"].dataType.simpleString()
    schema = f"_key {kind}, deviation bigint, whitened array<double>"
    if model is None:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("_key", key), None

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(-1, model.width)
            w = model.whiten(x)
            ends = pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(w.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(model.deviation(x), pa.int64()), lists], ["_key", "deviation", "whitened"])

    out = rows.where(F.size("_x") == model.width).mapInArrow(apply, schema)
    return out.withColumnRenamed("_key", key), model
