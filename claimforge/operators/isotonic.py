"""Isotonic calibration over counts per distinct score.

Scores are range-partitioned; each task pools adjacent violators of its own range into blocks, and ranges are
merged sixteen at a time until one is left. With 0/1 labels the blocks of n rows number n^(2/3) at most,
since their shares are different fractions whose denominators are rows; that is what the last task reads.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .cleaning import require

ROWS_A_RANGE, RANGES_MERGED = 100_000, 16
BLOCK = "lo double, hi double, n double, total double"


def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adjacent violators of one sorted range of blocks ``lo, hi, n, total`` merged into blocks of rising means."""
    stack: list[list[float]] = []
    for batch in batches:
        for block in zip(*[batch.column(c).to_pylist() for c in ("lo", "hi", "n", "total")], strict=True):
            block = list(block)
            while stack and stack[-1][3] * block[2] >= block[3] * stack[-1][2]:
                before = stack.pop()
                block = [before[0], block[1], before[2] + block[2], before[3] + block[3]]
            stack.append(block)
    columns = list(zip(*stack)) or [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in columns], ["lo", "hi", "n", "total"])


@dataclass
class IsotonicTable:
    """Blocks with rising values: ``lo`` to ``hi`` of each has its value, between blocks it runs straight."""

    at: np.ndarray
    value: np.ndarray

    def apply(self, df: DataFrame, score: str, out: str) -> DataFrame:
        """Scores beyond the fitted ones take the first or last value; null scores stay null."""
        if not len(self.at):
            return df.withColumn(out, F.lit(None).cast("double"))
        shared = df.sparkSession.sparkContext.broadcast((self.at, self.value))

        @F.pandas_udf("double")
        def value(scores: pd.Series) -> pd.Series:
            at, known = shared.value
            return pd.Series(np.where(scores.isna(), np.nan, np.interp(scores.astype(float), at, known)))

        found = value(F.col(score).cast("double"))
        return df.withColumn(out, F.when(F.col(score).isNotNull(), found))


def isotonic_blocks(df: DataFrame, score: str, label: str, weight: str | None = None) -> DataFrame:
    """``(lo, hi, n, total)``: blocks of scores whose weighted mean label rises from one to the next."""
    require(df, score, label)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull() & (w > 0))
    s = F.col(score).cast("double")
    counts = cut(rows.groupBy(s.alias("lo")).agg(F.sum(w).alias("n"), F.sum(w * F.col(label)).alias("total")).select("lo", F.col("lo").alias("hi"), "n", "total"))
    ranges = max(1, -(-counts.count() // ROWS_A_RANGE))
    blocks = counts
    while True:
        dealt = blocks.repartitionByRange(ranges, "lo") if ranges > 1 else blocks.coalesce(1)
        blocks = cut(dealt.sortWithinPartitions("lo").mapInArrow(pool, BLOCK))
        if ranges == 1:
            return blocks
        ranges = -(-ranges // RANGES_MERGED)


def fit_isotonic(df: DataFrame, score: str, label: str, weight: str | None = None) -> IsotonicTable:
    rows = isotonic_blocks(df, score, label, weight).orderBy("lo").select("lo", "hi", F.expr("total / n").alias("value")).toPandas()
    at = rows[["lo", "hi"]].to_numpy().reshape(-1)
    value = np.repeat(rows["value"].to_numpy(), 2)
    keep = np.concatenate([[True], np.diff(at) > 0]) if len(at) else np.zeros(0, bool)
    return IsotonicTable(at[keep], value[keep])
