"""Score blending and confidence votes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lookups import lookup_join
from .cleaning import require
from .evaluate import threshold_sweep


def _weighted(cols: Sequence[str], weights: Sequence[Column]) -> Column:
    total = weights[0] * F.col(cols[0])
    for w, c in zip(weights[1:], cols[1:]):
        total = total + w * F.col(c)
    return total


def blend(df: DataFrame, weights: dict[str, float], out: str = "blend") -> DataFrame:
    require(df, *weights)
    return df.withColumn(out, _weighted(list(weights), [F.lit(float(w)) for w in weights.values()]))


def weight_grid(n_models: int, step: float) -> list[tuple[float, ...]]:
    """Weights summing to one, ascending by the first model."""
    k = int(round(1 / step))

    def rest(left: int, models: int) -> list[tuple[int, ...]]:
        if models == 1:
            return [(left,)]
        return [(i, *tail) for i in range(left + 1) for tail in rest(left - i, models - 1)]

    return [tuple(round(p / k, 6) for p in parts) for parts in rest(k, n_models)]


def blend_search(
    df: DataFrame, label: str, cols: Sequence[str], weights: Sequence[tuple[float, ...]], thresholds: Sequence[float], metric: str = "macro_f1"
) -> DataFrame:
    """Metric for every (weights, threshold); the rows reduce to cutoff cells per weight map-side."""
    require(df, label, *cols)
    names = [f"w{i + 1}" for i in range(len(cols))]
    grid = F.array(*[F.struct(F.lit(i).alias("weight_no"), *[F.lit(float(x)).alias(n) for n, x in zip(names, w)]) for i, w in enumerate(weights)])
    tried = df.select(label, *cols, F.inline(grid))
    score = _weighted(cols, [F.col(n) for n in names])
    return threshold_sweep(tried, label, score, thresholds, [metric], by=["weight_no", *names])


def best_blend(search: DataFrame, metric: str = "macro_f1") -> DataFrame:
    """First maximum in (weight, threshold) order."""
    return search.orderBy(F.desc(metric), "weight_no", "threshold").limit(1)


def confidence_override(
    df: DataFrame, base: str, other: str, hi: float | Column = 0.70, lo: float | Column = 0.30, out: str = "vote"
) -> DataFrame:
    """Keep the base vote unless the other model disagrees with confidence; ``flipped`` marks changes."""
    require(df, base, other)
    h, low = (x if isinstance(x, Column) else F.lit(float(x)) for x in (hi, lo))
    b, s = F.col(base), F.col(other)
    vote = F.when((b == 0) & (s >= h), 1).when((b == 1) & (s <= low), 0).otherwise(b)
    return df.withColumn(out, vote.cast("int")).withColumn("flipped", (F.col(out) != b).cast("int"))


def override_report(df: DataFrame, vote: str = "vote") -> DataFrame:
    n = F.count(F.lit(1))
    return df.agg(n.alias("rows"), F.sum("flipped").alias("flips"), (F.sum("flipped") * 100.0 / n).alias("flip_pct"), F.sum(vote).alias("positives"))


def group_aware_override(
    df: DataFrame, oof: DataFrame, group: str, base: str, other: str, oof_label: str = "label", oof_score: str = "oof_proba",
    reliable: float = 0.80, unreliable: float = 0.60, out: str = "vote",
) -> DataFrame:
    """Override thresholds by how reliable the other model is for the row's group.

    Group precision above ``reliable`` loosens them to .50/.50, below ``unreliable``
    tightens to .85/.15; groups without positive calls keep .70/.30.
    """
    call = F.col(oof_score) >= 0.5
    precision = oof.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.avg(F.when(call, (F.col(oof_label) == 1).cast("double"))).alias("_prec")
    )
    joined = lookup_join(df, precision, group)
    p = F.col("_prec")
    hi = F.when(p > reliable, 0.50).when(p < unreliable, 0.85).otherwise(0.70)
    lo = F.when(p > reliable, 0.50).when(p < unreliable, 0.15).otherwise(0.30)
    return confidence_override(joined, base, other, hi, lo, out).drop("_prec")


def score_correlation(df: DataFrame, a: str, b: str, cutoff: float = 0.5) -> DataFrame:
    require(df, a, b)
    agree = ((F.col(a) >= cutoff) == (F.col(b) >= cutoff)).cast("int")
    return df.agg(F.corr(a, b).alias("correlation"), F.avg(agree).alias("agreement"), F.count(F.lit(1)).alias("rows"))
