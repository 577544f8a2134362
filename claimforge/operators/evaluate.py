"""Classifier evaluation on score tables.

Everything first shrinks to counts: confusion cells, cutoff cells, or distinct
scores. Ordered sums run over those, never over rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..plans.lookups import fixed_table
from ..plans.ordered import running_sums
from .cleaning import require

CELLS = ["tp", "fp", "fn", "tn"]


def confusion(df: DataFrame, label: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    require(df, label, pred, *by)
    y, p = F.col(label), F.col(pred)
    cells = {"tn": (y == 0) & (p == 0), "fp": (y == 0) & (p == 1), "fn": (y == 1) & (p == 0), "tp": (y == 1) & (p == 1)}
    return df.groupBy(*by).agg(*[F.count(F.when(c, 1)).alias(n) for n, c in cells.items()])


def _metrics(cells: DataFrame, metrics: Sequence[str], keep: Sequence[str]) -> DataFrame:
    counts = [F.col(c) for c in CELLS]
    return cells.select(*keep, *[S.metric(m, *counts).alias(m) for m in metrics])


def binary_metrics(df: DataFrame, label: str, pred: str, by: Sequence[str] = (), metrics: Sequence[str] = S.METRICS) -> DataFrame:
    return _metrics(confusion(df, label, pred, by), metrics, by)


def _ladder(df: DataFrame, label: str, score: str, by: Sequence[str]) -> DataFrame:
    """Distinct scores from high to low: positives and negatives, running (tp, fp) and in all (tp_all, fp_all)."""
    require(df, label, score, *by)
    y = F.col(label)
    rows = df.where(y.isNotNull() & F.col(score).isNotNull()).select(
        *by,
        F.col(score).cast("double").alias("score"),
        (y == 1).cast("bigint").alias("pos"),
        (y == 0).cast("bigint").alias("neg"),
    )
    counts = rows.groupBy(*by, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return running_sums(counts, by, "score", {"tp": "pos", "fp": "neg"}, ascending=False)


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Rank AUC; tied scores count one half."""
    # A positive loses to the negatives scored above it and to half of those tied with it.
    above = F.col("fp") - F.col("neg")
    lost = F.sum(F.col("pos").cast("double") * (above + F.col("neg") / 2))
    p, n = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    return _ladder(df, label, score, by).groupBy(*by).agg((1 - F.try_divide(lost, p * n)).alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """``sum((R_i - R_{i-1}) * P_i)`` over distinct scores, no interpolation."""
    gain = F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp")))
    value = F.try_divide(F.sum(gain), F.sum("pos").cast("double"))
    return _ladder(df, label, score, by).groupBy(*by).agg(value.alias("average_precision"))


def curve_points(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """ROC and precision-recall points, one per distinct score used as an inclusive cutoff."""
    tp, fp, p, n = (F.col(c) for c in ("tp", "fp", "tp_all", "fp_all"))
    return _ladder(df, label, score, by).select(
        *by, F.col("score").alias("threshold"), S.ratio(fp, n).alias("fpr"), S.ratio(tp, p).alias("tpr"),
        S.ratio(tp, tp + fp).alias("precision"), S.ratio(tp, p).alias("recall"),
    )


def classification_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Per-class, accuracy, macro and weighted rows from one confusion row."""
    tp, fp, fn, tn = (F.col(c) for c in CELLS)
    c1 = (S.ratio(tp, tp + fp), S.ratio(tp, tp + fn), S.f1_of(tp, fp, fn), tp + fn)
    c0 = (S.ratio(tn, tn + fn), S.ratio(tn, tn + fp), S.f1_of(tn, fn, fp), tn + fp)
    n = tp + fp + fn + tn
    acc = S.ratio(tp + tn, n)

    def row(name: str, p: Column, r: Column, f: Column, support: Column) -> Column:
        return F.struct(F.lit(name).alias("row"), p.alias("precision"), r.alias("recall"), f.alias("f1"), support.cast("bigint").alias("support"))

    macro = [(a + b) / 2 for a, b in zip(c0[:3], c1[:3])]
    weighted = [S.ratio(a * c0[3] + b * c1[3], n) for a, b in zip(c0[:3], c1[:3])]
    rows = F.array(row("0", *c0), row("1", *c1), row("accuracy", acc, acc, acc, n), row("macro avg", *macro, n), row("weighted avg", *weighted, n))
    return confusion(df, label, pred).select(F.inline(rows))


def threshold_sweep(
    df: DataFrame, label: str, score: str | Column, grid: Sequence[float], metrics: Sequence[str] = ("macro_f1",),
    inclusive: bool = True, by: Sequence[str] = (),
) -> DataFrame:
    """Metrics at every cutoff from one pass: rows fall into cutoff cells, cells are summed downwards."""
    grid = sorted(grid)
    value = F.col(score) if isinstance(score, str) else score
    y = F.col(label)
    cells = df.where(y.isNotNull()).groupBy(*by, S.grid_cell(value, grid, inclusive).alias("_cell")).agg(
        F.count(F.when(y == 1, 1)).alias("_pos"), F.count(F.when(y == 0, 1)).alias("_neg")
    )
    # At most len(grid)+1 cells per group from here on.
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("_cell"), F.lit(t).alias("threshold")) for i, t in enumerate([None, *map(float, grid)])]))
    if by:
        frame = cells.select(*by).distinct().select(*by, steps.alias("_s")).select(*by, "_s.*")
    else:
        frame = fixed_table(df.sparkSession, [(i, t) for i, t in enumerate([None, *map(float, grid)])], "_cell int, threshold double")
    full = frame.join(cells, [*by, "_cell"], "left").na.fill(0, ["_pos", "_neg"])
    down = Window.partitionBy(*by).orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    counted = full.select(
        *by, "threshold",
        F.sum("_pos").over(down).alias("tp"), F.sum("_neg").over(down).alias("fp"),
        F.sum("_pos").over(whole).alias("_p"), F.sum("_neg").over(whole).alias("_n"),
    )
    counted = counted.where(F.col("threshold").isNotNull()).select(
        *by, "threshold", "tp", "fp", (F.col("_p") - F.col("tp")).alias("fn"), (F.col("_n") - F.col("fp")).alias("tn")
    )
    return _metrics(counted, metrics, [*by, "threshold"])


def best_threshold(sweep: DataFrame, metric: str = "macro_f1", by: Sequence[str] = ()) -> DataFrame:
    """First maximum along the grid."""
    if not by:
        return sweep.orderBy(F.desc(metric), "threshold").limit(1)
    best = F.max_by(F.struct(*[c for c in sweep.columns if c not in by]), F.struct(F.col(metric), -F.col("threshold")))
    return sweep.groupBy(*by).agg(best.alias("_b")).select(*by, "_b.*")


def rank_metrics(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """AUC and average precision from one ladder."""
    lost = F.sum(F.col("pos").cast("double") * (F.col("fp") - F.col("neg") + F.col("neg") / 2))
    gain = F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    p, n = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    return _ladder(df, label, score, by).groupBy(*by).agg(
        (1 - F.try_divide(lost, p * n)).alias("roc_auc"), F.try_divide(gain, p).alias("average_precision")
    )


def fold_metrics(df: DataFrame, label: str, score: str, fold: str, threshold: float = 0.5) -> DataFrame:
    pred = df.withColumn("_pred", (F.col(score) >= threshold).cast("int"))
    return binary_metrics(pred, label, "_pred", [fold]).join(rank_metrics(df, label, score, [fold]), fold)


def cv_summary(folds: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """Mean and population deviation of each fold metric."""
    names = list(metrics or [m for m in [*S.METRICS, "roc_auc", "average_precision"] if m in folds.columns])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.avg(m).alias("mean"), F.stddev_pop(m).alias("std")) for m in names])
    return folds.agg(rows.alias("_m")).select(F.inline("_m"))


def multi_threshold_predictions(df: DataFrame, key: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Predictions at several cutoffs, long form, ready for ``partitionBy('threshold')``."""
    kept = sorted({round(float(t), 2) for t in thresholds if 0.05 <= t <= 0.95})
    cuts = F.array(*[F.lit(t) for t in kept])
    return df.select(key, F.col(score).alias("_s"), F.explode(cuts).alias("threshold")).select(
        key, "threshold", (F.col("_s") >= F.col("threshold")).cast("int").alias("label")
    )


def thresholds_around(best: float, offsets: Sequence[float] = (-0.05, -0.03, -0.02, 0, 0.02, 0.03, 0.05), fixed: Sequence[float] = (0.5, 0.55, 0.6, 0.65)) -> list[float]:
    return sorted({round(best + o, 2) for o in offsets} | set(fixed))


def feature_ranking(spark, names: Sequence[str], weights: Sequence[float], signed: bool = False) -> DataFrame:
    """Importances or coefficients by name; one entry per model feature."""
    table = spark.createDataFrame([(n, float(w)) for n, w in zip(names, weights)], "feature string, weight double")
    return table.orderBy(F.desc("weight") if signed else F.desc(F.abs("weight")), "feature")
