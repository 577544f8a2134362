"""Group aggregates and target encoding.

Leave-one-fold-out statistics come from one aggregate per (key, fold): the value
for fold k is the key's total minus its part in fold k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import words as W
from ..plans.lookups import lookup_join, scalar_struct
from .cleaning import require


def group_sums(df: DataFrame, key: str, values: dict[str, Column | str]) -> DataFrame:
    """Sum and count of each value per key, those of rows without a key included."""
    return df.groupBy(key).agg(
        *[F.sum(X.col(v).cast("double")).alias(f"_s_{out}") for out, v in values.items()],
        *[F.count(X.col(v)).alias(f"_n_{out}") for out, v in values.items()],
    )


def group_mean_features(
    df: DataFrame, key: str, values: dict[str, Column | str], fit_on: DataFrame | None = None, fitted: DataFrame | None = None
) -> DataFrame:
    """Means per group on every row, several values in one aggregate over ``fit_on`` (``df`` itself if none).

    Rows without a key, or with one ``fitted`` (``group_sums`` of other rows) never saw, get the overall mean,
    which the group sums already hold.
    """
    require(df, key)
    sums = group_sums(df if fit_on is None else fit_on, key, values) if fitted is None else fitted
    means = sums.where(F.col(key).isNotNull()).select(
        key, *[F.try_divide(F.col(f"_s_{out}"), F.col(f"_n_{out}").cast("double")).alias(out) for out in values]
    )
    overall = scalar_struct(sums, **{out: F.try_divide(F.sum(f"_s_{out}"), F.sum(f"_n_{out}").cast("double")) for out in values})
    joined = lookup_join(df, means, key)
    return joined.withColumns({out: F.coalesce(F.col(out), overall[out]) for out in values})


def group_mean_feature(df: DataFrame, key: str, value: Column | str, out: str) -> DataFrame:
    return group_mean_features(df, key, {out: value})


def rate_table(df: DataFrame, key: str, label: str, out: str = "rate") -> DataFrame:
    """Mean label per non-null key."""
    require(df, key, label)
    rates = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.avg(label).alias(out))
    return rates.where(F.col(out).isNotNull())


def group_label_rate(
    df: DataFrame, key: str, label: str | None, out: str, fallback: float = 0.5, fit_on: DataFrame | None = None, fitted: DataFrame | None = None
) -> DataFrame:
    """In-frame label rate; sees the row's own label by design. ``fitted`` is a ``rate_table`` of other rows."""
    if label is None:
        raise ValueError("a label column is required for a label rate")
    rates = rate_table(df if fit_on is None else fit_on, key, label) if fitted is None else fitted
    return lookup_join(df, rates.withColumnRenamed("rate", out), key, defaults={out: fallback})


def resolve_key(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate column the frame has."""
    return next((c for c in candidates if c in df.columns), None)


def fold_sums(df: DataFrame, key: str, label: str, fold: str) -> DataFrame:
    """Per key: total label sum and count, and the same by fold as a small map."""
    require(df, key, label, fold)
    y = F.col(label)
    parts = (
        df.where(F.col(key).isNotNull() & y.isNotNull())
        .groupBy(key, fold)
        .agg(F.sum(y).cast("double").alias("_s"), F.count(F.lit(1)).alias("_n"))
    )
    by_fold = F.map_from_entries(F.collect_list(F.struct(F.col(fold), F.struct("_s", "_n"))))
    return parts.groupBy(key).agg(F.sum("_s").alias("_S"), F.sum("_n").alias("_N"), by_fold.alias("_folds"))


def _without(fold: Column) -> tuple[Column, Column]:
    """Label sum and count of a key outside ``fold``."""
    own = F.try_element_at("_folds", fold)
    return (
        F.col("_S") - F.coalesce(own["_s"], F.lit(0.0)),
        F.col("_N") - F.coalesce(own["_n"], F.lit(0)),
    )


def oof_rate(df: DataFrame, key: str, label: str, fold: str, out: str, fallback: float = 0.5) -> DataFrame:
    """Each row's key rate over the other folds; a key seen in no other fold falls back."""
    joined = lookup_join(df, fold_sums(df, key, label, fold), key)
    s, n = _without(F.col(fold))
    rate = F.when(n > 0, s / n)
    return joined.withColumn(out, F.coalesce(rate, F.lit(fallback))).drop("_S", "_N", "_folds")


def fold_rate(
    df: DataFrame, key: str, label: str, fold: str, k: int, out: str, fallback: float = 0.5
) -> tuple[DataFrame, DataFrame]:
    """Train and validation parts of fold ``k``, both with rates fitted on the train part.

    Training rows see themselves; validation rows do not.
    """
    joined = lookup_join(df, fold_sums(df, key, label, fold), key)
    s, n = _without(F.lit(k))
    rated = joined.withColumn(out, F.coalesce(F.when(n > 0, s / n), F.lit(fallback))).drop("_S", "_N", "_folds")
    return rated.where(F.col(fold) != k), rated.where(F.col(fold) == k)


def fit_rate_maps(train: DataFrame, groups: dict[str, Sequence[str]], label: str) -> dict[str, tuple[str, DataFrame]]:
    """Per feature: the resolved source column and its rate table over all training rows."""
    fitted = {}
    for feature, candidates in groups.items():
        source = resolve_key(train, candidates)
        if source is not None:
            fitted[feature] = (source, rate_table(train, source, label))
    return fitted


def apply_rate_maps(df: DataFrame, maps: dict[str, tuple[str, DataFrame]], fallback: float = 0.5) -> DataFrame:
    """Look rates up; an absent source column yields the fallback everywhere."""
    for feature, (source, table) in maps.items():
        if source in df.columns:
            named = table.select(F.col(source).alias("_k"), F.col("rate").alias(feature))
            df = lookup_join(df, named, source, "_k", {feature: fallback})
        else:
            df = df.withColumn(feature, F.lit(float(fallback)))
    return df


def min_support_rate(train: DataFrame, df: DataFrame, key: str, label: str, min_count: int, out: str) -> DataFrame:
    """Share of label 0 per key with enough training rows; others take the global share."""
    zero = (F.col(label) == 0).cast("double")
    rates = (
        train.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"), F.avg(zero).alias(out))
        .where(F.col("_n") >= min_count)
        .drop("_n")
    )
    overall = train.agg(F.avg(zero)).scalar()
    return lookup_join(df, rates, key).withColumn(out, F.coalesce(out, overall))


def support_meta_vector(
    train: DataFrame, df: DataFrame, label: str, speaker: str, subject: str, party: str, min_count: int, out: str = "meta"
) -> DataFrame:
    """Speaker, subject and party rates and the major-party flag as one array."""
    for i, key in enumerate((speaker, subject, party)):
        df = min_support_rate(train, df, key, label, min_count, f"_m{i}")
    major = X.flag(F.lower(F.col(party)).isin(W.MAJOR_PARTIES)).cast("double")
    return df.withColumn(out, F.array("_m0", "_m1", "_m2", major)).drop("_m0", "_m1", "_m2")


def smoothed_oof_encode(
    train: DataFrame, test: DataFrame, key: str, label: str, fold: str, alpha: float = 20.0, out: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(sum + global*alpha) / (n + alpha)``: other folds for training rows, all rows for test rows."""
    name = out or f"{key}_te"
    overall = train.agg(F.avg(label)).scalar()
    sums = fold_sums(train, key, label, fold)
    tr = lookup_join(train, sums, key)
    s, n = _without(F.col(fold))
    smooth = F.when(n > 0, (s + overall * alpha) / (n + alpha))
    tr = tr.withColumn(name, F.coalesce(smooth, overall)).drop("_S", "_N", "_folds")
    te = lookup_join(test, sums.drop("_folds"), key)
    full = (F.col("_S") + overall * alpha) / (F.col("_N") + alpha)
    return tr, te.withColumn(name, F.coalesce(full, overall)).drop("_S", "_N")


def label_stats(
    df: DataFrame, key: str, label: str, min_support: int = 1, top: int | None = None, order_by: str = "total", ascending: bool = False
) -> DataFrame:
    """Rows, class counts and rates per key (label 1 = false), best-supported first."""
    require(df, key, label)
    y = F.col(label)
    stats = (
        df.where(F.col(key).isNotNull() & y.isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("total"), F.count(F.when(y == 1, 1)).alias("false_count"))
        .where(F.col("total") >= min_support)
        .withColumn("true_count", F.col("total") - F.col("false_count"))
        .withColumn("false_rate", F.col("false_count") / F.col("total"))
        .withColumn("true_rate", F.col("true_count") / F.col("total"))
    )
    first = F.col(order_by).asc() if ascending else F.col(order_by).desc()
    ordered = stats.orderBy(first, F.desc("total"), key)
    return ordered if top is None else ordered.limit(top)


def woe_encode(train: DataFrame, df: DataFrame, key: str, label: str, out: str, smoothing: float = 0.5) -> DataFrame:
    """Weight of evidence: log ratio of a key's class shares, fitted on ``train``."""
    y = F.col(label)
    totals = scalar_struct(train, pos=F.sum(y).cast("double"), n=F.count(y).cast("double"))
    per = (
        train.where(F.col(key).isNotNull() & y.isNotNull())
        .groupBy(key)
        .agg(F.sum(y).cast("double").alias("_p"), F.count(F.lit(1)).cast("double").alias("_n"))
    )
    pos_share = (F.col("_p") + smoothing) / (totals["pos"] + 2 * smoothing)
    neg_share = (F.col("_n") - F.col("_p") + smoothing) / (totals["n"] - totals["pos"] + 2 * smoothing)
    table = per.select(key, F.log(pos_share / neg_share).alias(out))
    return lookup_join(df, table, key, defaults={out: 0.0})
