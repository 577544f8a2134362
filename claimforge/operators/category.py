"""Category frequencies and grouping.

Counts always come from a grouped aggregate, which combines map-side, and return
to the rows through a lookup join; no row-level window is keyed by a hot value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import words as W
from ..plans.lookups import bounded, lookup_join
from .cleaning import require


def value_counts(df: DataFrame, col: str, out: str = "n") -> DataFrame:
    require(df, col)
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias(out))


def frequency_table(df: DataFrame, col: str) -> DataFrame:
    """``(value, n)`` of all rows; those without a value have a row of their own, so that the counts add up to the rows."""
    require(df, col)
    return df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def frequency_encode(
    df: DataFrame, col: str, prefix: str | None = None, fit_on: DataFrame | None = None, fitted: DataFrame | None = None
) -> DataFrame:
    """``<prefix>_frequency`` and its share of all rows.

    ``fit_on`` is a frame with the same values to count; chained steps give one, so that none re-reads what came before.
    ``fitted`` is a ``frequency_table`` of other rows, used as it is.
    """
    p = prefix or col
    freq = f"{p}_frequency"
    table = frequency_table(df if fit_on is None else fit_on, col) if fitted is None else fitted
    counts = table.where(F.col("value").isNotNull()).select(F.col("value").alias(col), F.col("n").alias(freq))
    counted = lookup_join(df, counts, col, defaults={freq: 0})
    rows = table.agg(F.greatest(F.sum("n"), F.lit(1))).scalar()
    return counted.withColumn(f"{p}_frequency_pct", F.col(freq) / rows)


def is_rare(df: DataFrame, freq: str, threshold: int, out: str) -> DataFrame:
    require(df, freq)
    return df.withColumn(out, (F.col(freq) < threshold).cast("int"))


def group_rare(
    df: DataFrame, col: str, threshold: int, rare_label: str = "other", out: str | None = None, freq: str | None = None
) -> DataFrame:
    """Values seen fewer than ``threshold`` times become ``rare_label``; ``freq`` reuses a count column."""
    require(df, col)
    counted = df if freq else lookup_join(df, value_counts(df, col, "_n"), col)
    n = F.col(freq or "_n")
    grouped = F.when(n < threshold, F.lit(rare_label)).otherwise(F.col(col))
    return counted.withColumn(out or f"{col}_grouped", grouped).drop("_n")


def _keep(df: DataFrame, kept: DataFrame, col: str, other: str, out: str, fixed: bool = False) -> DataFrame:
    marked = lookup_join(df, kept.select(col, F.lit(True).alias("_kept")), col, fixed=fixed)
    return marked.withColumn(out, F.when(F.col("_kept"), F.col(col)).otherwise(F.lit(other))).drop("_kept")


def _filled(df: DataFrame, col: str, out: str, missing: str) -> DataFrame:
    value = F.lower(X.strip(F.coalesce(F.col(col).cast("string"), F.lit(missing))))
    return df.withColumn(out, value)


def keep_top_n(
    train: DataFrame, test: DataFrame, col: str, n: int, other: str = "other", missing: str = "missing", out: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """The ``n`` most frequent training values on both frames; ties go to the smaller value."""
    name = out or f"{col}_top"
    tr, te = _filled(train, col, name, missing), _filled(test, col, name, missing)
    top = value_counts(tr, name).orderBy(F.desc("n"), name).limit(n).select(name)
    top = bounded(top, n)
    return _keep(tr, top, name, other, name, True), _keep(te, top, name, other, name, True)


def keep_allow_list(df: DataFrame, col: str, allowed: Sequence[str], other: str = "other", out: str | None = None) -> DataFrame:
    require(df, col)
    kept = F.when(F.col(col).isin(list(allowed)), F.col(col)).otherwise(F.lit(other))
    return df.withColumn(out or f"{col}_top", kept)


def unknown_if_blank(c: Column | str) -> Column:
    return X.or_unknown(X.strip(F.coalesce(X.col(c).cast("string"), F.lit("unknown"))))


def count_encode(train: DataFrame, test: DataFrame, col: str, log1p: bool = False, out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Training frequency of the value on both frames, unseen values 0."""
    name = out or f"{col}_count"
    keyed = [d.withColumn("_v", unknown_if_blank(col)) for d in (train, test)]
    counts = value_counts(keyed[0], "_v", name)

    def encode(d: DataFrame) -> DataFrame:
        e = lookup_join(d, counts, "_v", defaults={name: 0}).drop("_v")
        return e.withColumn(name, F.log1p(name)) if log1p else e

    return encode(keyed[0]), encode(keyed[1])


def min_count_group(
    train: DataFrame, test: DataFrame, col: str, min_count: int, other: str = "other", out: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Values with at least ``min_count`` training rows stay, the rest become ``other``."""
    name = out or f"{col}_grouped"
    kept = value_counts(train, col).where(F.col("n") >= min_count).select(col)
    return _keep(train, kept, col, other, name), _keep(test, kept, col, other, name)


def token_frequencies(df: DataFrame, tokens: str) -> DataFrame:
    require(df, tokens)
    return df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("freq"))


def rare_threshold_impact(df: DataFrame, col: str, thresholds: Sequence[int]) -> DataFrame:
    """Per threshold: values kept, rows that would be grouped, their percentage."""
    counts = value_counts(df, col)
    rows = df.agg(F.count(F.lit(1))).scalar()
    per = [
        F.struct(
            F.lit(int(t)).alias("threshold"),
            F.count(F.when(F.col("n") >= t, 1)).alias("kept_values"),
            (rows - F.coalesce(F.sum(F.when(F.col("n") >= t, F.col("n"))), F.lit(0))).alias("grouped_rows"),
        )
        for t in thresholds
    ]
    wide = counts.agg(F.array(*per).alias("_rows")).select(F.inline("_rows"))
    return wide.withColumn("grouped_pct", F.col("grouped_rows") * 100.0 / rows)


def keyword_buckets(
    df: DataFrame, col: str, rules: Sequence[tuple[str, Sequence[str]]] = W.OCCUPATIONS, out: str | None = None, default: str = "other"
) -> DataFrame:
    """Broad bucket of a value: the first rule with one of its whole words wins."""
    require(df, col)
    value = F.lower(X.text(col))
    bucket = F.when(F.lit(False), F.lit(""))
    for label, keywords in rules:
        bucket = bucket.when(value.rlike(X.whole_words(keywords)), F.lit(label))
    return df.withColumn(out or f"{col}_bucket", bucket.otherwise(F.lit(default)))
