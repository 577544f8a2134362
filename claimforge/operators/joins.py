"""Score-table joins and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lookups import lookup_join
from .cleaning import require

__all__ = ["attach_oof", "fill_template", "lookup_join", "score_join", "unseen_values"]


def score_join(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("id", "label")) -> DataFrame:
    """Inner join of score tables on the shared keys."""
    require(a, *keys)
    require(b, *keys)
    return a.join(b, list(keys), "inner")


def fill_template(template: DataFrame, predictions: DataFrame, key: str = "id", label: str = "label", default: int = 1) -> DataFrame:
    """Every template id with its prediction, or the default."""
    return lookup_join(template.select(key), predictions.select(key, label), key, defaults={label: default})


def score_column(df: DataFrame) -> str | None:
    """First column whose name speaks of a probability."""
    return next((c for c in df.columns if "prob" in c.lower()), None)


def attach_oof(
    train: DataFrame, test: DataFrame, name: str, oof: DataFrame, test_scores: DataFrame, key: str = "id"
) -> tuple[DataFrame, DataFrame, str | None]:
    """Add a model's scores to both frames, or return them unchanged with the reason.

    Skipped when row counts differ, no score column exists, or an id has no score.
    """
    col, test_col = score_column(oof), score_column(test_scores)
    if col is None or test_col is None:
        return train, test, "no score column"
    n_oof, n_train = oof.count(), train.count()
    if n_oof != n_train:
        return train, test, f"{n_oof} scores for {n_train} rows"
    out = f"{name}_proba_1"
    tr = lookup_join(train, oof.select(key, F.col(col).alias(out)), key)
    te = lookup_join(test, test_scores.select(key, F.col(test_col).alias(out)), key)
    for part in (tr, te):
        if part.where(F.col(out).isNull()).limit(1).count():
            return train, test, "ids without a score"
    return tr, te, None


def unseen_values(train: DataFrame, test: DataFrame, col: str, test_col: str | None = None) -> DataFrame:
    """Distinct test values that training never shows."""
    seen = train.select(F.col(col).alias("value")).distinct()
    return test.select(F.col(test_col or col).alias("value")).where(F.col("value").isNotNull()).distinct().join(seen, "value", "left_anti")
