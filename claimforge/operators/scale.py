"""Column scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lookups import scalar_struct
from .cleaning import require


def scale(df: DataFrame, cols: Sequence[str], method: str = "none") -> DataFrame:
    """``standardize`` with the sample deviation or ``normalize`` to 0..1; one aggregate for all columns."""
    return scale_groups(df, [(cols, method)])


def _wanted(df: DataFrame, groups: Sequence[tuple[Sequence[str], str]]) -> dict[str, tuple]:
    stats = {}
    for cols, method in groups:
        if method not in ("none", *METHODS):
            raise ValueError("method must be 'none', 'standardize' or 'normalize'")
        if method != "none":
            require(df, *cols)
            stats.update({c: METHODS[method] for c in cols})
    return stats


def scale_groups(df: DataFrame, groups: Sequence[tuple[Sequence[str], str]], fitted: DataFrame | None = None) -> DataFrame:
    """Several ``(columns, method)`` at once, from one aggregate, or from a ``scale_table`` of other rows."""
    stats = _wanted(df, groups)
    if not stats:
        return df
    if fitted is None:
        return _apply(df, df, stats)
    # One entry for each scaled column.
    held = fitted.agg(F.map_from_entries(F.collect_list(F.struct("column", F.struct("centre", "spread"))))).scalar()
    return _scaled(df.withColumn("_scale", held), {c: (F.col("_scale")[c]["centre"], F.col("_scale")[c]["spread"]) for c in stats})


def scale_table(df: DataFrame, groups: Sequence[tuple[Sequence[str], str]]) -> DataFrame:
    """``(column, centre, spread)`` of every column that is scaled."""
    stats = _wanted(df, groups)
    parts = [F.struct(F.lit(c).alias("column"), centre(F.col(c).cast("double")).alias("centre"), spread(F.col(c).cast("double")).alias("spread")) for c, (centre, spread) in stats.items()]
    return df.agg(F.array(*parts).alias("_s")).select(F.inline("_s"))


def _scaled(held: DataFrame, by: dict[str, tuple[Column, Column]]) -> DataFrame:
    out = {}
    for c, (centre, spread) in by.items():
        shifted = F.col(c).cast("double") - centre
        out[c] = F.when(spread > 0, shifted / spread).otherwise(shifted)
    return held.withColumns(out).drop("_scale")


def _range(c: Column) -> Column:
    return F.max(c) - F.min(c)


METHODS = {"standardize": (F.avg, F.stddev_samp), "normalize": (F.min, _range)}


def standard_scaler(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Scaler fitted on ``train`` with the population deviation."""
    require(train, *cols)
    return tuple(_apply(d, train, {c: (F.avg, F.stddev_pop) for c in cols}) for d in (train, test))


def _apply(df: DataFrame, fitted_on: DataFrame, cols: dict[str, tuple]) -> DataFrame:
    stats = {}
    for i, (c, (centre, spread)) in enumerate(cols.items()):
        v = F.col(c).cast("double")
        stats[f"c{i}"], stats[f"s{i}"] = centre(v), spread(v)
    s = scalar_struct(fitted_on, **stats)
    # One column holds the subquery, so that the plan does not repeat it for every use.
    held = df.withColumn("_scale", s)
    return _scaled(held, {c: (F.col("_scale")[f"c{i}"], F.col("_scale")[f"s{i}"]) for i, c in enumerate(cols)})
