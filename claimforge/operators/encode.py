"""Encoders, column roles and schema alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lookups import lookup_join
from ..plans.ordered import sorted_index
from .cleaning import require


def ordinal_table(train: DataFrame, col: str) -> DataFrame:
    """``(col, code)``: place of each training value in sorted order."""
    values = train.where(F.col(col).isNotNull()).select(col).distinct()
    return sorted_index(values, [F.col(col).asc()]).select(col, F.col("_index").cast("int").alias("code"))


def ordinal_apply(df: DataFrame, tables: dict[str, DataFrame], suffix: str = "_code") -> DataFrame:
    """Codes for fitted columns; unknown values and absent columns give -1."""
    for col, table in tables.items():
        out = f"{col}{suffix}"
        if col not in df.columns:
            df = df.withColumn(out, F.lit(-1))
            continue
        named = table.select(F.col(col).alias("_v"), F.col("code").alias(out))
        df = lookup_join(df, named, col, "_v", {out: -1})
    return df


def ordinal_encode(train: DataFrame, test: DataFrame, cols: Sequence[str], suffix: str = "_code") -> tuple[DataFrame, DataFrame]:
    tables = {c: ordinal_table(train, c) for c in cols}
    return ordinal_apply(train, tables, suffix), ordinal_apply(test, tables, suffix)


def one_hot(
    train: DataFrame, test: DataFrame, cols: Sequence[str], values: dict[str, list] | None = None, max_values: int = 10_000
) -> tuple[DataFrame, DataFrame]:
    """One 0/1 column per training value; unknown values are all zeros. ``one_hot_sparse`` keeps many values in one column.

    A column with more than ``max_values`` values is refused unless they are given.
    """
    flags = {}
    for c in cols:
        require(train, c)
        known = (values or {}).get(c)
        if known is None:
            found = train.where(F.col(c).isNotNull()).select(c).distinct().limit(max_values + 1).collect()
            if len(found) > max_values:
                raise ValueError(f"{c} has more than {max_values} values: give them, or take one_hot_sparse")
            known = sorted(r[0] for r in found)
        flags.update({f"{c}_{v}": F.coalesce(F.col(c) == F.lit(v), F.lit(False)).cast("int") for v in known})
    return train.withColumns(flags), test.withColumns(flags)


def one_hot_sparse(train: DataFrame, test: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Sparse one-hot vectors for columns with many values."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer

    stages = [
        StringIndexer(inputCols=list(cols), outputCols=[f"{c}_idx" for c in cols], handleInvalid="keep", stringOrderType="alphabetAsc"),
        OneHotEncoder(inputCols=[f"{c}_idx" for c in cols], outputCols=[f"{c}_vec" for c in cols], handleInvalid="keep", dropLast=True),
    ]
    model = Pipeline(stages=stages).fit(train)
    drop = [f"{c}_idx" for c in cols]
    return model.transform(train).drop(*drop), model.transform(test).drop(*drop)


RAW_SOURCES = ("statement", "speaker", "subject", "speaker_job", "party_affiliation", "state_info")


def column_roles(df: DataFrame, label: str = "label", sources: Sequence[str] = RAW_SOURCES) -> dict[str, list[str]]:
    """Numeric features, categoricals to encode, and text columns to leave out; schema only."""
    roles: dict[str, list[str]] = {"numeric": [], "categorical": [], "text": [], "other": []}
    for f in df.schema.fields:
        if f.name == label:
            continue
        if isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            roles["numeric"].append(f.name)
        elif isinstance(f.dataType, T.StringType):
            is_text = f.name.endswith(("_clean", "_original")) or f.name in sources
            roles["text" if is_text else "categorical"].append(f.name)
        else:
            roles["other"].append(f.name)
    return roles


def column_role_table(df: DataFrame, label: str = "label", sources: Sequence[str] = RAW_SOURCES) -> DataFrame:
    """Per column its role, filled rows and distinct values: ``column, role, filled, distinct_values``."""
    roles = [(c, role) for role, cols in column_roles(df, label, sources).items() for c in cols]
    cells = [F.struct(F.lit(c).alias("column"), F.lit(role).alias("role"), F.col(c).cast("string").alias("value")) for c, role in roles]
    values = df.select(F.inline(F.array(*cells))).groupBy("column", "role", "value").agg(F.count("value").alias("n"))
    return values.groupBy("column", "role").agg(F.sum("n").alias("filled"), F.count("value").alias("distinct_values"))


def align_schema(df: DataFrame, feature_names: Sequence[str], fill: float = 0.0, keep: Sequence[str] = ()) -> DataFrame:
    """Exactly ``feature_names`` in order as doubles; absent columns and nulls become ``fill``."""
    have = set(df.columns)
    features = [
        (F.coalesce(F.col(f).cast("double"), F.lit(float(fill))) if f in have else F.lit(float(fill))).alias(f)
        for f in feature_names
    ]
    return df.select(*keep, *features)


def restore_rows(df: DataFrame, ids: DataFrame, key: str = "id", defaults: dict[str, object] | None = None) -> DataFrame:
    """One row per input id, in case preparation dropped some."""
    return lookup_join(ids.select(key), df, key, defaults=defaults)
