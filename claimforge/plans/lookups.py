"""Joins to one-row-per-key tables.

Tables fitted from data are never broadcast on trust. On a cluster they are
materialised once in the shared folder and measured: within the limit they are
broadcast, so the wide side is not shuffled; beyond it the join is shuffled and
adaptive execution splits partitions that a hot key swells. Local sessions leave
the choice to adaptive execution. Only tables of constants, or of a row count
bounded by a parameter, are broadcast without measuring.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, shuffles_dropped

BROADCAST_ROWS = 10_000
BROADCAST_BYTES = 256 * 1024 * 1024
ROW_BYTES = 64
HOT_ROWS, HOT_KEY_CHARS = 100_000, 256
#: Partitions for each core where rows are dealt by key before they are taken apart, so that a part fits in memory.
PARTS_PER_CORE = 32
SETTLE_CONF = "spark.claimforge.settleLookups"


def fixed_table(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A table of constants, small by construction."""
    if len(rows) > BROADCAST_ROWS:
        raise ValueError("fixed tables hold constants only; read larger tables from storage")
    return F.broadcast(spark.createDataFrame(list(rows), schema))


def bounded(table: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast a table whose row count a parameter bounds, when the bound is small."""
    return F.broadcast(table) if max_rows <= BROADCAST_ROWS else table


def measured(table: DataFrame) -> tuple[DataFrame, bool | None]:
    """The table materialised, and whether it is small enough to broadcast; None where nothing is measured.

    ``spark.claimforge.settleLookups`` switches this on or off; unset, it is on
    wherever the session is not local.
    """
    spark = table.sparkSession
    chosen = spark.conf.get(SETTLE_CONF, None)
    on = chosen == "true" if chosen is not None else not spark.sparkContext.master.startswith("local")
    if not on:
        return table, None
    with shuffles_dropped(spark):
        kept = cut(table)
    # Every column counts, values that are strings, lists or maps included.
    width = F.length(F.to_json(F.struct(*[F.col(c) for c, kind in kept.dtypes if kind not in ("vector", "variant")])))
    rows, chars = kept.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return kept, rows * ROW_BYTES + chars * 2 <= BROADCAST_BYTES


def dealt(df: DataFrame, key: str) -> DataFrame:
    """Rows of a key in one partition, so that what is made of them is grouped by key, or by key and more, where it is.

    Whole texts are moved once instead of their terms, which are several times larger. The parts are many and not merged again.
    """
    return df.repartition(dealt_parts(df.sparkSession), key)


def dealt_parts(spark: SparkSession) -> int:
    """How many parts ``dealt`` makes."""
    context = spark.sparkContext
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return parts if context.master.startswith("local[") else max(parts, PARTS_PER_CORE * context.defaultParallelism)


def settle(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Materialise a fitted table and broadcast it if its measured size allows."""
    kept, small = measured(table)
    return F.broadcast(kept) if small else kept


def split_join(rows: DataFrame, table: DataFrame, key: str, weight: str, home: Callable[[DataFrame], DataFrame] | None = None, how: str = "inner") -> DataFrame:
    """Join (inner or left) to a one-row-per-key table too large to broadcast, where few keys hold most of the rows.

    The ``HOT_ROWS`` keys of the largest ``weight`` are broadcast, so their rows stay where they are; only rows
    of the other keys are shuffled by key, and where ``home`` is given by it afterwards, to where they came from.
    A table that measures small is broadcast whole.
    """
    kept, small = measured(table)
    if small is not False:
        return rows.join(F.broadcast(kept) if small else kept, key, how)
    hot = F.broadcast(kept.where(F.length(F.col(key).cast("string")) <= HOT_KEY_CHARS).orderBy(F.desc(weight), key).limit(HOT_ROWS))
    rest = kept.join(hot.select(key), key, "left_anti")
    cold = rows.join(hot.select(key), key, "left_anti").join(rest, key, how)
    return rows.join(hot, key).unionByName(cold if home is None else home(cold))


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    key: str | Sequence[str],
    table_key: str | Sequence[str] | None = None,
    defaults: dict[str, object] | None = None,
    fixed: bool = False,
) -> DataFrame:
    """Left join to a one-row-per-key table; unmatched values take their default.

    ``fixed`` marks tables whose size is bounded already, which need no measuring.
    """
    keys = [key] if isinstance(key, str) else list(key)
    table_keys = keys if table_key is None else [table_key] if isinstance(table_key, str) else list(table_key)
    if not fixed:
        table = settle(table, table_keys)
    renamed = table.select(
        *[F.col(t).alias(f"_lk_{i}") for i, t in enumerate(table_keys)],
        *[c for c in table.columns if c not in table_keys],
    )
    cond: Column | None = None
    for i, k in enumerate(keys):
        part = F.col(k) == F.col(f"_lk_{i}")
        cond = part if cond is None else cond & part
    out = df.join(renamed, cond, "left").drop(*[f"_lk_{i}" for i in range(len(keys))])
    for name, value in (defaults or {}).items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return out


def scalar_struct(df: DataFrame, **aggs: Column) -> Column:
    """Several whole-table aggregates as one uncorrelated scalar subquery."""
    return df.agg(F.struct(*[v.alias(k) for k, v in aggs.items()]).alias("_s")).scalar()
