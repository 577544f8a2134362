"""Global order without a global task.

A window with no partition key, or one over a two-valued label, pulls the table
through a couple of tasks. The helpers here split an order into buckets whose
totals are small, running-sum the totals, and finish inside each bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Rows a bucket of an order is meant to hold, and how many buckets there are.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 50_000, 4, 20_000


def _before(order: Sequence[str], by: Sequence[str]) -> Window:
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def hash_rank(df: DataFrame, by: Sequence[str], key: str, seed: int | str, hex_digits: int = 4) -> DataFrame:
    """Add ``_rank`` (1-based, ordered by ``md5(key || seed)`` within ``by``) and ``_group_rows``.

    The hash is uniform, so its leading digits cut every group, however large,
    into even buckets; a row's rank is its bucket's offset plus its place there.
    ``key`` identifies rows; rows without one are spread and ordered by what else they hold.
    """
    plain = [c for c, kind in df.dtypes if c != key and "map<" not in kind and kind != "variant"]
    other = F.concat(F.lit("\x00"), F.xxhash64(*plain).cast("string")) if plain else F.lit("\x00")
    h = F.md5(F.concat(F.coalesce(F.col(key).cast("string"), other), F.lit(str(seed))))
    group = F.concat_ws("\x1f", *[F.coalesce(F.col(b).cast("string"), F.lit("\x00")) for b in by]) if by else F.lit("")
    keyed = df.withColumn("_h", h).withColumn("_g", group).withColumn("_b", F.substring("_h", 1, hex_digits))
    sizes = keyed.groupBy("_g", "_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        "_g",
        "_b",
        F.coalesce(F.sum("_n").over(_before(["_b"], ["_g"])), F.lit(0)).alias("_offset"),
        F.sum("_n").over(Window.partitionBy("_g")).alias("_group_rows"),
    )
    place = F.row_number().over(Window.partitionBy("_g", "_b").orderBy("_h", F.col(key)))
    return (
        keyed.join(offsets, ["_g", "_b"])
        .withColumn("_rank", F.col("_offset") + place)
        .drop("_h", "_g", "_b", "_offset")
    )


def ordered_buckets(df: DataFrame, by: Sequence[str], value: str, ascending: bool = True) -> DataFrame:
    """Add ``_b``, a bucket number that grows along the order of (by, value).

    The rows are checkpointed first, so that whatever led to them is worked out once, and again in their buckets,
    so that every later read agrees on them. Bounds come from a sample of the rows themselves, groups and all:
    buckets hold about as many rows each, however long the tail of the values and however uneven the groups.
    """
    kept = cut(df.where(F.col(value).isNotNull()))
    order = [*map(F.col, by), F.col(value).asc() if ascending else F.col(value).desc()]
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, kept.count() // BUCKET_ROWS))
    return cut(kept.repartitionByRange(buckets, *order).withColumn("_b", F.spark_partition_id()))


def _bucket_offsets(bucketed: DataFrame, by: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """Per group and bucket: each sum's total there (``_t_``), in the buckets before it (``_o_``) and in the group."""
    totals = bucketed.groupBy(*by, "_b").agg(*[F.sum(c).alias(f"_t_{o}") for o, c in sums.items()])
    before = _before(["_b"], by)
    return totals.select(
        *by, "_b", *[f"_t_{o}" for o in sums],
        *[F.coalesce(F.sum(f"_t_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in sums],
        *[F.sum(f"_t_{o}").over(Window.partitionBy(*by)).alias(f"{o}_all") for o in sums],
    )


def _finished(bucketed: DataFrame, offsets: DataFrame, by: Sequence[str], value: str, sums: dict[str, str], ascending: bool = True) -> DataFrame:
    """Running sums inside each bucket on top of its offset."""
    order = F.col(value).asc() if ascending else F.col(value).desc()
    inside = Window.partitionBy(*by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = bucketed.join(offsets, [*by, "_b"])
    for out, c in sums.items():
        joined = joined.withColumn(out, F.col(f"_o_{out}") + F.sum(c).over(inside))
    return joined.drop("_b", *[f"{p}{o}" for o in sums for p in ("_o_", "_t_")])


def running_sums(df: DataFrame, by: Sequence[str], value: str, sums: dict[str, str], ascending: bool = True) -> DataFrame:
    """Inclusive running sums over a numeric order; one row per (by, value) expected.

    Rows fall into even, order-preserving buckets, bucket totals are summed first, and each bucket is then
    finished on its own. Totals per group are added as ``<out>_all``.
    """
    bucketed = ordered_buckets(df, by, value, ascending)
    return _finished(bucketed, _bucket_offsets(bucketed, by, sums), by, value, sums, ascending)


def sorted_index(df: DataFrame, order: Sequence[Column], sums: dict[str, str] | None = None) -> DataFrame:
    """Add ``_index`` (0-based place in a global sort) and running sums along it.

    The range-partitioned rows are checkpointed once, so partition ids and places
    are the same for every later read.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order))
    mid = F.monotonically_increasing_id()
    placed = ranged.withColumn("_mid", mid)
    placed = placed.withColumn("_p", F.shiftright("_mid", 33)).withColumn("_at", F.col("_mid").bitwiseAND(2**33 - 1))
    totals = placed.groupBy("_p").agg(
        F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_t_{o}") for o, c in (sums or {}).items()]
    )
    offsets = totals.select(
        "_p",
        F.coalesce(F.sum("_n").over(_before(["_p"], [])), F.lit(0)).alias("_first"),
        *[F.coalesce(F.sum(f"_t_{o}").over(_before(["_p"], [])), F.lit(0)).alias(f"_o_{o}") for o in (sums or {})],
    )
    # One row per shuffle partition: always small.
    out = placed.join(F.broadcast(offsets), "_p").withColumn("_index", F.col("_first") + F.col("_at"))
    inside = Window.partitionBy("_p").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    for o, c in (sums or {}).items():
        out = out.withColumn(o, F.col(f"_o_{o}") + F.sum(c).over(inside))
    return out.drop("_mid", "_p", "_at", "_first", *[f"_o_{o}" for o in (sums or {})])


def exact_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolated quantiles as rows ``(column, q, value)``.

    Rows shrink to counts per distinct value first; no task holds a whole column.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])
    rows = df.select(F.inline(pairs)).where(F.col("value").isNotNull())
    counts = rows.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    bucketed, sums = ordered_buckets(counts, ["column"], "value"), {"upto": "n"}
    offsets = _bucket_offsets(bucketed, ["column"], sums)
    # Only buckets that hold a wanted rank are ordered row by row.
    ranks = [rank for q in qs for pos in [(F.col("upto_all") - 1) * float(q)] for rank in (F.floor(pos), F.ceil(pos))]
    wanted = F.lit(False)
    for rank in ranks:
        wanted = wanted | ((rank >= F.col("_o_upto")) & (rank < F.col("_o_upto") + F.col("_t_upto")))
    placed = _finished(bucketed, offsets.where(wanted), ["column"], "value", sums).withColumnRenamed("upto_all", "total")
    first = F.col("upto") - F.col("n")

    def value_at(rank: Column) -> Column:
        return F.max(F.when((rank >= first) & (rank < F.col("upto")), F.col("value")))

    # Distinct values reduce to one row per column with the two neighbours of every quantile.
    found = {}
    for i, q in enumerate(qs):
        pos = (F.col("total") - 1) * float(q)
        found[f"lo{i}"], found[f"hi{i}"], found[f"at{i}"] = value_at(F.floor(pos)), value_at(F.ceil(pos)), F.max(pos - F.floor(pos))
    near = placed.groupBy("column").agg(*[e.alias(k) for k, e in found.items()])
    rows_out = [
        F.struct(F.lit(float(q)).alias("q"), (F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * F.col(f"at{i}")).alias("value"))
        for i, q in enumerate(qs)
    ]
    return near.select("column", F.inline(F.array(*rows_out)))
