"""Deterministic splits, sampling and row sets.

Assignments follow ``md5(id || seed)`` order, so they are reproducible on any
cluster layout and need no pass through a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.lookups import lookup_join
from ..plans.ordered import hash_rank
from .cleaning import require


def _take(frac: float) -> Column:
    return F.ceil(F.round(F.col("_group_rows") * F.lit(frac), 9))


def stratified_holdout(df: DataFrame, label: str, key: str, frac: float = 0.2, seed: int = 42, out: str = "is_holdout") -> DataFrame:
    """Flag the first ``ceil(frac*n)`` rows of each class."""
    require(df, label, key)
    ranked = hash_rank(df, [label], key, seed)
    return ranked.withColumn(out, (F.col("_rank") <= _take(frac)).cast("int")).drop("_rank", "_group_rows")


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    require(df, label, key)
    if k < 2:
        raise ValueError("k must be at least 2")
    ranked = hash_rank(df, [label], key, seed)
    return ranked.withColumn(out, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank", "_group_rows")


def grouped_folds(df: DataFrame, group: str, k: int = 5, out: str = "fold") -> DataFrame:
    """Fold by hash of a group key, so a group never sits on both sides."""
    return df.withColumn(out, X.md5_mod(group, k))


def three_way_split(
    df: DataFrame, label: str, key: str, holdout: float = 0.2, validation: float = 0.1, seed: int = 42, out: str = "part"
) -> DataFrame:
    """``holdout`` first, then ``validation`` as a share of the rest; one ranking serves both."""
    require(df, label, key)
    ranked = hash_rank(df, [label], key, seed).withColumn("_h", _take(holdout))
    rest = F.col("_group_rows") - F.col("_h")
    v = F.ceil(F.round(rest * F.lit(validation), 9))
    part = F.when(F.col("_rank") <= F.col("_h"), "holdout").when(F.col("_rank") <= F.col("_h") + v, "validation").otherwise("train")
    return ranked.withColumn(out, part).drop("_rank", "_group_rows", "_h")


def bucket_split(df: DataFrame, key: str, cutoff: int = 20, n: int = 100) -> tuple[DataFrame, DataFrame]:
    """Train and validation rows by md5 bucket of the id."""
    bucketed = df.withColumn("id_bucket", X.md5_mod(key, n))
    return bucketed.where(F.col("id_bucket") >= cutoff), bucketed.where(F.col("id_bucket") < cutoff)


RUN_OF_COPIES = 10_000


def oversample_minority(df: DataFrame, label: str, key: str, minority: int = 0, seed: int = 42) -> DataFrame:
    """Majority rows plus as many minority rows drawn with replacement; ``draw`` numbers the copies of a row from 1.

    Each majority row is one draw: fifteen digits of its md5 pick a minority rank. Draws are counted per rank
    before anything moves, so however few the minority rows, none is a hot key; a row drawn very often is cut into
    runs of ``RUN_OF_COPIES`` copies that are dealt out before they are made.
    """
    require(df, label, key)
    y = F.col(label)
    few = hash_rank(df.where(y == minority), [], key, seed)
    many = df.where(y != minority)
    n_few = df.agg(F.greatest(F.count(F.when(y == minority, 1)), F.lit(1))).scalar()
    # Rows without a key draw by what else they hold.
    plain = [c for c, kind in df.dtypes if c != key and "map<" not in kind and kind != "variant"]
    own = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("\x00"), F.xxhash64(*plain).cast("string")))
    digits = F.conv(F.substring(F.md5(F.concat(own, F.lit(f":{seed}:draw"))), 1, 15), 16, 10).cast("bigint")
    drawn = many.select((F.pmod(digits, n_few) + 1).alias("_rank")).groupBy("_rank").agg(F.count(F.lit(1)).alias("_copies"))
    runs = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_copies") - 1) / RUN_OF_COPIES))
    dealt = few.join(drawn, "_rank").withColumn("_run", F.explode(runs)).repartition("_rank", "_run")
    first = F.col("_run") * RUN_OF_COPIES + 1
    copies = dealt.withColumn("draw", F.explode(F.sequence(first, F.least(F.col("_copies"), first + RUN_OF_COPIES - 1))))
    return many.withColumn("draw", F.lit(None).cast("bigint")).unionByName(copies.select(*df.columns, "draw"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight ``n/(k*n_c)`` per class, and the positive weight ``n0/n1``."""
    require(df, label)
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    y = F.col(label)
    all_rows = counts.agg(
        F.struct(
            F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"),
            F.sum(F.when(y == 0, F.col("n"))).alias("n0"), F.sum(F.when(y == 1, F.col("n"))).alias("n1"),
        )
    ).scalar()
    return counts.withColumn("weight", all_rows["n"] / (all_rows["k"] * F.col("n"))).withColumn(
        "scale_pos_weight", F.try_divide(all_rows["n0"].cast("double"), all_rows["n1"].cast("double"))
    )


def add_class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    table = class_weights(df, label).select(label, F.col("weight").alias(out))
    return lookup_join(df, table, label)


def add_group_class_weights(df: DataFrame, group: str, label: str, out: str = "weight") -> DataFrame:
    """Balanced class weights inside each group, such as a subject: ``n_g/(k_g*n_gc)``."""
    require(df, group, label)
    cells = df.where(F.col(group).isNotNull() & F.col(label).isNotNull()).groupBy(group, label).agg(F.count(F.lit(1)).alias("_n"))
    totals = cells.groupBy(group).agg(F.sum("_n").alias("_g"), F.count(F.lit(1)).alias("_k"))
    table = cells.join(totals, group).select(group, label, (F.col("_g") / (F.col("_k") * F.col("_n"))).alias(out))
    return lookup_join(df, table, [group, label])


def union_pseudo_labels(
    train: DataFrame, test: DataFrame, scores: DataFrame, key: str, label: str, weight: float = 0.7, fold: str = "fold"
) -> DataFrame:
    """Scored test rows join training with a weight and fold -1, so they never validate."""
    require(scores, key, label)
    scored = test.drop(label).join(scores.select(key, label), key)
    extra = scored.withColumn("weight", F.lit(float(weight))).withColumn(fold, F.lit(-1))
    base = train.withColumn("weight", F.lit(1.0))
    cols = [c for c in base.columns if c in extra.columns]
    return base.select(*cols).unionByName(extra.select(*cols))


def drop_duplicate_rows(df: DataFrame, subset: Sequence[str], key: str) -> DataFrame:
    """Keep the row with the smallest key of every group of equal rows.

    Groups are keyed by a digest of the compared columns and reduced map-side, so
    neither long texts nor large groups of copies travel.
    """
    require(df, *subset, key)
    first = df.groupBy(digest(subset).alias("_d")).agg(F.min(key).alias(key)).select(key)
    return df.join(first, key, "left_semi")


def digest(cols: Sequence[str]) -> Column:
    """SHA-256 over the columns; nulls differ from empty strings."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(c).cast("string")), F.lit("n")) for c in cols]
    lengths = [F.coalesce(F.length(F.col(c).cast("string")), F.lit(-1)).cast("string") for c in cols]
    return F.sha2(F.concat_ws("\x1f", *lengths, *parts), 256)
