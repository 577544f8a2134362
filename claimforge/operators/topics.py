"""Multi-valued topic columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.lookups import lookup_join
from .category import frequency_encode, group_rare, is_rare
from .cleaning import require

STRATEGIES = ("first", "longest", "most_frequent", "multi")


def topic_array(c: Column | str, split: bool = True) -> Column:
    x = X.text(c)
    if not split:
        return F.when(x == "", F.array().cast("array<string>")).otherwise(F.array(x))
    return F.filter(F.transform(F.split(x, "[,|/;]+"), X.strip), lambda t: t != "")


def split_topics(df: DataFrame, col: str, out: str | None = None, split: bool = True) -> DataFrame:
    require(df, col)
    return df.withColumn(out or f"{col}_topics", topic_array(col, split))


def topic_shape(df: DataFrame, topics: str, clean: str, prefix: str) -> DataFrame:
    require(df, topics, clean)
    n = F.size(topics)
    return df.withColumns(
        {
            f"{prefix}_topic_count": n,
            f"{prefix}_has_multiple_topics": (n > 1).cast("int"),
            f"{prefix}_length": F.length(X.text(clean)),
            f"{prefix}_token_count": X.word_count(X.text(clean)),
        }
    )


def topic_counts(df: DataFrame, topics: str) -> DataFrame:
    return df.select(F.explode(topics).alias("topic")).groupBy("topic").agg(F.count(F.lit(1)).alias("n"))


def _most_frequent(df: DataFrame, topics: str, counts: DataFrame | None = None) -> DataFrame:
    """``(topics, _top)``: worked out once per distinct topic list."""
    lists = df.where(F.size(topics) > 0).select(topics).distinct()
    each = lists.select(topics, F.posexplode(topics).alias("_pos", "topic"))
    ranked = lookup_join(each, topic_counts(df, topics) if counts is None else counts, "topic", defaults={"n": 0})
    best = F.max_by("topic", F.struct("n", F.length("topic"), -F.col("_pos")))
    return ranked.groupBy(topics).agg(best.alias("_top"))


def primary_topic(
    df: DataFrame, topics: str, strategy: str = "first", max_topics: int | None = None,
    multi_label: str = "multi-topic", out: str = "primary", fit_on: DataFrame | None = None, counts: DataFrame | None = None,
) -> DataFrame:
    """One topic per row; empty lists are ``unknown``, over-long ones ``multi_label``.

    ``counts`` are ``topic_counts`` of other rows; a topic they lack counts nothing.
    """
    require(df, topics)
    choice = strategy.strip().lower()
    if choice not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    t = F.col(topics)
    if choice == "most_frequent":
        df = lookup_join(df, _most_frequent(df if fit_on is None else fit_on, topics, counts), topics)
        picked = F.col("_top")
    elif choice == "longest":
        longest = F.array_max(F.transform(t, F.length))
        picked = X.bind(longest, lambda n: F.get(F.filter(t, lambda v: F.length(v) == n), 0))
    elif choice == "multi":
        picked = F.lit("multi-topic")
    else:
        picked = F.get(t, 0)
    value = F.when(F.size(t) == 0, F.lit("unknown")).otherwise(picked)
    if max_topics is not None:
        value = F.when(F.size(t) <= max_topics, value).otherwise(F.lit(multi_label))
    return df.withColumn(out, value).drop("_top")


def primary_features(
    df: DataFrame, primary: str, prefix: str, threshold: int = 10, rare_label: str = "other", fit_on: DataFrame | None = None,
    fitted: DataFrame | None = None,
) -> DataFrame:
    """Frequency, rare flag and rare-grouped value of the primary topic."""
    out = frequency_encode(df, primary, prefix, fit_on, fitted).drop(f"{prefix}_frequency_pct")
    out = is_rare(out, f"{prefix}_frequency", threshold, f"{prefix}_is_rare")
    return group_rare(out, primary, threshold, rare_label, f"{primary}_grouped", f"{prefix}_frequency")


def topic_vocabulary(train: DataFrame, topics: str, max_topics: int = 10_000) -> list[str]:
    """Sorted training topics for column output, one column each; ``topic_indicators_long`` has no such list.

    More than ``max_topics`` are refused: they would not make a table's columns.
    """
    found = train.select(F.explode(topics).alias("t")).distinct().limit(max_topics + 1).collect()
    if len(found) > max_topics:
        raise ValueError(f"more than {max_topics} topics: give a vocabulary, or take topic_indicators_long")
    return sorted(r["t"] for r in found)


def multi_label_binarize(
    train: DataFrame, test: DataFrame, topics: str, prefix: str = "subject_", vocabulary: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """One 0/1 column per training topic; a plain projection, no shuffle."""
    vocab = vocabulary if vocabulary is not None else topic_vocabulary(train, topics)
    flags = {f"{prefix}{v}": F.array_contains(topics, v).cast("int") for v in vocab}
    return train.withColumns(flags), test.withColumns(flags)


def topic_indicators_long(train: DataFrame, test: DataFrame, key: str, topics: str) -> tuple[DataFrame, DataFrame]:
    """Indicators as ``(key, topic, value)`` for vocabularies of any width; unseen test topics go."""
    def pairs(d: DataFrame) -> DataFrame:
        return d.select(key, F.explode(F.array_distinct(topics)).alias("topic"))

    seen = train.select(F.explode(topics).alias("topic")).distinct()
    one = F.lit(1).alias("value")
    return pairs(train).select("*", one), pairs(test).join(seen, "topic", "left_semi").select(key, "topic", one)
