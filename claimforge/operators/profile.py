"""Profiles and exploratory statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.scores import chi_square_tail
from ..plans.lookups import lookup_join, scalar_struct
from ..plans.ordered import exact_quantiles, sorted_index
from .category import value_counts
from .cleaning import pollution_profile, require
from .splits import digest

def row_count() -> Column:
    return F.count(F.lit(1))


def _count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def long_metrics(df: DataFrame, metrics: dict[str, Column], name: str = "metric", value: str = "value") -> DataFrame:
    """One aggregate row turned into ``(metric, value)`` rows."""
    rows = F.array(*[F.struct(F.lit(k).alias(name), v.cast("double").alias(value)) for k, v in metrics.items()])
    return df.agg(rows.alias("_m")).select(F.inline("_m"))


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Null count and percentage per column, one pass."""
    cols = list(cols or df.columns)
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                _count_if(F.col(c).isNull()).alias("null_count"),
                F.coalesce(F.try_divide(_count_if(F.col(c).isNull()) * 100.0, row_count()), F.lit(0.0)).alias("null_pct"),
            )
            for c in cols
        ]
    )
    return df.agg(rows.alias("_m")).select(F.inline("_m"))


def null_share_by(df: DataFrame, col: str, by: str) -> DataFrame:
    require(df, col, by)
    return df.groupBy(by).agg(
        row_count().alias("rows"), _count_if(F.col(col).isNull()).alias("null_count"), (F.avg(F.col(col).isNull().cast("int")) * 100).alias("null_pct")
    )


def class_balance(df: DataFrame, label: str) -> DataFrame:
    counts = value_counts(df, label)
    s = scalar_struct(counts, total=F.sum("n"), hi=F.max("n"), lo=F.min("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / s["total"]).withColumn("majority_ratio", s["hi"] / s["lo"])


def short(v: Column, on: bool = True) -> Column:
    """Long values as their digest, so that counting distinct texts does not shuffle the texts."""
    return F.when(F.length(v) > 64, F.sha2(v, 256)).otherwise(v) if on else v


def cardinality(df: DataFrame, cols: Sequence[str], normalized: bool = False) -> DataFrame:
    """Distinct values per column, raw and optionally after trim and lower."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), short(F.col(c).cast("string"), not normalized).alias("v")) for c in cols])
    flat = df.select(F.inline(pairs)).where(F.col("v").isNotNull())
    values = flat.groupBy("column", "v").agg(F.lit(1).alias("_"))
    out = values.groupBy("column").agg(row_count().alias("distinct_values"))
    if not normalized:
        return out
    norm = values.select("column", F.lower(X.strip(F.col("v"))).alias("v")).distinct().groupBy("column").agg(row_count().alias("distinct_normalized"))
    return out.join(norm, "column")


def top_values(df: DataFrame, col: str, n: int, pattern: str | None = None) -> DataFrame:
    """Most frequent values, optionally only those matching a pattern."""
    rows = df if pattern is None else df.where(F.col(col).rlike(pattern))
    return value_counts(rows, col).orderBy(F.desc("n"), col).limit(n)


def describe(df: DataFrame, cols: Sequence[str], percentiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Count, mean, sample deviation, min, max and exact percentiles per column."""
    basics = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"), F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max"),
            )
            for c in cols
        ]
    )
    base = df.agg(basics.alias("_b")).select(F.inline("_b"))
    q = exact_quantiles(df, cols, percentiles)
    wide = q.groupBy("column").agg(*[F.max(F.when(F.col("q") == float(p), F.col("value"))).alias(f"p{p * 100:g}") for p in percentiles])
    return base.join(wide, "column", "left")


def duplicate_report(df: DataFrame, cols: Sequence[str], label: str | None = None) -> DataFrame:
    """Rows, distinct keys, extra copies, rows in a duplicate group, groups with conflicting labels."""
    require(df, *cols)
    aggs = [row_count().alias("n")]
    if label:
        aggs += [F.min(label).alias("lo"), F.max(label).alias("hi")]
    groups = df.select(digest(cols).alias("_d"), *([label] if label else [])).groupBy("_d").agg(*aggs)
    metrics = {
        "rows": F.sum("n"),
        "distinct": row_count(),
        "extra_copies": F.sum(F.col("n") - 1),
        "rows_in_duplicate_groups": F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)),
    }
    if label:
        metrics["conflicting_groups"] = _count_if(F.col("lo") != F.col("hi"))
    return long_metrics(groups, metrics)


def top_longest(df: DataFrame, col: str, key: str, n: int, preview: int = 120) -> DataFrame:
    """Longest texts; previews are cut only for the rows that survive the top-n."""
    x = X.text(col)
    shaped = df.select(key, F.length(x).alias("text_length"), X.word_count(x).alias("word_count"), x.alias("_x"))
    top = shaped.orderBy(F.desc("text_length"), F.desc("word_count"), key).limit(n)
    return top.withColumn("preview", F.substring(X.squeeze(F.col("_x")), 1, preview)).drop("_x")


def pollution_top(df: DataFrame, col: str, key: str, n: int = 10, min_tabs: int = 3) -> DataFrame:
    """The worst rows; previews are cut only for the rows that survive the top-n."""
    profiled = pollution_profile(df.select(key, col), col, min_tabs)
    top = profiled.orderBy(F.desc("pollution_score"), F.desc("statement_length"), key).limit(n)
    return top.withColumn("statement_preview", F.substring(X.sub(X.text(col), f"{X.W.SPACE}+", " "), 1, 220)).drop(col)


def pollution_summary(df: DataFrame, col: str, min_tabs: int = 3) -> DataFrame:
    p = pollution_profile(df.select(col), col, min_tabs)
    return long_metrics(
        p,
        {
            "Tabs": _count_if(F.col("tab_count") > 0),
            "Newlines": _count_if(F.col("newline_count") > 0),
            "URLs": _count_if(F.col("url_count") > 0),
            "High symbol density": _count_if(F.col("special_char_ratio") > 0.20),
            "Row spillover": _count_if(F.col("row_spillover_flag")),
        },
        "signal",
        "count",
    )


def dataset_summary(df: DataFrame) -> DataFrame:
    fields = df.schema.fields
    numeric = sum(isinstance(f.dataType, T.NumericType) for f in fields)
    texts = sum(isinstance(f.dataType, T.StringType) for f in fields)
    nulls = F.lit(0)
    for f in fields:
        nulls = nulls + F.col(f.name).isNull().cast("int")
    groups = df.select(digest(df.columns).alias("_d"), nulls.alias("_nulls")).groupBy("_d").agg(row_count().alias("n"), F.sum("_nulls").alias("nulls"))
    return long_metrics(
        groups,
        {
            "rows": F.sum("n"),
            "columns": F.lit(len(fields)),
            "numeric_columns": F.lit(numeric),
            "text_columns": F.lit(texts),
            "missing_values": F.sum("nulls"),
            "duplicate_rows": F.sum(F.col("n") - 1),
        },
    )


def column_inventory(df: DataFrame) -> DataFrame:
    """Type, non-null count and distinct values per column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), short(F.col(c).cast("string")).alias("v")) for c, t in df.dtypes])
    values = df.select(F.inline(pairs)).groupBy("column", "type", "v").agg(row_count().alias("n"))
    some = F.col("v").isNotNull()
    return values.groupBy("column", "type").agg(
        F.sum(F.when(some, F.col("n")).otherwise(0)).alias("non_null"), _count_if(some).alias("distinct_values")
    )


def id_quality(df: DataFrame, key: str) -> DataFrame:
    ids = df.select(X.strip(F.col(key).cast("string")).alias("v")).groupBy("v").agg(row_count().alias("n"))
    blank = F.col("v").isNull() | (F.col("v") == "")
    return long_metrics(
        ids,
        {
            "rows": F.sum("n"),
            "missing": F.sum(F.when(blank, F.col("n")).otherwise(0)),
            "duplicates": F.sum(F.col("n") - 1),
            "distinct": _count_if(F.col("v").isNotNull()),
        },
    )


def cumulative_coverage(df: DataFrame, col: str) -> DataFrame:
    """Values ranked by count (ties by value) with the running share of rows."""
    counts = value_counts(df, col)
    ranked = sorted_index(counts, [F.col("n").desc(), F.col(col).asc()], {"running": "n"})
    total = df.where(F.col(col).isNotNull()).agg(row_count()).scalar()
    return ranked.select(col, "n", (F.col("_index") + 1).alias("rank"), "running", (F.col("running") / total).alias("coverage"))


FREQUENCY_EDGES = [0, 1, 2, 5, 10, 50, 100]
FREQUENCY_LABELS = ["1", "2", "3-4", "5-9", "10-49", "50-99", "100+"]


def frequency_buckets(df: DataFrame, col: str, edges: Sequence[int] = FREQUENCY_EDGES, labels: Sequence[str] = FREQUENCY_LABELS) -> DataFrame:
    """Rows per right-closed frequency band; the last band has no upper end."""
    n = F.col("n")
    band = F.when(F.lit(False), F.lit(""))
    place = F.when(F.lit(False), F.lit(0))
    for i, label in enumerate(labels):
        inside = (n > edges[i]) & (n <= edges[i + 1]) if i + 1 < len(edges) else n > edges[i]
        band, place = band.when(inside, F.lit(label)), place.when(inside, F.lit(i))
    return value_counts(df, col).groupBy(band.alias("band"), place.alias("band_order")).agg(F.sum("n").alias("rows"), row_count().alias("distinct_values"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cell counts with margins (null level) and row percentages, from one cube."""
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).cube(a, b).agg(row_count().alias("n"), F.grouping(a).alias("ga"), F.grouping(b).alias("gb"))
    # Margins meet their rows by the grouping bit and the value; only then are they named, so a value "All" is one of many.
    keyed = cells.withColumn("_level", F.concat_ws("\x1f", F.col("ga").cast("string"), F.col(a).cast("string")))
    margins = keyed.where(F.col("gb") == 1).select("_level", F.col("n").alias("row_total"))
    joined = lookup_join(keyed, margins, "_level").withColumn("row_pct", F.col("n") * 100.0 / F.col("row_total"))
    return joined.select(
        F.when(F.col("ga") == 1, "All").otherwise(F.col(a).cast("string")).alias(a),
        F.when(F.col("gb") == 1, "All").otherwise(F.col(b).cast("string")).alias(b),
        "n", "row_total", "row_pct",
    )


def crosstab_wide(df: DataFrame, a: str, b: str, values: Sequence) -> DataFrame:
    """One column per listed value of ``b`` and a total."""
    y = F.col(b)
    return df.where(F.col(a).isNotNull()).groupBy(a).agg(*[_count_if(y == v).alias(f"{b}_{v}") for v in values], _count_if(y.isNotNull()).alias("total"))


def chi_square_independence(df: DataFrame, a: str, b: str) -> DataFrame:
    """Chi-square statistic and degrees of freedom (Yates-corrected for a 2x2 table).

    With ``E = r*c/n`` an empty cell adds its E, and all E make n, so only observed cells are needed.
    """
    cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(row_count().alias("o"))
    rows = cells.groupBy("a").agg(F.sum("o").alias("r"))
    cols = cells.groupBy("b").agg(F.sum("o").alias("c"))
    n = cells.agg(F.sum("o").cast("double")).scalar()
    nr, nc = rows.agg(row_count()).scalar(), cols.agg(row_count()).scalar()
    placed = lookup_join(lookup_join(cells, rows, "a"), cols, "b")
    o, r, c = (F.col(x).cast("double") for x in ("o", "r", "c"))
    e = r * c / n
    observed = F.sum((o - e) * (o - e) / e) + F.greatest(n - F.sum(e), F.lit(0.0))
    stats = placed.agg(observed.alias("all"), F.max(F.abs(o - e)).alias("gap"))
    # All four cells of a 2x2 table miss expectation by the same amount.
    shrunk = F.greatest(F.col("gap") - 0.5, F.lit(0.0))
    inverse = [t.agg(F.sum(1.0 / F.col(x))).scalar() for t, x in ((rows, "r"), (cols, "c"))]
    yates = shrunk * shrunk * n * inverse[0] * inverse[1]
    return stats.select(
        F.when((nr == 2) & (nc == 2), yates).otherwise(F.col("all")).alias("chi2"),
        ((nr - 1) * (nc - 1)).alias("dof"),
    )


def chi_square_p_value(df: DataFrame, a: str, b: str) -> DataFrame:
    """p-value, degrees of freedom and statistic of ``chi_square_independence``, for any number of categories."""
    found = chi_square_independence(df, a, b)
    return found.select(chi_square_tail(F.col("chi2"), F.col("dof")).alias("p_value"), F.col("dof").cast("int").alias("dof"), F.col("chi2").alias("statistic"))


def category_profile(df: DataFrame, raw: str, clean: str, flags: dict[str, Column] | None = None, threshold: int = 5) -> DataFrame:
    """Metric/value table of a category column: blanks, frequency bands, medians, flag shares."""
    require(df, raw, clean)
    r = X.text(raw)
    shaped = df.select(
        F.col(clean).alias("v"), F.col(raw).isNull().alias("is_null"), (X.strip(r) == "").alias("is_blank"),
        *[f.cast("double").alias(f"flag_{k}") for k, f in (flags or {}).items()],
    )
    per = shaped.groupBy("v").agg(
        row_count().alias("n"), _count_if(F.col("is_null")).alias("nulls"), _count_if(F.col("is_blank")).alias("blanks"),
        *[F.sum(f"flag_{k}").alias(f"flag_{k}") for k in (flags or {})],
    )
    n = F.col("n")
    metrics = {
        "rows": F.sum("n"),
        "missing values": F.sum("nulls"),
        "blank values": F.sum("blanks"),
        "distinct values": row_count(),
        "values occurring once": _count_if(n == 1),
        "values occurring 2-4 times": _count_if((n >= 2) & (n <= 4)),
        "values occurring 5-9 times": _count_if((n >= 5) & (n <= 9)),
        "values occurring 10+ times": _count_if(n >= 10),
        "pct rare values": _count_if(n < threshold) * 100.0 / row_count(),
        "pct rows in rare values": F.sum(F.when(n < threshold, n).otherwise(0)) * 100.0 / F.sum("n"),
        **{f"pct {k}": F.sum(f"flag_{k}") * 100.0 / F.sum("n") for k in (flags or {})},
    }
    lengths = df.select(F.length(clean).alias("median length"), X.word_count(F.col(clean)).alias("median token count"))
    medians = exact_quantiles(lengths, ["median length", "median token count"], [0.5]).select(F.col("column").alias("metric"), "value")
    return long_metrics(per, metrics).unionByName(medians)


def topic_count_distribution(df: DataFrame, topics: str) -> DataFrame:
    counts = df.groupBy(F.size(topics).alias("topic_count")).agg(row_count().alias("n"))
    total = df.agg(row_count()).scalar()
    return counts.withColumn("pct", F.round(F.col("n") * 100.0 / total, 2))


def mean_by_label(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    return df.where(F.col(label).isNotNull()).groupBy(label).agg(*[F.avg(c).alias(f"mean_{c}") for c in cols])


def distinct_sample(df: DataFrame, value: str, key: str, cols: Sequence[str], n: int) -> DataFrame:
    """One example (smallest key) per distinct value, the first ``n`` by key."""
    first = df.groupBy(value).agg(F.min_by(F.struct(key, *cols), key).alias("_s"))
    return first.select(value, "_s.*").orderBy(key).limit(n)


def prediction_distribution(df: DataFrame, pred: str, score: str | None = None) -> DataFrame:
    extra = [F.avg(score).alias("score_mean"), F.stddev_pop(score).alias("score_std")] if score else []
    total = df.agg(row_count()).scalar()
    return df.groupBy(pred).agg(row_count().alias("n"), *extra).withColumn("pct", F.col("n") * 100.0 / total)


def length_coverage(df: DataFrame, col: str, limits: Sequence[int]) -> DataFrame:
    """Share of rows whose token count stays within each limit."""
    n = X.word_count(X.text(col))
    rows = F.array(*[F.struct(F.lit(int(m)).alias("limit"), F.avg((F.col("n") <= m).cast("int")).alias("share")) for m in limits])
    return df.select(n.alias("n")).agg(rows.alias("_m")).select(F.inline("_m"))


def column_summary(df: DataFrame, clean: str, threshold: int = 5) -> DataFrame:
    """Rows, unknowns, distinct and rare values of a cleaned column."""
    n = F.col("n")
    counts = value_counts(df, clean)
    unknown = F.col(clean).isin("unknown", "")
    return long_metrics(
        counts,
        {
            "rows": F.sum("n"),
            "unknown_rows": F.coalesce(F.sum(F.when(unknown, n)), F.lit(0)),
            "distinct_values": row_count(),
            "rare_values": _count_if(n < threshold),
            "rare_rows": F.coalesce(F.sum(F.when(n < threshold, n)), F.lit(0)),
        },
    )


def before_after(df: DataFrame, raw: str, clean: str, key: str, n: int = 5) -> DataFrame:
    """First raw and cleaned values by key."""
    return df.select(key, F.col(raw).alias("raw"), F.col(clean).alias("clean")).orderBy(key).limit(n)
