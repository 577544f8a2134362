"""Profiles and exploratory statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimforge.functions import text as X
from claimforge.operators import profile as M

from .categories import _T, _topics, r6
from .cleaning import s_pollution
from .registry import CLAIMS, FULL_CLAIMS, SCORED, claims, full_claims, query, s_clean_subject, s_squeeze, s_words, scored, table, TOPICS, topics_view


def s_long(rows: list[tuple[str, str]], source: str, name: str = "metric", value: str = "value") -> str:
    """Unpivot one row of expressions."""
    names = ", ".join(f"'{n}'" for n, _ in rows)
    values = ", ".join(f"CAST({e} AS DOUBLE)" for _, e in rows)
    return f"SELECT unnest([{names}]) AS {name}, unnest([{values}]) AS {value} FROM {source}"


_NULLABLE = ["label", "subject", "speaker_job", "state_info"]


@query(
    "M1_null_profile",
    f"WITH {FULL_CLAIMS} SELECT unnest([{', '.join(repr(c) for c in _NULLABLE)}]) AS \"column\", unnest([{', '.join(f'count(*) FILTER ({c} IS NULL)' for c in _NULLABLE)}]) AS null_count, "
    f"unnest([{', '.join(f'round(count(*) FILTER ({c} IS NULL) * 100.0 / count(*), 6)::DOUBLE' for c in _NULLABLE)}]) AS null_pct FROM full_claims",
)
def m1(spark, sf):
    return M.null_profile(full_claims(spark, sf), _NULLABLE).select("column", "null_count", *r6("null_pct"))


@query(
    "M1_null_share_by",
    f"WITH {CLAIMS} SELECT party_affiliation, count(*) AS rows, count(*) FILTER (label IS NULL) AS null_count, round(count(*) FILTER (label IS NULL) * 100.0 / count(*), 6)::DOUBLE AS null_pct FROM claims GROUP BY 1",
)
def m1_by(spark, sf):
    return M.null_share_by(claims(spark, sf), "label", "party_affiliation").select("party_affiliation", "rows", "null_count", *r6("null_pct"))


@query(
    "M2_class_balance",
    """WITH c AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1), s AS (SELECT sum(n) AS t, max(n) AS hi, min(n) AS lo FROM c)
    SELECT quality, n, round(n * 100.0 / t, 6)::DOUBLE AS pct, round(hi / lo, 6)::DOUBLE AS majority_ratio FROM c, s""",
)
def m2(spark, sf):
    return M.class_balance(table(spark, sf, "labels"), "quality").select("quality", "n", *r6("pct", "majority_ratio"))


@query(
    "M3_cardinality",
    """SELECT 'event_type' AS "column", count(DISTINCT event_type) AS distinct_values, count(DISTINCT lower(trim(event_type))) AS distinct_normalized FROM events
    UNION ALL SELECT 'user_id', count(DISTINCT user_id), count(DISTINCT user_id) FROM events
    UNION ALL SELECT 'props', count(DISTINCT props), count(DISTINCT lower(trim(props))) FROM events""",
)
def m3(spark, sf):
    return M.cardinality(table(spark, sf, "events"), ["event_type", "user_id", "props"], normalized=True)


@query("M3_top_values", "SELECT user_id, count(*) AS n FROM events WHERE regexp_matches(CAST(user_id AS VARCHAR), '1') GROUP BY 1 ORDER BY n DESC, user_id LIMIT 10")
def m3_top(spark, sf):
    return M.top_values(table(spark, sf, "events"), "user_id", 10, "1")


_DESCRIBED = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "M4_describe",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS min, max({c}) AS max, "
        f"round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.9), 6) AS p90, round(quantile_cont({c}, 0.99), 6) AS p99 FROM lineitem"
        for c in _DESCRIBED
    ),
)
def m4(spark, sf):
    d = M.describe(table(spark, sf, "lineitem"), _DESCRIBED, [0.5, 0.9, 0.99])
    return d.select("column", "count", "min", "max", *r6("mean", "std", "p50", "p90", "p99"))


@query(
    "M5_duplicate_report",
    "WITH g AS (SELECT text, count(*) AS n, min(quality) AS lo, max(quality) AS hi FROM documents LEFT JOIN labels USING (doc_id) GROUP BY text) "
    + s_long(
        [("rows", "sum(n)"), ("distinct", "count(*)"), ("extra_copies", "sum(n - 1)"), ("rows_in_duplicate_groups", "coalesce(sum(n) FILTER (n > 1), 0)"), ("conflicting_groups", "count(*) FILTER (lo <> hi)")],
        "g",
    ),
)
def m5(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return M.duplicate_report(d, ["text"], "quality")


@query(
    "M6_top_longest",
    f"SELECT doc_id, CAST(length(text) AS INTEGER) AS text_length, {s_words('text')} AS word_count, substring({s_squeeze('text')}, 1, 120) AS preview FROM documents ORDER BY 2 DESC, 3 DESC, 1 LIMIT 50",
)
def m6(spark, sf):
    return M.top_longest(table(spark, sf, "documents"), "text", "doc_id", 50)


@query(
    "M7_pollution_top",
    f"""WITH {s_pollution(3)} SELECT doc_id, round(pollution_score, 6) AS pollution_score, statement_length, tab_count, newline_count, row_spillover_flag,
      substring(regexp_replace(x, '\\s+', ' ', 'g'), 1, 220) AS statement_preview FROM pollution ORDER BY pollution.pollution_score DESC, statement_length DESC, doc_id LIMIT 10""",
)
def m7(spark, sf):
    top = M.pollution_top(table(spark, sf, "documents"), "text", "doc_id")
    return top.select("doc_id", *r6("pollution_score"), "statement_length", "tab_count", "newline_count", "row_spillover_flag", "statement_preview")


@query(
    "M7_pollution_summary",
    f"WITH {s_pollution(3)} "
    + s_long(
        [("Tabs", "count(*) FILTER (tab_count > 0)"), ("Newlines", "count(*) FILTER (newline_count > 0)"), ("URLs", "count(*) FILTER (url_count > 0)"),
         ("High symbol density", "count(*) FILTER (special_char_ratio > 0.20::DOUBLE)"), ("Row spillover", "count(*) FILTER (row_spillover_flag)")],
        "pollution", "signal", "count",
    ),
)
def m7_summary(spark, sf):
    return M.pollution_summary(table(spark, sf, "documents"), "text")


@query(
    "M8_dataset_summary",
    s_long([("rows", "count(*)"), ("columns", "5"), ("numeric_columns", "3"), ("text_columns", "2"), ("missing_values", "0"), ("duplicate_rows", "count(*) - count(DISTINCT (c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment))")], "customer"),
)
def m8(spark, sf):
    return M.dataset_summary(table(spark, sf, "customer"))


_CUSTOMER = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"), ("c_mktsegment", "string")]


@query("M8_column_inventory", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{t}' AS type, count({c}) AS non_null, count(DISTINCT {c}) AS distinct_values FROM customer" for c, t in _CUSTOMER))
def m8_columns(spark, sf):
    return M.column_inventory(table(spark, sf, "customer"))


@query(
    "M9_id_quality",
    s_long([("rows", "count(*)"), ("missing", "count(*) FILTER (v IS NULL OR v = '')"), ("duplicates", "count(*) - count(DISTINCT v)"), ("distinct", "count(DISTINCT v)")], "(SELECT CAST(conv_id AS VARCHAR) AS v FROM conversations)"),
)
def m9(spark, sf):
    return M.id_quality(table(spark, sf, "conversations"), "conv_id")


@query(
    "M10_cumulative_coverage",
    """WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
    SELECT user_id, n, row_number() OVER w AS rank, CAST(sum(n) OVER w AS BIGINT) AS running, round(sum(n) OVER w / (SELECT count(*) FROM events), 6)::DOUBLE AS coverage FROM c WINDOW w AS (ORDER BY n DESC, user_id ROWS UNBOUNDED PRECEDING)""",
)
def m10(spark, sf):
    return M.cumulative_coverage(table(spark, sf, "events"), "user_id").select("user_id", "n", "rank", "running", *r6("coverage"))


@query(
    "M11_frequency_buckets",
    """WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
    SELECT CASE WHEN n <= 1 THEN '1' WHEN n <= 2 THEN '2' WHEN n <= 5 THEN '3-4' WHEN n <= 10 THEN '5-9' WHEN n <= 50 THEN '10-49' WHEN n <= 100 THEN '50-99' ELSE '100+' END AS band,
      CAST(sum(n) AS BIGINT) AS rows, count(*) AS distinct_values FROM c GROUP BY 1""",
)
def m11(spark, sf):
    return M.frequency_buckets(table(spark, sf, "orders"), "o_custkey").drop("band_order")


@query(
    "M12_crosstab",
    """WITH x AS (SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'All' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN grouping(o_orderpriority) = 1 THEN 'All' ELSE o_orderpriority END AS o_orderpriority, count(*) AS n
      FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)), m AS (SELECT o_orderstatus, n AS row_total FROM x WHERE o_orderpriority = 'All')
    SELECT o_orderstatus, o_orderpriority, n, row_total, round(n * 100.0 / row_total, 6)::DOUBLE AS row_pct FROM x JOIN m USING (o_orderstatus)""",
)
def m12(spark, sf):
    return M.crosstab(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority").withColumn("row_pct", F.round("row_pct", 6))


@query(
    "M12_crosstab_wide",
    "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS \"o_orderstatus_F\", count(*) FILTER (o_orderstatus = 'O') AS \"o_orderstatus_O\", count(*) FILTER (o_orderstatus = 'P') AS \"o_orderstatus_P\", count(*) AS total FROM orders GROUP BY 1",
)
def m12_wide(spark, sf):
    return M.crosstab_wide(table(spark, sf, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


def s_chi2(source: str, a: str, b: str, yates: bool) -> str:
    gap = "greatest(abs(coalesce(o, 0) - e) - 0.5, 0)" if yates else "(coalesce(o, 0) - e)"
    return f"""WITH r AS (SELECT {a} AS a, count(*) AS r FROM {source} GROUP BY 1), c AS (SELECT {b} AS b, count(*) AS c FROM {source} GROUP BY 1), x AS (SELECT {a} AS a, {b} AS b, count(*) AS o FROM {source} GROUP BY ALL),
      g AS (SELECT a, b, r::DOUBLE * c / (SELECT count(*) FROM {source}) AS e FROM r, c)
    SELECT round(sum({gap} * {gap} / e), 6)::DOUBLE AS chi2, ((SELECT count(*) FROM r) - 1) * ((SELECT count(*) FROM c) - 1) AS dof FROM g LEFT JOIN x USING (a, b)"""


@query("M13_chi_square_independence", s_chi2("orders", "o_orderstatus", "o_orderpriority", False))
def m13(spark, sf):
    return M.chi_square_independence(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority").select(*r6("chi2"), "dof")


@query("M13_chi_square_two_by_two", s_chi2("labels", "quality", "toxic", True))
def m13_two(spark, sf):
    return M.chi_square_independence(table(spark, sf, "labels"), "quality", "toxic").select(*r6("chi2"), "dof")


# Eight degrees of freedom: the tail is a sum of four terms.
@query(
    "M13_chi_square_p_value",
    f"""SELECT round(exp(-x) * (1 + x + x * x / 2 + x * x * x / 6), 9) AS p_value, CAST(dof AS INTEGER) AS dof, round(2 * x, 6) AS statistic
    FROM (SELECT chi2 / 2 AS x, dof FROM ({s_chi2("orders", "o_orderstatus", "o_orderpriority", False).replace("round(sum(", "(sum(").replace(", 6)::DOUBLE AS chi2", ")::DOUBLE AS chi2")}))""",
)
def m13_p(spark, sf):
    found = M.chi_square_p_value(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")
    return found.select(F.round("p_value", 9).alias("p_value"), "dof", F.round("statistic", 6).alias("statistic"))


@query(
    "M14_category_profile",
    "WITH s AS (SELECT p_name AS v, count(*) AS n, count(*) FILTER (p_name LIKE '%ring%') AS f FROM part GROUP BY 1), q AS (SELECT quantile_cont(length(p_name), 0.5) AS ml, quantile_cont("
    + s_words("p_name")
    + ", 0.5) AS mt FROM part) SELECT metric, round(value, 6) AS value FROM ("
    + s_long(
        [("rows", "sum(n)"), ("missing values", "0"), ("blank values", "0"), ("distinct values", "count(*)"), ("values occurring once", "count(*) FILTER (n = 1)"),
         ("values occurring 2-4 times", "count(*) FILTER (n BETWEEN 2 AND 4)"), ("values occurring 5-9 times", "count(*) FILTER (n BETWEEN 5 AND 9)"), ("values occurring 10+ times", "count(*) FILTER (n >= 10)"),
         ("pct rare values", "count(*) FILTER (n < 30) * 100.0 / count(*)"), ("pct rows in rare values", "coalesce(sum(n) FILTER (n < 30), 0) * 100.0 / sum(n)"), ("pct ring", "sum(f) * 100.0 / sum(n)"),
         ("median length", "max(ml)"), ("median token count", "max(mt)")],
        "s, q",
    )
    + ")",
)
def m14(spark, sf):
    p = table(spark, sf, "part")
    return M.category_profile(p, "p_name", "p_name", {"ring": F.col("p_name").contains("ring")}, 30).select("metric", *r6("value"))


@query("M15_topic_count_distribution", f"WITH {_T} SELECT CAST(len(t) AS INTEGER) AS topic_count, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM ta), 2)::DOUBLE AS pct FROM ta GROUP BY 1")
def m15(spark, sf):
    return M.topic_count_distribution(_topics(spark, sf), "t")


@query(
    "M16_mean_by_label",
    f"WITH {SCORED} SELECT label, round(avg(length(statement)), 6) AS mean_chars, round(avg({s_words('statement')}), 6) AS mean_words FROM scored GROUP BY label",
)
def m16(spark, sf):
    d = scored(spark, sf).select("label", F.length("statement").alias("chars"), X.word_count(F.col("statement")).alias("words"))
    return M.mean_by_label(d, ["chars", "words"], "label").select("label", *r6("mean_chars", "mean_words"))


@query("M17_distinct_sample", "SELECT p_name, p_partkey, p_brand, p_type FROM part QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1 ORDER BY p_partkey LIMIT 40")
def m17(spark, sf):
    return M.distinct_sample(table(spark, sf, "part"), "p_name", "p_partkey", ["p_brand", "p_type"], 40)


@query(
    "M18_prediction_distribution",
    f"WITH {SCORED} SELECT CAST(s1 >= 0.5::DOUBLE AS INTEGER) AS pred, count(*) AS n, round(avg(s1), 6) AS score_mean, round(stddev_pop(s1), 6) AS score_std, round(count(*) * 100.0 / (SELECT count(*) FROM scored), 6)::DOUBLE AS pct FROM scored GROUP BY 1",
)
def m18(spark, sf):
    s = scored(spark, sf).withColumn("pred", (F.col("s1") >= 0.5).cast("int"))
    return M.prediction_distribution(s, "pred", "s1").select("pred", "n", *r6("score_mean", "score_std", "pct"))


@query(
    "M19_length_coverage",
    f'WITH w AS (SELECT {s_words("text")} AS n FROM documents) SELECT CAST(m AS INTEGER) AS "limit", round(avg(CASE WHEN n <= m THEN 1.0 ELSE 0 END), 6)::DOUBLE AS share FROM w, (SELECT unnest([64, 128, 256, 512]) AS m) GROUP BY m',
)
def m19(spark, sf):
    return M.length_coverage(table(spark, sf, "documents"), "text", [64, 128, 256, 512]).select("limit", *r6("share"))


@query(
    "M20_column_summary",
    f"WITH {TOPICS}, c AS (SELECT {s_clean_subject('subject')} AS v FROM topics), g AS (SELECT v, count(*) AS n FROM c GROUP BY 1) "
    + s_long([("rows", "sum(n)"), ("unknown_rows", "coalesce(sum(n) FILTER (v IN ('unknown', '')), 0)"), ("distinct_values", "count(*)"), ("rare_values", "count(*) FILTER (n < 2)"), ("rare_rows", "coalesce(sum(n) FILTER (n < 2), 0)")], "g"),
)
def m20(spark, sf):
    return M.column_summary(topics_view(spark, sf).select(X.clean_subject("subject").alias("v")), "v", 2)


@query("M20_before_after", f"WITH {TOPICS} SELECT p_partkey, subject AS raw, {s_clean_subject('subject')} AS clean FROM topics ORDER BY p_partkey LIMIT 10")
def m20_sample(spark, sf):
    return M.before_after(topics_view(spark, sf).withColumn("c", X.clean_subject("subject")), "subject", "c", "p_partkey", 10)
