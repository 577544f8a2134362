"""Frequencies, grouping, topics, target encoding, scaling and encoders."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimforge.functions import text as X
from claimforge.functions import words as W
from claimforge.operators import category as CAT
from claimforge.operators import encode as E
from claimforge.operators import scale as SC
from claimforge.operators import target as G
from claimforge.operators import textstats as S
from claimforge.operators import topics as TOP

from .registry import CLAIMS, SCORED, TOPICS, claims, query, s_count, s_topics, s_words, scored, table, topics_view


def r6(*cols):
    return [F.round(c, 6).alias(c) for c in cols]


@query(
    "D1_frequency_encode",
    "SELECT event_id, count(*) OVER (PARTITION BY user_id) AS user_id_frequency, round(count(*) OVER (PARTITION BY user_id) / (SELECT count(*) FROM events), 6) AS user_id_frequency_pct FROM events",
)
def d1(spark, sf):
    e = CAT.frequency_encode(table(spark, sf, "events").select("event_id", "user_id"), "user_id")
    return e.select("event_id", "user_id_frequency", *r6("user_id_frequency_pct"))


_RARE = "(SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_name) AS n FROM part)"


@query("D2_is_rare", f"SELECT p_partkey, CAST(n < 30 AS INTEGER) AS p_name_is_rare FROM {_RARE}")
def d2(spark, sf):
    p = CAT.frequency_encode(table(spark, sf, "part"), "p_name")
    return CAT.is_rare(p, "p_name_frequency", 30, "p_name_is_rare").select("p_partkey", "p_name_is_rare")


@query("D3_group_rare", f"SELECT p_partkey, CASE WHEN n < 30 THEN 'other' ELSE p_name END AS p_name_grouped FROM {_RARE}")
def d3(spark, sf):
    return CAT.group_rare(table(spark, sf, "part"), "p_name", 30).select("p_partkey", "p_name_grouped")


def train_test(df, key):
    """Train: keys not divisible by 5."""
    return df.where(F.col(key) % 5 != 0), df.where(F.col(key) % 5 == 0)


def both(a, b):
    return a.withColumn("part", F.lit("train")).unionByName(b.withColumn("part", F.lit("test")))


_PART = "CASE WHEN p_partkey % 5 <> 0 THEN 'train' ELSE 'test' END AS part"


@query(
    "D4_keep_top_n",
    f"""WITH top AS (SELECT lower(p_name) AS v FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20)
    SELECT p_partkey, {_PART}, CASE WHEN lower(p_name) IN (SELECT v FROM top) THEN lower(p_name) ELSE 'other' END AS p_name_top FROM part""",
)
def d4(spark, sf):
    a, b = CAT.keep_top_n(*train_test(table(spark, sf, "part"), "p_partkey"), "p_name", 20)
    return both(a, b).select("p_partkey", "part", "p_name_top")


@query("D5_keep_allow_list", "SELECT o_orderkey, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN o_orderpriority ELSE 'other' END AS o_orderpriority_top FROM orders")
def d5(spark, sf):
    return CAT.keep_allow_list(table(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"]).select("o_orderkey", "o_orderpriority_top")


@query(
    "D6_count_encode",
    f"""WITH c AS (SELECT p_name || p_size AS v, count(*) AS n FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1)
    SELECT p_partkey, {_PART}, coalesce(n, 0) AS n, round(ln(1 + coalesce(n, 0)), 6) AS log_n FROM part LEFT JOIN c ON v = p_name || p_size""",
)
def d6(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat("p_name", "p_size").alias("v"))
    a, b = train_test(p, "p_partkey")
    a, b = CAT.count_encode(a, b, "v", out="n")
    a, b = CAT.count_encode(a, b, "v", log1p=True, out="log_n")
    return both(a, b).select("p_partkey", "part", "n", *r6("log_n"))


@query(
    "D7_min_count_group",
    f"""WITH c AS (SELECT p_brand AS v FROM part WHERE p_partkey % 5 <> 0 GROUP BY 1 HAVING count(*) >= 64)
    SELECT p_partkey, {_PART}, coalesce(v, 'other') AS p_brand_grouped FROM part LEFT JOIN c ON v = p_brand""",
)
def d7(spark, sf):
    a, b = CAT.min_count_group(*train_test(table(spark, sf, "part"), "p_partkey"), "p_brand", 64)
    return both(a, b).select("p_partkey", "part", "p_brand_grouped")


@query("D8_token_frequencies", "SELECT token, count(*) AS freq FROM (SELECT unnest(regexp_extract_all(lower(text), '\\S+')) AS token FROM documents) GROUP BY token")
def d8(spark, sf):
    return CAT.token_frequencies(table(spark, sf, "documents").select(X.words(F.lower("text")).alias("tokens")), "tokens")


@query(
    "D9_rare_threshold_impact",
    """WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), t AS (SELECT unnest([5, 50, 60, 70, 90]) AS threshold), a AS (SELECT count(*) AS total FROM events)
    SELECT CAST(threshold AS INTEGER) AS threshold, count(*) FILTER (n >= threshold) AS kept_values, CAST(total - coalesce(sum(n) FILTER (n >= threshold), 0) AS BIGINT) AS grouped_rows,
      round((total - coalesce(sum(n) FILTER (n >= threshold), 0)) * 100.0 / total, 6)::DOUBLE AS grouped_pct FROM c, t, a GROUP BY threshold, total""",
)
def d9(spark, sf):
    out = CAT.rare_threshold_impact(table(spark, sf, "events"), "user_id", [5, 50, 60, 70, 90])
    return out.select("threshold", "kept_values", "grouped_rows", *r6("grouped_pct"))


# --- topics -----------------------------------------------------------------

_T = f"""{TOPICS}, tv AS (SELECT p_partkey, lower(subject) || CASE p_partkey % 3 WHEN 0 THEN '; extra' ELSE '' END AS s FROM topics),
  ta AS (SELECT p_partkey, s, {s_topics('s')} AS t FROM tv)"""


def _topics(spark, sf):
    tail = F.when(F.col("p_partkey") % 3 == 0, "; extra").otherwise("")
    s = topics_view(spark, sf).select("p_partkey", F.concat(F.lower("subject"), tail).alias("s"))
    return TOP.split_topics(s, "s", "t")


@query("E1_split_topics", f"WITH {_T} SELECT p_partkey, array_to_string(t, '|') AS t FROM ta")
def e1(spark, sf):
    return _topics(spark, sf).select("p_partkey", F.array_join("t", "|").alias("t"))


@query(
    "E2_topic_shape",
    f"WITH {_T} SELECT p_partkey, CAST(len(t) AS INTEGER) AS s_topic_count, CAST(len(t) > 1 AS INTEGER) AS s_has_multiple_topics, CAST(length(s) AS INTEGER) AS s_length, {s_words('s')} AS s_token_count FROM ta",
)
def e2(spark, sf):
    return TOP.topic_shape(_topics(spark, sf), "t", "s", "s").drop("t", "s")


@query("E3_topic_counts", f"WITH {_T} SELECT topic, count(*) AS n FROM (SELECT unnest(t) AS topic FROM ta) GROUP BY topic")
def e3(spark, sf):
    return TOP.topic_counts(_topics(spark, sf), "t")


_E4 = f"""WITH {_T}, x AS (SELECT p_partkey, unnest(t) AS topic, generate_subscripts(t, 1) AS pos FROM ta), g AS (SELECT topic, count(*) AS n FROM x GROUP BY topic),
  mf AS (SELECT p_partkey, topic FROM x JOIN g USING (topic) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY n DESC, length(topic) DESC, pos) = 1),
  lo AS (SELECT p_partkey, topic FROM x QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY length(topic) DESC, pos) = 1)"""


@query(
    "E4_primary_topic",
    f"""{_E4} SELECT ta.p_partkey, coalesce(t[1], 'unknown') AS first, coalesce(lo.topic, 'unknown') AS longest, coalesce(mf.topic, 'unknown') AS most_frequent,
      CASE WHEN len(t) = 0 THEN 'unknown' ELSE 'multi-topic' END AS multi, CASE WHEN len(t) > 3 THEN 'multi-topic' ELSE coalesce(t[1], 'unknown') END AS capped
    FROM ta LEFT JOIN lo USING (p_partkey) LEFT JOIN mf USING (p_partkey)""",
)
def e4(spark, sf):
    d = _topics(spark, sf)
    for s in TOP.STRATEGIES:
        d = TOP.primary_topic(d, "t", s, out=s)
    return TOP.primary_topic(d, "t", "first", 3, out="capped").drop("t", "s")


@query(
    "E5_primary_features",
    f"""WITH {_T}, p AS (SELECT p_partkey, t[1] AS prim, count(*) OVER (PARTITION BY t[1]) AS n FROM ta)
    SELECT p_partkey, n AS s_frequency, CAST(n < 30 AS INTEGER) AS s_is_rare, CASE WHEN n < 30 THEN 'other' ELSE prim END AS prim_grouped FROM p""",
)
def e5(spark, sf):
    d = TOP.primary_topic(_topics(spark, sf), "t", out="prim")
    return TOP.primary_features(d, "prim", "s", 30).select("p_partkey", "s_frequency", "s_is_rare", "prim_grouped")


_TYPES = ["economy", "large", "medium", "promo", "small", "standard"]


@query(
    "E6_multi_label_binarize",
    f"WITH {_T} SELECT p_partkey, {_PART}, " + ", ".join(f"CAST(list_contains(t, '{v}') AS INTEGER) AS subject_{v}" for v in [*_TYPES, "extra"]) + " FROM ta",
)
def e6(spark, sf):
    d = _topics(spark, sf).withColumn("t", F.filter("t", lambda x: x.isin([*_TYPES, "extra"])))
    a, b = TOP.multi_label_binarize(*train_test(d, "p_partkey"), "t")
    return both(a, b).drop("t", "s")


@query(
    "E6_topic_indicators_long",
    f"""WITH {_T}, x AS (SELECT DISTINCT p_partkey, unnest(t) AS topic FROM ta), seen AS (SELECT DISTINCT topic FROM x WHERE p_partkey % 5 <> 0)
    SELECT p_partkey, {_PART}, topic, 1 AS value FROM x WHERE topic IN (SELECT topic FROM seen)""",
)
def e6_long(spark, sf):
    return both(*TOP.topic_indicators_long(*train_test(_topics(spark, sf), "p_partkey"), "p_partkey", "t"))


# --- target -----------------------------------------------------------------

_G1 = f"""SELECT doc_id, source, {s_words('text')} AS wc, {s_count('text', "[.,!?;:" + chr(34) + "''" + "\\-()\\[\\]{}]")} / greatest(length(text), 1) AS pd, {s_count('text', '[0-9]')} / greatest(length(text), 1) AS dr FROM documents"""


@query(
    "G1_group_mean_feature",
    f"""SELECT doc_id, round(avg(wc) OVER w, 6) AS avg_len, round(avg(pd) OVER w, 6) AS avg_punct, round(avg(dr) OVER w, 6) AS avg_digits
    FROM ({_G1}) WINDOW w AS (PARTITION BY source)""",
)
def g1(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", "source", X.word_count(X.text("text")).alias("wc"), S.punct_density("text").alias("pd"), S.digit_ratio("text").alias("dr")
    )
    d = G.group_mean_features(d, "source", {"avg_len": "wc", "avg_punct": "pd", "avg_digits": "dr"})
    return d.select("doc_id", *r6("avg_len", "avg_punct", "avg_digits"))


@query(
    "G2_group_label_rate",
    f"WITH {CLAIMS} SELECT id, round(coalesce(avg(label) OVER (PARTITION BY speaker), 0.5), 6) AS rate FROM claims",
)
def g2(spark, sf):
    return G.group_label_rate(claims(spark, sf), "speaker", "label", "rate").select("id", *r6("rate"))


@query(
    "G3_oof_rate",
    f"""WITH {SCORED} SELECT a.id, a.fold, round(coalesce((SELECT avg(b.label) FROM scored b WHERE b.speaker = a.speaker AND b.fold <> a.fold), 0.5), 6) AS rate FROM scored a""",
)
def g3(spark, sf):
    return G.oof_rate(scored(spark, sf), "speaker", "label", "fold", "rate").select("id", "fold", *r6("rate"))


@query(
    "G3_fold_rate",
    f"""WITH {SCORED}, r AS (SELECT party_affiliation, avg(label) AS rate FROM scored WHERE fold <> 2 GROUP BY 1)
    SELECT id, CASE WHEN fold <> 2 THEN 'train' ELSE 'test' END AS part, round(coalesce(rate, 0.5), 6) AS rate FROM scored LEFT JOIN r USING (party_affiliation)""",
)
def g3_fold(spark, sf):
    parts = G.fold_rate(scored(spark, sf), "party_affiliation", "label", "fold", 2, "rate")
    return both(*parts).select("id", "part", *r6("rate"))


@query(
    "G4_rate_maps",
    f"""WITH {SCORED}, r AS (SELECT speaker, avg(label) AS rate FROM scored WHERE fold <> 0 GROUP BY 1)
    SELECT id, round(coalesce(rate, 0.5), 6) AS fe_speaker, 0.5::DOUBLE AS fe_absent FROM claims LEFT JOIN r USING (speaker)""",
)
def g4(spark, sf):
    train = scored(spark, sf).where("fold <> 0")
    maps = G.fit_rate_maps(train, {"fe_speaker": ["speaker_grouped", "speaker"], "fe_absent": ["party_affiliation"]}, "label")
    rows = claims(spark, sf).drop("party_affiliation")
    return G.apply_rate_maps(rows, maps).select("id", *r6("fe_speaker"), "fe_absent")


@query(
    "G5_support_meta_vector",
    f"""WITH {SCORED}, tr AS (SELECT * FROM scored WHERE fold <> 0), g AS (SELECT avg(CASE WHEN label = 0 THEN 1.0 ELSE 0 END) AS r FROM tr),
      s AS (SELECT speaker, avg(CASE WHEN label = 0 THEN 1.0 ELSE 0 END) AS r FROM tr GROUP BY 1 HAVING count(*) >= 16),
      p AS (SELECT party_affiliation, avg(CASE WHEN label = 0 THEN 1.0 ELSE 0 END) AS r FROM tr GROUP BY 1 HAVING count(*) >= 16)
    SELECT id, round(coalesce(s.r, g.r), 6)::DOUBLE AS m_speaker, round(coalesce(p.r, g.r), 6)::DOUBLE AS m_party, 0.0::DOUBLE AS m_major
    FROM claims LEFT JOIN s USING (speaker) LEFT JOIN p USING (party_affiliation), g""",
)
def g5(spark, sf):
    train = scored(spark, sf).where("fold <> 0").select("label", "speaker", "party_affiliation")
    out = G.support_meta_vector(train, claims(spark, sf), "label", "speaker", "speaker", "party_affiliation", 16)
    m = F.col("meta")
    return out.select("id", F.round(m[0], 6).alias("m_speaker"), F.round(m[2], 6).alias("m_party"), m[3].alias("m_major"))


@query(
    "G6_smoothed_oof_encode",
    f"""WITH {SCORED}, g AS (SELECT avg(label) AS m FROM scored), f AS (SELECT a.fold, b.speaker, sum(b.label) AS s, count(*) AS n FROM (SELECT DISTINCT fold FROM scored) a JOIN scored b ON a.fold <> b.fold GROUP BY 1, 2),
      w AS (SELECT speaker, sum(label) AS s, count(*) AS n FROM scored GROUP BY 1)
    SELECT id, 'train' AS part, round(coalesce((s + m * 20) / (n + 20), m), 6) AS te FROM scored LEFT JOIN f USING (fold, speaker), g
    UNION ALL SELECT id, 'test', round(coalesce((s + m * 20) / (n + 20), m), 6) FROM claims LEFT JOIN w USING (speaker), g WHERE label IS NULL""",
)
def g6(spark, sf):
    test = claims(spark, sf).where("label is null").select("id", "speaker")
    a, b = G.smoothed_oof_encode(scored(spark, sf), test, "speaker", "label", "fold", out="te")
    return both(a.select("id", "te"), b.select("id", "te")).select("id", "part", *r6("te"))


@query(
    "G7_label_stats",
    f"""WITH {CLAIMS} SELECT speaker, count(*) AS total, count(*) FILTER (label = 1) AS false_count, count(*) FILTER (label = 0) AS true_count,
      round(count(*) FILTER (label = 1) / count(*), 6) AS false_rate, round(count(*) FILTER (label = 0) / count(*), 6) AS true_rate
    FROM claims WHERE label IS NOT NULL GROUP BY speaker HAVING count(*) >= 10 ORDER BY total DESC, speaker LIMIT 15""",
)
def g7(spark, sf):
    s = G.label_stats(claims(spark, sf), "speaker", "label", 10, 15)
    return s.select("speaker", "total", "false_count", "true_count", *r6("false_rate", "true_rate"))


@query(
    "T_weight_of_evidence",
    f"""WITH {SCORED}, a AS (SELECT sum(label) AS p, count(*) AS n FROM scored), k AS (SELECT speaker, ln(((sum(label) + 0.5) / (p + 1)) / ((count(*) - sum(label) + 0.5) / (n - p + 1))) AS w FROM scored, a GROUP BY speaker, p, n)
    SELECT id, round(coalesce(w, 0), 6)::DOUBLE AS woe FROM claims LEFT JOIN k USING (speaker)""",
)
def t_woe(spark, sf):
    return G.woe_encode(scored(spark, sf), claims(spark, sf), "speaker", "label", "woe").select("id", *r6("woe"))


# --- scaling ----------------------------------------------------------------

_KEYS = "l_orderkey, l_partkey, l_suppkey, l_linenumber"


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query(
    "H1_standardize",
    f"""WITH s AS (SELECT avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq, avg(l_extendedprice) AS mp, stddev_samp(l_extendedprice) AS sp FROM lineitem)
    SELECT {_KEYS}, round((l_quantity - mq) / sq, 6) AS l_quantity, round((l_extendedprice - mp) / sp, 6) AS l_extendedprice FROM lineitem, s""",
)
def h1(spark, sf):
    d = SC.scale(_lines(spark, sf), ["l_quantity", "l_extendedprice"], "standardize")
    return d.withColumns({c: F.round(c, 6) for c in ("l_quantity", "l_extendedprice")})


@query(
    "H2_normalize",
    f"""WITH s AS (SELECT min(l_quantity) AS mq, max(l_quantity) - min(l_quantity) AS sq, min(l_extendedprice) AS mp, max(l_extendedprice) - min(l_extendedprice) AS sp FROM lineitem)
    SELECT {_KEYS}, round((l_quantity - mq) / sq, 6) AS l_quantity, round((l_extendedprice - mp) / sp, 6) AS l_extendedprice FROM lineitem, s""",
)
def h2(spark, sf):
    d = SC.scale(_lines(spark, sf), ["l_quantity", "l_extendedprice"], "normalize")
    return d.withColumns({c: F.round(c, 6) for c in ("l_quantity", "l_extendedprice")})


@query(
    "H3_standard_scaler",
    """WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq FROM lineitem WHERE l_orderkey % 5 <> 0)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_orderkey % 5 <> 0 THEN 'train' ELSE 'test' END AS part, round((l_quantity - mq) / sq, 6) AS l_quantity FROM lineitem, s""",
)
def h3(spark, sf):
    a, b = SC.standard_scaler(*train_test(_lines(spark, sf).drop("l_extendedprice"), "l_orderkey"), ["l_quantity"])
    return both(a, b).withColumn("l_quantity", F.round("l_quantity", 6))


# --- encoders ---------------------------------------------------------------


@query(
    "J1_ordinal_encode",
    f"""WITH v AS (SELECT w, CAST(row_number() OVER (ORDER BY w) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT p_name || p_size AS w FROM part WHERE p_partkey % 5 <> 0))
    SELECT p_partkey, {_PART}, coalesce(code, -1) AS w_code FROM part LEFT JOIN v ON w = p_name || p_size""",
)
def j1(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.concat("p_name", "p_size").alias("w"))
    return both(*E.ordinal_encode(*train_test(p, "p_partkey"), ["w"])).drop("w")


@query(
    "J2_one_hot",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN 'train' ELSE 'test' END AS part, "
    + ", ".join(f"CAST(s = '{v}' AS INTEGER) AS s_{v}" for v in "FOP")
    + " FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 35 = 0 THEN 'new' ELSE o_orderstatus END AS s FROM orders)",
)
def j2(spark, sf):
    s = F.when(F.col("o_orderkey") % 35 == 0, "new").otherwise(F.col("o_orderstatus"))
    o = table(spark, sf, "orders").select("o_orderkey", s.alias("s"))
    return both(*E.one_hot(*train_test(o, "o_orderkey"), ["s"])).drop("s")


@query(
    "J2_one_hot_sparse_counts",
    "SELECT p_brand, CASE WHEN p_partkey % 5 <> 0 THEN 'train' ELSE 'test' END AS part, count(*) AS n, CAST(1 AS DOUBLE) AS mean_hot FROM part GROUP BY ALL",
)
def j2_sparse(spark, sf):
    from pyspark.ml.functions import vector_to_array

    rows = both(*E.one_hot_sparse(*train_test(table(spark, sf, "part"), "p_partkey"), ["p_brand"]))
    hot = F.aggregate(vector_to_array("p_brand_vec"), F.lit(0.0), lambda a, x: a + x)
    return rows.groupBy("p_brand", "part").agg(F.count(F.lit(1)).alias("n"), F.avg(hot).alias("mean_hot"))


@query(
    "J4_align_schema",
    f"WITH {CLAIMS} SELECT id, CAST(0 AS DOUBLE) AS missing_one, coalesce(CAST(label AS DOUBLE), 0) AS label FROM claims",
)
def j4(spark, sf):
    return E.align_schema(claims(spark, sf), ["missing_one", "label"], keep=["id"])


@query("J5_restore_rows", f"WITH {CLAIMS} SELECT id, coalesce(label, -1) AS label FROM claims")
def j5(spark, sf):
    c = claims(spark, sf)
    return E.restore_rows(c.where("label is not null").select("id", "label"), c, "id", {"label": -1})


_HELD = "text || CASE doc_id % 4 WHEN 0 THEN ' State Senator' WHEN 1 THEN ' a Judge, and a doctor' WHEN 2 THEN ' staffer' ELSE '' END"


@query(
    "T_keyword_buckets",
    "SELECT doc_id, CASE "
    + " ".join(f"WHEN regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])(?:{'|'.join(k)})($|[^\\p{{L}}\\p{{N}}_])') THEN '{name}'" for name, k in W.OCCUPATIONS)
    + f" ELSE 'other' END AS bucket FROM (SELECT doc_id, lower({_HELD}) AS t FROM documents)",
)
def t_buckets(spark, sf):
    tail = F.when(F.col("doc_id") % 4 == 0, " State Senator").when(F.col("doc_id") % 4 == 1, " a Judge, and a doctor").when(F.col("doc_id") % 4 == 2, " staffer").otherwise("")
    d = table(spark, sf, "documents").select("doc_id", F.concat("text", tail).alias("t"))
    return CAT.keyword_buckets(d, "t", out="bucket").drop("t")


@query(
    "T_group_class_weights",
    f"""WITH {SCORED}, c AS (SELECT party_affiliation, label, count(*) AS n FROM scored GROUP BY ALL), g AS (SELECT party_affiliation, sum(n) AS s, count(*) AS k FROM c GROUP BY 1)
    SELECT id, round((s / (k * n))::DOUBLE, 6) AS weight FROM scored JOIN c USING (party_affiliation, label) JOIN g USING (party_affiliation)""",
)
def t_weights(spark, sf):
    from claimforge.operators.splits import add_group_class_weights

    return add_group_class_weights(scored(spark, sf), "party_affiliation", "label").select("id", *r6("weight"))
