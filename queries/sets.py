"""Splits, sampling, row sets and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimforge.operators import joins as L
from claimforge.operators import splits as K

from .categories import both, r6, train_test
from .registry import CLAIMS, SCORED, claims, query, scored, table
from .cleaning import s_md5_mod

_RANK = "row_number() OVER (PARTITION BY label ORDER BY md5(id || '42'), id) AS rk, count(*) OVER (PARTITION BY label) AS n"


@query("K1_stratified_holdout", f"WITH {SCORED} SELECT id, label, CAST(rk <= ceil(round(n * 0.2::DOUBLE, 9)) AS INTEGER) AS is_holdout FROM (SELECT *, {_RANK} FROM scored)")
def k1(spark, sf):
    return K.stratified_holdout(scored(spark, sf), "label", "id").select("id", "label", "is_holdout")


@query("K2_stratified_folds", f"WITH {SCORED} SELECT id, label, CAST((rk - 1) % 5 AS INTEGER) AS fold FROM (SELECT * EXCLUDE (fold), {_RANK} FROM scored)")
def k2(spark, sf):
    return K.stratified_folds(scored(spark, sf).drop("fold"), "label", "id").select("id", "label", "fold")


@query(
    "K2_stratified_folds_orders",
    "SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey || '7'), o_orderkey) - 1) % 10 AS INTEGER) AS fold FROM orders",
)
def k2_orders(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return K.stratified_folds(o, "o_orderstatus", "o_orderkey", 10, 7).select("o_orderkey", "fold")


@query("T_grouped_folds", f"SELECT o_orderkey, {s_md5_mod('CAST(o_custkey AS VARCHAR)', 5)} AS fold FROM orders")
def t_grouped(spark, sf):
    return K.grouped_folds(table(spark, sf, "orders"), "o_custkey").select("o_orderkey", "fold")


@query(
    "K3_three_way_split",
    f"""WITH {SCORED}, r AS (SELECT *, {_RANK} FROM scored), h AS (SELECT *, ceil(round(n * 0.2::DOUBLE, 9)) AS h FROM r)
    SELECT id, CASE WHEN rk <= h THEN 'holdout' WHEN rk <= h + ceil(round((n - h) * 0.25::DOUBLE, 9)) THEN 'validation' ELSE 'train' END AS part FROM h""",
)
def k3(spark, sf):
    return K.three_way_split(scored(spark, sf), "label", "id", 0.2, 0.25).select("id", "part")


@query("K4_bucket_split", f"SELECT doc_id, id_bucket, CASE WHEN id_bucket >= 20 THEN 'train' ELSE 'test' END AS part FROM (SELECT doc_id, {s_md5_mod('CAST(doc_id AS VARCHAR)', 100)} AS id_bucket FROM documents)")
def k4(spark, sf):
    return both(*K.bucket_split(table(spark, sf, "documents"), "doc_id")).select("doc_id", "id_bucket", "part")


@query("K5_oversample_minority", f"WITH {SCORED} SELECT CAST(y AS INTEGER) AS label, (SELECT count(*) FROM scored WHERE label = 1) AS n FROM (SELECT unnest([0, 1]) AS y)")
def k5(spark, sf):
    return K.oversample_minority(scored(spark, sf), "label", "id").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(
    "K6_class_weights",
    """SELECT quality, count(*) AS n, (SELECT count(*) FROM labels) / (2 * count(*)) AS weight, (SELECT count(*) FILTER (quality = 0) / count(*) FILTER (quality = 1) FROM labels) AS scale_pos_weight
    FROM labels GROUP BY quality""",
)
def k6(spark, sf):
    return K.class_weights(table(spark, sf, "labels"), "quality")


@query(
    "K7_union_pseudo_labels",
    f"""WITH {SCORED} SELECT id, label, 1.0::DOUBLE AS weight, fold FROM scored UNION ALL
    SELECT id, CAST(id % 2 AS INTEGER), 0.7::DOUBLE, -1 FROM claims WHERE label IS NULL""",
)
def k7(spark, sf):
    train = scored(spark, sf).select("id", "label", "fold")
    test = claims(spark, sf).where("label is null").select("id", "label")
    scores = test.select("id", (F.col("id") % 2).cast("int").alias("label"))
    return K.union_pseudo_labels(train, test, scores, "id", "label").select("id", "label", "weight", "fold")


@query("K8_drop_duplicate_rows", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text, lang")
def k8(spark, sf):
    return K.drop_duplicate_rows(table(spark, sf, "documents"), ["text", "lang"], "doc_id").select("doc_id")


@query("L1_lookup_join", "SELECT o_orderkey, coalesce(c_mktsegment, 'none') AS c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_custkey % 3 <> 0")
def l1(spark, sf):
    t = table(spark, sf, "customer").where("c_custkey % 3 <> 0").select("c_custkey", "c_mktsegment")
    return L.lookup_join(table(spark, sf, "orders"), t, "o_custkey", "c_custkey", {"c_mktsegment": "none"}).select("o_orderkey", "c_mktsegment")


@query("L2_score_join", f"WITH {SCORED} SELECT id, label, s1, s2 FROM scored WHERE id % 3 <> 0 AND id % 7 <> 0")
def l2(spark, sf):
    s = scored(spark, sf)
    return L.score_join(s.where("id % 3 <> 0").select("id", "label", "s1"), s.where("id % 7 <> 0").select("id", "label", "s2"))


@query("L3_fill_template", f"WITH {CLAIMS} SELECT id, coalesce(label, 1) AS label FROM claims")
def l3(spark, sf):
    c = claims(spark, sf)
    return L.fill_template(c, c.where("label is not null"))


@query("L4_attach_oof", f"WITH {SCORED} SELECT id, 'train' AS part, s1 AS m_proba_1 FROM scored UNION ALL SELECT id, 'test', CAST(id % 10 AS DOUBLE) / 10 FROM claims WHERE label IS NULL")
def l4(spark, sf):
    s, c = scored(spark, sf), claims(spark, sf).where("label is null")
    test_scores = c.select("id", ((F.col("id") % 10).cast("double") / 10).alias("prob"))
    a, b, why = L.attach_oof(s.select("id"), c.select("id"), "m", s.select("id", F.col("s1").alias("oof_proba")), test_scores)
    if why:
        raise ValueError(why)
    return both(a, b)


@query("L5_unseen_values", "SELECT DISTINCT c_custkey AS value FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 5 <> 0)")
def l5(spark, sf):
    train = table(spark, sf, "orders").where("o_orderkey % 5 <> 0")
    return L.unseen_values(train, table(spark, sf, "customer"), "o_custkey", "c_custkey")
