"""Readers and writers: each query writes a whole table to the shared folder and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimforge.operators import textstats as S
from claimforge.session import scratch_path
from claimforge.sources import tables as A

from .registry import FULL_CLAIMS, SCORED, full_claims, query, scored, table


@query(
    "A1_read_claims_csv",
    f"WITH {FULL_CLAIMS} SELECT CAST(id AS VARCHAR) AS id, label, statement, subject, speaker, speaker_job, state_info, party_affiliation FROM full_claims",
)
def a1(spark, sf):
    path = scratch_path(spark, "claims")
    A.write_csv(full_claims(spark, sf), path)
    return A.read_claims(spark, path)


@query("A1_read_parquet", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def a1_parquet(spark, sf):
    return A.read_claims(spark, f"{sf}/documents.parquet", "parquet")


@query("A2_write_predictions", f"WITH {SCORED} SELECT CAST(id AS VARCHAR) AS id, CAST(s1 >= 0.5::DOUBLE AS INTEGER) AS label FROM scored")
def a2(spark, sf):
    path = scratch_path(spark, "predictions")
    A.write_predictions(scored(spark, sf).withColumn("p", (F.col("s1") >= 0.5).cast("int")), path, "id", "p")
    return A.read_predictions(spark, path)


@query("A3_write_oof", f"WITH {SCORED} SELECT id, s1 AS oof_proba, label FROM scored")
def a3(spark, sf):
    path = scratch_path(spark, "oof")
    A.write_oof(scored(spark, sf), path, "id", "s1", "label")
    return spark.read.parquet(path)


@query("A4_first_available_scores", f"WITH {SCORED} SELECT 'second' AS source, id, s2 AS oof_proba, label FROM scored")
def a4(spark, sf):
    base = scratch_path(spark, "candidates")
    s = scored(spark, sf)
    parts = {p: f"{base}/second/{p}" for p in ("oof", "holdout", "test")}
    for path in parts.values():
        A.write_oof(s, path, "id", "s2", "label")
    # The first candidate lacks its test part, so the second one is taken.
    A.write_oof(s, f"{base}/first/oof", "id", "s1", "label")
    first = {"name": "first", "oof": f"{base}/first/oof", "holdout": f"{base}/first/oof", "test": f"{base}/first/test"}
    name, found = A.first_available_scores(spark, [first, {"name": "second", **parts}])
    return found["oof"].select(F.lit(name).alias("source"), "id", "oof_proba", "label")


@query(
    "A5_write_features",
    "SELECT doc_id, lang, CAST(length(text) AS INTEGER) AS length, CAST(len(regexp_extract_all(text, ',')) AS INTEGER) AS comma_count FROM documents",
)
def a5(spark, sf):
    path = scratch_path(spark, "features")
    d = S.manual_text_features(table(spark, sf, "documents").select("doc_id", "text", "lang"), "text")
    A.write_features(d.select("doc_id", "lang", "length", "comma_count"), path, ["lang"])
    return spark.read.parquet(path)
