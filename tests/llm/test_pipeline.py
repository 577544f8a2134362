"""Registered queries and the pipeline over the small tables."""

import os

import pytest

import corpus_pipeline
from claimforge.llm import decontaminate
from claimforge.llm.queries import CHECKS, QUERIES
from oracle import compare, duck

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, SF_DIR), duck(SF_DIR), CHECKS[name]) in ("", "empty")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(CHECKS)))
def test_rows(spark, name):
    n = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    if name.startswith("op11_"):
        n = 16 * spark.read.parquet(f"{SF_DIR}/embeddings.parquet").count()
    rows = QUERIES[name](spark, SF_DIR).count()
    assert rows >= n if name.startswith("op1_") else rows > 0 if name.startswith("op3_") else rows == n


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF_DIR), name)[0]
        counts.append(docs.count())
        if name != "best_fit_packing":
            assert docs.columns == columns
    assert counts[0] > counts[1] > counts[2] > counts[3] == counts[4] <= counts[5]


def test_only_the_leaking_row_goes(spark, tmp_path):
    leak = " ".join(f"question {i} asks about river {i * 7} and hill {i * 3}" for i in range(8))
    clean = " ".join(f"plain {i} words of harbour {i * 5} and field {i * 11}" for i in range(30))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "so " + leak, "x"), (None, clean, "x"), (5, leak + " then", "x"), (5, clean + " more", "x"), (6, None, "x"), (7, "", "x"), (5, clean + " more", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, cosine string")
    kept = corpus_pipeline.drop_leaks(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted((r for r in rows if leak not in (r[1] or "")), key=str)


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, SF_DIR), name)[0]
        assert docs.count() == 0


def test_leaks_are_searched_in_a_space_of_all_documents(spark, tmp_path, monkeypatch):
    seen, fit = [], decontaminate.latent_space
    monkeypatch.setattr(decontaminate, "latent_space", lambda rows, *rest: (seen.append(rows.count()), fit(rows, *rest))[1])
    leak = " ".join(f"question {i} asks about river {i * 7} and hill {i * 3}" for i in range(8))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, leak if i == 1100 else f"nothing of note in river town {i}") for i in range(1200)]
    kept = corpus_pipeline.drop_leaks(spark, spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path))
    assert seen == [1201] and kept.count() == 1199
