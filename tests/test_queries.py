"""Every registered query with SQL beside it, compared over whole tables."""

import os

import pytest

from oracle import compare, duck
from queries import CHECKS, QUERIES

SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_sql(spark, con, name):
    difference = compare(QUERIES[name](spark, SF_DIR), con, CHECKS[name])
    assert difference in ("", "empty")


@pytest.mark.parametrize("name", ["I6_hashing_tfidf", "I11_embed_text", "M13_chi_square_p_value", "O4_fit_random_forest", "Q3_score_batch"])
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_hashed_weights_keep_words_apart(spark):
    from pyspark.sql import functions as F

    from claimforge.operators import vectorize as V
    from queries.registry import table

    d = table(spark, SF_DIR, "documents")
    n = d.count()
    terms = d.select("doc_id", F.explode(V.word_terms("text")).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))
    idf = terms.groupBy("term").agg(F.log((n + 1) / (F.count(F.lit(1)) + 1)).alias("idf"))
    want = terms.join(idf, "term").groupBy("doc_id").agg(F.sum(F.col("tf") * F.col("idf")).alias("want"))
    both = QUERIES["I6_hashing_tfidf"](spark, SF_DIR).join(want, "doc_id")
    far = both.where(F.abs(F.col("weight_sum") - F.col("want")) > 0.05 * F.col("want") + 1e-6).count()
    assert both.count() > 0 and far <= 0.02 * both.count()


def test_entry(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert rows and set(e.oracle_sql()) <= set(e.queries())
