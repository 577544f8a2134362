"""What is moved between tasks: texts once, not their terms; and the parts of a split join give what one join gives."""

import os
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimforge.operators import cleaning as C
from claimforge.operators import reduce as R
from claimforge.operators import textstats as S
from claimforge.operators import vectorize as V
from claimforge.plans import lookups
from claimforge.session import shared_dir


def exchanges(df):
    """The columns of each exchange by hash."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [re.findall(r"(\w+)#", keys) for keys in re.findall(r"Exchange hashpartitioning\((.*?)\)", plan)]


@pytest.fixture
def split(spark, monkeypatch):
    """Tables are measured, none is small, and one key is hot."""
    spark.conf.set(lookups.SETTLE_CONF, "true")
    monkeypatch.setattr(lookups, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(lookups, "HOT_ROWS", 1)
    yield
    spark.conf.unset(lookups.SETTLE_CONF)


@pytest.fixture
def texts(spark):
    rows = [(1, "aa bb aa"), (1, "bb cc"), (2, "aa dd dd"), (None, "aa"), (None, "ee aa"), (3, ""), (4, None)]
    return spark.createDataFrame(rows, "id int, t string")


def test_terms_are_counted_where_the_texts_were_dealt(texts):
    assert exchanges(V.term_counts(texts, "id", V.word_terms("t"))) == [["id"]]
    assert exchanges(V.hashed_counts(texts, "id", V.word_terms("t"))) == [["id"]]
    got = {(r["id"], r["term"]): r["tf"] for r in V.term_counts(texts, "id", V.word_terms("t")).collect()}
    assert got == {(1, "aa"): 2, (1, "bb"): 2, (1, "cc"): 1, (2, "aa"): 1, (2, "dd"): 2, (None, "aa"): 2, (None, "ee"): 1}


def test_hashed_weights_take_texts_apart_once(texts, spark, monkeypatch):
    def weights(df, key):
        out = V.hashed_weights(df, key, V.word_terms("t", (1, 2)), 16)
        return out, sorted((str(r[key]), r["term"], round(r["value"], 12)) for r in out.collect())

    pairs = texts.select(F.when(F.col("id") < 3, F.struct("id")).alias("pair"), "t")
    for df, key in ((texts, "id"), (pairs, "pair"), (texts.limit(0), "id"), (texts.union(texts).repartition(5), "id")):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
        try:
            out, packed = weights(df, key)
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Generate" not in plan and "Window" not in plan and packed == weights(df, key)[1]
        with monkeypatch.context() as m:
            m.setattr(V, "DENSE_BUCKETS", 0)
            assert packed == weights(df, key)[1]


def test_weights_of_a_split_vocabulary(texts, split, monkeypatch):
    def weights():
        return {(r["id"], r["term"]): round(r["value"], 9) for r in V.tfidf(texts, "id", V.word_terms("t")).collect()}

    parted = weights()
    monkeypatch.setattr(lookups, "BROADCAST_BYTES", 2**20)
    assert parted == weights() and len(parted) == 7


def test_rare_tokens_of_split_counts(texts, split):
    df = texts.withColumn("tokens", F.split(F.coalesce("t", F.lit("")), " ")).withColumn("tokens", F.filter("tokens", lambda w: w != ""))
    rows = S.rare_token_features(df, "id", "tokens").collect()
    assert sorted((str(r["t"]), r["rare_token_count"]) for r in rows) == [("", 0), ("None", 0), ("aa", 0), ("aa bb aa", 0), ("aa dd dd", 0), ("bb cc", 1), ("ee aa", 1)]
    given = df.sparkSession.createDataFrame([("aa", 9), ("bb", 5)], "token string, freq long")
    rows = S.rare_token_features(df, "id", "tokens", given).collect()
    assert {r["t"]: r["rare_token_count"] for r in rows if r["t"]} == {"aa bb aa": 0, "bb cc": 1, "aa dd dd": 2, "aa": 0, "ee aa": 1}


def test_only_known_forms_travel(spark):
    rows = [(1, ["a", "b", "a", None]), (1, ["a", "b", "a", None]), (None, ["b"]), (2, []), (3, None), (4, ["zz", "c"])]
    df = spark.createDataFrame(rows, "id int, tokens array<string>")
    bases = spark.createDataFrame([("a", "A"), ("c", "C"), ("zz", None)], "form string, base string")
    out = C.normalize_tokens_by_dictionary(df, "id", "tokens", bases)
    assert "posexplode" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = sorted(((r["id"], r["tokens"]) for r in out.collect()), key=str)
    want = [(1, ["A", "b", "A", None]), (1, ["A", "b", "A", None]), (2, []), (3, []), (4, ["zz", "C"]), (None, ["b"])]
    assert got == sorted(want, key=str)


def test_rows_by_directions_of_hot_and_other_terms(spark, monkeypatch):
    rows = np.random.default_rng(3).integers(0, 12, (300, 2))
    rows = sorted({(int(k), f"t{t * t // 12}") for k, t in rows})
    df = spark.createDataFrame([(k, t, float(len(t) + k % 3)) for k, t in rows], "k int, term string, value double")
    _, _, whole = R.reduced_rows(df, "k", 2)
    monkeypatch.setattr(R, "HOT_TERMS", 3)
    reduced, _, values = R.reduced_rows(df, "k", 2)
    assert np.allclose(values, whole) and reduced.count() == len({k for k, _ in rows})
    dense = np.zeros((12, 200))
    for k, t in rows:
        dense[k, int(t[1:])] = len(t) + k % 3
    assert np.allclose(values, np.linalg.svd(dense)[1][:2])


def test_passes_of_reduced_rows_leave_no_files(spark):
    """Only the directions and the reduced rows stay, however many passes there were; a null key has a row but no say."""
    folder = Path(shared_dir(spark).removeprefix("file:"))
    r = np.random.default_rng(5)
    dense = r.standard_normal((30, 12))
    rows = [(i, f"t{j}", float(dense[i, j])) for i in range(30) for j in range(12)] + [(None, "t0", 1.0), (None, "t0", 2.0), (None, "unseen", 9.0)]
    df = spark.createDataFrame(rows, "k int, term string, value double")
    before, tables = set(os.listdir(folder)), spark.catalog.listTables()
    reduced, terms, values = R.reduced_rows(df, "k", 2, passes=5, tolerance=0.0)
    left = [x for x in set(os.listdir(folder)) - before if not x.startswith(".")]
    assert sorted(x.split("-")[0] for x in left) == ["directions", "reduced"] and spark.catalog.listTables() == tables
    got, v = {x["k"]: [x["p0"], x["p1"]] for x in reduced.collect()}, {x["term"]: np.array([x["p0"], x["p1"]]) for x in terms.collect()}
    assert len(got) == 31 and "unseen" not in v and np.allclose(got[None], 3 * v["t0"])
    assert np.allclose(np.linalg.norm([got[i] for i in range(30)], axis=0), values, rtol=0.3)
