"""Closed-form Bayes, isotonic blocks, reduced rows, tails of chi-square, hashing, draws, phrases and nested search."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimforge.functions import scores as S
from claimforge.operators import bayes as NB
from claimforge.operators import isotonic as ISO
from claimforge.operators import models as O
from claimforge.operators import reduce as R
from claimforge.operators import splits as K
from claimforge.operators import textstats as T
from claimforge.operators import vectorize as V

WORDS = "tax job school water border vote crime health".split()


@pytest.fixture(scope="module")
def texts(spark):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choices(WORDS[: 5 + 3 * (i % 2)], k=rnd.randint(1, 9))), i % 2 if i < 70 else None) for i in range(90)]
    return spark.createDataFrame([*rows, (90, "", None), (91, "never seen", None)], "id int, t string, y int")


def dense(df, texts):
    """Rows of counts by id and the sorted terms of labelled rows."""
    seen = {r["id"]: Counter(w for w in r["t"].split() if len(w) > 1) for r in texts.collect()}
    y = {r["id"]: r["y"] for r in texts.collect()}
    terms = sorted({w for i, c in seen.items() if y[i] is not None for w in c})
    return seen, y, terms


@pytest.mark.parametrize(("kind", "norm"), [("multinomial", False), ("complement", False), ("complement", True), ("bernoulli", False)])
def test_bayes_equals_the_textbook(texts, kind, norm):
    seen, y, terms = dense(texts, texts)
    counts = V.term_counts(texts, "id", V.word_terms("t")).withColumnRenamed("tf", "value")
    model = NB.fit_bayes(counts, texts.select("id", "y"), "id", "y", kind, 0.7, norm)
    got = {r["id"]: r["score"] for r in NB.score_bayes(model, counts, texts, "id").collect()}
    take = (lambda c, w: float(c[w] > 0)) if kind == "bernoulli" else (lambda c, w: float(c[w]))
    x = {i: np.array([take(c, w) for w in terms]) for i, c in seen.items()}
    sums = [sum(x[i] for i in x if y[i] == c) for c in (0, 1)]
    rows = [sum(1 for v in y.values() if v == c) for c in (0, 1)]
    for i, v in x.items():
        if kind == "multinomial":
            j = [math.log(rows[c]) + v @ np.log((sums[c] + 0.7) / (sums[c] + 0.7).sum()) for c in (0, 1)]
        elif kind == "complement":
            logged = [np.log((sums[1 - c] + 0.7) / (sums[1 - c] + 0.7).sum()) for c in (0, 1)]
            j = [v @ (logged[c] / logged[c].sum() if norm else -logged[c]) for c in (0, 1)]
        else:
            p = [(sums[c] + 0.7) / (rows[c] + 1.4) for c in (0, 1)]
            j = [math.log(rows[c]) + (v * np.log(p[c]) + (1 - v) * np.log(1 - p[c])).sum() for c in (0, 1)]
        assert got[i] == pytest.approx(1 / (1 + math.exp(j[0] - j[1])))


def test_bayes_without_rows_or_with_one_class(texts):
    counts = V.term_counts(texts, "id", V.word_terms("t")).withColumnRenamed("tf", "value")
    one = NB.fit_bayes(counts, texts.where("y = 1").select("id", "y"), "id", "y", "multinomial")
    assert {r["score"] for r in NB.score_bayes(one, counts, texts, "id").collect()} == {1.0}
    with pytest.raises(ValueError):
        NB.fit_bayes(counts, texts, "id", "y", "gaussian")
    none = NB.fit_bayes(counts, texts.where("y = 5").select("id", "y"), "id", "y", "complement")
    assert {r["score"] for r in NB.score_bayes(none, counts, texts, "id").collect()} == {0.5}


def pooled(points):
    """One machine: adjacent violators over sorted (score, n, total)."""
    out = []
    for s, n, t in points:
        out.append([s, s, n, t])
        while len(out) > 1 and out[-2][3] / out[-2][2] >= out[-1][3] / out[-1][2]:
            b = out.pop()
            out[-1] = [out[-1][0], b[1], out[-1][2] + b[2], out[-1][3] + b[3]]
    return out


@pytest.mark.parametrize("tail", [False, True])
def test_isotonic_equals_one_machine(spark, monkeypatch, tail):
    monkeypatch.setattr(ISO, "ROWS_A_RANGE", 40)
    monkeypatch.setattr(ISO, "RANGES_MERGED", 3)
    rnd = random.Random(8)
    rows = []
    for _ in range(4000):
        s = rnd.paretovariate(0.7) if tail else round(rnd.random(), 3)
        rows.append((s, int(rnd.random() < min(s / (10 if tail else 1), 1)), rnd.choice([1.0, 2.5])))
    df = spark.createDataFrame([*rows, (None, 1, 1.0), (0.5, None, 1.0), (float("nan"), 1, 1.0)], "s double, y int, w double")
    by = {}
    for s, y, w in rows:
        n, t = by.get(s, (0.0, 0.0))
        by[s] = (n + w, t + w * y)
    want = pooled([(s, *by[s]) for s in sorted(by)])
    got = ISO.isotonic_blocks(df, "s", "y", "w").orderBy("lo").collect()
    assert [(r["lo"], r["hi"]) for r in got] == [(b[0], b[1]) for b in want]
    assert [r["total"] / r["n"] for r in got] == pytest.approx([b[3] / b[2] for b in want])
    table = ISO.fit_isotonic(df, "s", "y", "w")
    ends = table.apply(spark.createDataFrame([(-1e9,), (1e12,), (None,)], "s double"), "s", "v").collect()
    assert [r["v"] for r in ends] == [pytest.approx(want[0][3] / want[0][2]), pytest.approx(want[-1][3] / want[-1][2]), None]


def test_isotonic_of_nothing(spark):
    empty = spark.createDataFrame([], "s double, y int")
    one = spark.createDataFrame([(0.5, 1)], "s double, y int")
    assert ISO.fit_isotonic(empty, "s", "y").apply(one, "s", "v").first()["v"] is None
    assert ISO.fit_isotonic(one, "s", "y").apply(one, "s", "v").first()["v"] == 1.0


def test_reduced_rows_equal_a_dense_decomposition(spark):
    r = np.random.default_rng(1)
    a = r.standard_normal((60, 4)) @ np.diag([9, 5, 3, 1]) @ r.standard_normal((4, 25)) + 0.01 * r.standard_normal((60, 25))
    df = spark.createDataFrame([(i, f"t{j}", float(a[i, j])) for i in range(60) for j in range(25)], "k int, term string, value double")
    rows, terms, values = R.reduced_rows(df, "k", 3)
    u, s, vt = np.linalg.svd(a)
    assert values == pytest.approx(s[:3].tolist(), rel=1e-9)
    got = np.array([[x[f"p{j}"] for j in range(3)] for x in rows.orderBy("k").collect()])
    want = u[:, :3] * s[:3]
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-5 * s[0]
    v = {x["term"]: [x[f"p{j}"] for j in range(3)] for x in terms.collect()}
    v = np.array([v[f"t{j}"] for j in range(25)])
    assert np.abs(a @ v - got).max() < 1e-9 and np.abs(v.T @ v - np.eye(3)).max() < 1e-9


def test_reduced_rows_of_low_rank(spark):
    df = spark.createDataFrame([(i, f"t{i % 2}", 1.0 + i % 2) for i in range(10)], "k int, term string, value double")
    rows, _, values = R.reduced_rows(df, "k", 5)
    assert values == pytest.approx([math.sqrt(20), math.sqrt(5)]) and rows.columns == ["k", "p0", "p1"] and rows.count() == 10


def even_tail(x, dof):
    term, total = 1.0, 1.0
    for i in range(1, dof // 2):
        term *= x / 2 / i
        total += term
    return math.exp(-x / 2) * total


def test_chi_square_tail(spark):
    cases = [(x, d) for d in (2, 4, 10, 200, 5000) for x in (0.0, 0.01, d / 3, d * 0.99, float(d), d * 1.05, d * 1.5)]
    df = spark.createDataFrame(cases, "x double, dof long").withColumn("p", S.chi_square_tail(F.col("x"), F.col("dof")))
    for r in df.collect():
        want = even_tail(r["x"], r["dof"]) if r["dof"] <= 200 else None
        assert 0 <= r["p"] <= 1 + 1e-12
        if want is not None:
            assert r["p"] == pytest.approx(want, rel=1e-9, abs=1e-300)
    odd = spark.createDataFrame([(x, 1) for x in (0.1, 1.0, 3.841458820694124, 30.0)], "x double, dof long").withColumn("p", S.chi_square_tail(F.col("x"), F.col("dof")))
    assert [r["p"] for r in odd.orderBy("x").collect()] == pytest.approx([math.erfc(math.sqrt(x / 2)) for x in (0.1, 1.0, 3.841458820694124, 30.0)], rel=1e-9)
    assert df.select(S.chi_square_tail(F.lit(1.0), F.lit(0))).first()[0] is None


def test_draws_of_very_few_rows(spark, monkeypatch):
    monkeypatch.setattr(K, "RUN_OF_COPIES", 7)
    df = spark.range(103).select("id", (F.col("id") < 100).cast("int").alias("y"), F.lit("v").alias("x"))
    out = K.oversample_minority(df, "y", "id").collect()
    drawn = [r for r in out if r["y"] == 0]
    assert len(out) == 200 and len(drawn) == 100 and {r["id"] for r in drawn} <= {100, 101, 102}
    for i in {r["id"] for r in drawn}:
        assert sorted(r["draw"] for r in drawn if r["id"] == i) == list(range(1, 1 + sum(r["id"] == i for r in drawn)))
    assert K.oversample_minority(df.where("y = 1"), "y", "id").count() == 100


def test_phrases_against_brute_force(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choices(["a", "b", "c", "dd"], k=rnd.randint(0, 12)))) for i in range(80)]
    listed = [("a", "PERSON"), ("a a", "ORG"), ("b a b", "GPE"), ("dd", "CARDINAL"), ("c dd c dd", "DATE"), ("a", "PERSON"), ("a", "MONEY"), ("zz", "ORG"), ("", "ORG"), ("a  b", "ORG")]
    df = spark.createDataFrame([*rows, (80, None), (None, "a a a"), (1, "b a b a b")], "id int, t string")
    got = sorted((str(r["id"]), r["t"] or "", r["entity_total_entities"], r["entity_PERSON"], r["entity_ORG"], r["entity_GPE"], r["entity_DATE"], r["entity_NUM"]) for r in T.gazetteer_entity_counts(df, "id", "t", spark.createDataFrame(listed, "phrase string, type string")).collect())
    want = []
    for i, t in [*rows, (80, None), (None, "a a a"), (1, "b a b a b")]:
        words, n = (t or "").split(), Counter()
        for phrase, kind in listed:
            p = phrase.split(" ")
            kind = "NUM" if kind in T.NUMERIC_ENTITY_LABELS else kind
            n[kind] += sum(words[j : j + len(p)] == p for j in range(len(words) - len(p) + 1)) if phrase else 0
        want.append((str(i), t or "", sum(n.values()), n["PERSON"], n["ORG"], n["GPE"], n["DATE"], n["NUM"]))
    assert got == sorted(want)


def test_hashed_counts_repeat_md5(spark):
    import hashlib

    df = spark.createDataFrame([(1, "one two two"), (2, "three"), (3, "")], "id int, t string")
    got = {(r["id"], r["term"]): r["tf"] for r in V.hashed_counts(df, "id", V.word_terms("t"), 50).collect()}
    want = Counter((i, int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 50) for i, t in ((1, "one two two"), (2, "three")) for w in t.split())
    assert got == dict(want)
    with pytest.raises(ValueError):
        V.hashed_counts(df, "id", V.word_terms("t"), 0)


def test_nested_search_never_sees_the_outer_fold(spark):
    rnd = random.Random(3)
    df = spark.createDataFrame([(i, i % 2, i % 3, (i // 3) % 2, rnd.random() + (i % 2) * 0.5) for i in range(120)], "id int, label int, outer int, inner int, x double")
    d = O.assemble(df, ["x"]).cache()
    seen = []

    def fit(x, **p):
        seen.append({tuple(r) for r in x.select("outer", "inner").distinct().collect()})
        return O.fit_logistic(x, max_iter=10, **p)

    grid = O.full_grid({"C": [1e-6, 1.0]})
    best = O.nested_search(d, "label", "outer", [0, 1, 2], "inner", [0, 1], fit, grid)
    assert len(seen) == 3 * 2 * 2 + 3 and all(len({o for o, _ in s}) == 2 for s in seen)
    for row in best:
        alone = O.search(d.where(F.col("outer") != row["fold"]), "label", "inner", [0, 1], lambda x, **p: O.fit_logistic(x, max_iter=10, **p), grid)
        assert alone[0]["C"] == row["C"] and alone[0]["mean_macro_f1"] == pytest.approx(row["mean_macro_f1"])
        assert 0.4 < row["outer_macro_f1"] <= 1
