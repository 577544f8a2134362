"""Evaluation and blending against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimforge.functions.scores import METRICS, frange
from claimforge.operators import blend as B
from claimforge.operators import evaluate as N
from claimforge.operators import joins as L
from claimforge.operators import models as O


@pytest.fixture(scope="module")
def scores(spark):
    rng = random.Random(11)
    rows = [(i, y := int(rng.random() < 0.35), round(min(0.99, max(0.0, rng.gauss(0.4 + 0.2 * y, 0.2))), 2), rng.random(), i % 4) for i in range(800)]
    return spark.createDataFrame(rows, "id bigint, label int, s double, r double, fold int").cache()


def auc(ys, ss):
    pos = [s for y, s in zip(ys, ss) if y == 1]
    neg = [s for y, s in zip(ys, ss) if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def macro_f1(ys, ps):
    def f1(c):
        tp = sum(y == p == c for y, p in zip(ys, ps))
        d = sum(y == c for y in ys) + sum(p == c for p in ps)
        return 2 * tp / d if d else 0.0

    return (f1(0) + f1(1)) / 2


def columns(df, *names):
    rows = df.orderBy("id").select(*names).collect()
    return [[r[i] for r in rows] for i in range(len(names))]


def test_auc_with_ties_and_monotone_transform(scores):
    ys, ss = columns(scores, "label", "s")
    want = auc(ys, ss)
    assert N.roc_auc(scores, "label", "s").first()[0] == pytest.approx(want)
    squashed = scores.withColumn("s", F.exp(F.col("s") * 30) - 5)
    assert N.roc_auc(squashed, "label", "s").first()[0] == pytest.approx(want)


def test_auc_by_fold(scores):
    got = {r["fold"]: r["roc_auc"] for r in N.roc_auc(scores, "label", "r", ["fold"]).collect()}
    for k in range(4):
        ys, rs = columns(scores.where(F.col("fold") == k), "label", "r")
        assert got[k] == pytest.approx(auc(ys, rs))


def test_average_precision(scores):
    ys, ss = columns(scores, "label", "s")
    total, prev, want = sum(ys), 0, 0.0
    for t in sorted(set(ss), reverse=True):
        tp = sum(y for y, s in zip(ys, ss) if s >= t)
        want += (tp - prev) / total * tp / sum(s >= t for s in ss)
        prev = tp
    assert N.average_precision(scores, "label", "s").first()[0] == pytest.approx(want)


@pytest.mark.parametrize("rows,value", [([(1, 0.9), (0, 0.1)], 1.0), ([(1, 0.5), (0, 0.5), (0, 0.5)], 0.5), ([(1, 0.2), (1, 0.3)], None)])
def test_auc_edges(spark, rows, value):
    assert N.roc_auc(spark.createDataFrame(rows, "label int, s double"), "label", "s").first()[0] == value


@pytest.mark.parametrize("inclusive", [True, False])
def test_sweep_equals_brute_force(scores, inclusive):
    grid = frange(0.2, 0.75, 0.05)
    ys, ss = columns(scores, "label", "s")
    got = {r["threshold"]: r["macro_f1"] for r in N.threshold_sweep(scores, "label", "s", grid, inclusive=inclusive).collect()}
    assert sorted(got) == grid
    for t in grid:
        assert got[t] == pytest.approx(macro_f1(ys, [int(s >= t if inclusive else s > t) for s in ss]))


def test_best_threshold_takes_the_first(spark):
    flat = spark.createDataFrame([(1, 0.9), (0, 0.1)], "label int, s double")
    sweep = N.threshold_sweep(flat, "label", "s", [0.2, 0.5, 0.8])
    assert N.best_threshold(sweep).first()["threshold"] == 0.2


def test_metrics_of_one_class_are_zero_not_null(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "label int, p int")
    row = N.binary_metrics(df, "label", "p").first().asDict()
    assert row["mcc"] == 0.0 and row["precision"] == 0.0 and row["accuracy"] == 1.0 and set(row) == set(METRICS)


def test_blend_search_equals_brute_force(scores):
    weights, cuts = B.weight_grid(2, 0.25), [0.3, 0.5]
    ys, ss, rs = columns(scores, "label", "s", "r")
    for row in B.blend_search(scores, "label", ["s", "r"], weights, cuts).collect():
        ps = [int(row["w1"] * s + row["w2"] * r >= row["threshold"]) for s, r in zip(ss, rs)]
        assert row["macro_f1"] == pytest.approx(macro_f1(ys, ps))
    assert len(B.weight_grid(3, 0.5)) == 6


def test_override(spark):
    df = spark.createDataFrame([(0, 0.7), (0, 0.69), (1, 0.3), (1, 0.31), (1, 0.9)], "b int, o double")
    assert [r["vote"] for r in B.confidence_override(df, "b", "o").collect()] == [1, 0, 0, 1, 1]


def test_attach_oof_skips(scores, spark):
    ids = scores.select("id")
    good = scores.select("id", F.col("s").alias("oof_proba"))
    assert L.attach_oof(ids, ids, "m", good, good)[2] is None
    assert "rows" in L.attach_oof(ids, ids, "m", good.limit(10), good)[2]
    assert L.attach_oof(ids, ids, "m", ids, good)[2] == "no score column"
    assert L.attach_oof(ids, ids.unionByName(spark.range(900, 901)), "m", good, good)[2] == "ids without a score"


def test_models_find_a_planted_signal(scores):
    d = O.cache_for_fit(O.assemble(scores, ["s", "r"]))
    for fit in (
        lambda x: O.fit_logistic(x, max_iter=20),
        lambda x: O.fit_linear_svm(x, max_iter=10),
        lambda x: O.fit_random_forest(x, trees=5, depth=3),
        lambda x: O.fit_gbt(x, rounds=3, depth=2),
    ):
        oof = O.oof_predict(d, "fold", [0, 1], fit)
        assert N.roc_auc(oof, "label", "oof_proba").first()[0] > 0.6
    with pytest.raises(ValueError):
        O.fit_naive_bayes(d, kind="gaussian")


def test_calibration_and_stacking(scores):
    d = O.cache_for_fit(O.assemble(scores, ["s", "r"]))
    for method in ("isotonic", "sigmoid"):
        out = O.calibrate(d, d, "fold", [0, 1], lambda x: O.fit_logistic(x, max_iter=10), "label", "id", method)
        assert out.where("score < 0 or score > 1").count() == 0 and out.count() == 800
    oof = scores.select("id", "label", F.col("s").alias("oof_proba"))
    noise = scores.select("id", F.col("r").alias("oof_proba"))
    _, joined, coefficients = O.stack({"good": oof, "noise": noise}, "label")
    assert joined.count() == 800 and coefficients["good"] > abs(coefficients["noise"])


def test_search_ranks_candidates(scores):
    d = O.cache_for_fit(O.assemble(scores, ["s", "r"]))
    ranked = O.search(d, "label", "fold", [0, 1], lambda x, **p: O.fit_logistic(x, max_iter=10, **p), O.full_grid({"C": [1e-6, 1.0]}))
    assert ranked[0]["mean_macro_f1"] >= ranked[1]["mean_macro_f1"] and len(ranked) == 2
    draws = O.random_draws({"C": O.log_uniform(0.1, 1), "p": ["a", "b"]}, 4)
    assert draws == O.random_draws({"C": O.log_uniform(0.1, 1), "p": ["a", "b"]}, 4) and all(0.1 <= x["C"] <= 1 for x in draws)
    assert O.MacroF1Evaluator().evaluate(scores.withColumn("prediction", F.col("label").cast("double"))) == pytest.approx(1.0)
    assert np.isfinite(O.sweep_oof(scores, "label", "s", [0.3, 0.5]))
