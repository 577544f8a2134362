"""MLlib model fitting, out-of-fold scoring, calibration, search and stacking.

The driver loops over folds and parameter maps only; fitting and scoring are Spark jobs.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Sequence

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ordered import exact_quantiles
from .cleaning import require
from .evaluate import binary_metrics, threshold_sweep
from .isotonic import IsotonicTable, fit_isotonic

Fit = Callable[[DataFrame], Model]


def total_weight(df: DataFrame, weight: str | None) -> float:
    return float(df.agg(F.sum(weight) if weight else F.count(F.lit(1))).first()[0] or 1.0)


def cache_for_fit(df: DataFrame, rows_per_task: int = 100_000) -> DataFrame:
    """Persist training rows in as many partitions as their count deserves.

    Fitting runs one job per iteration; near-empty partitions would only add task overhead.
    """
    cached = df.persist()
    wanted = max(1, math.ceil(cached.count() / rows_per_task))
    return cached.coalesce(wanted) if wanted < cached.rdd.getNumPartitions() else cached


def fit_logistic(
    df: DataFrame, features: str = "features", label: str = "label", C: float = 1.0, l1_ratio: float = 0.0,
    weight: str | None = None, max_iter: int = 100,
) -> Model:
    """Logistic regression; ``C`` is the inverse strength over the summed loss."""
    reg = 1.0 / (C * total_weight(df, weight))
    lr = LogisticRegression(
        featuresCol=features, labelCol=label, regParam=reg, elasticNetParam=l1_ratio, standardization=False, maxIter=max_iter
    )
    return (lr.setWeightCol(weight) if weight else lr).fit(df)


def fit_linear_svm(df: DataFrame, features: str = "features", label: str = "label", C: float = 1.0, weight: str | None = None, max_iter: int = 100) -> Model:
    svm = LinearSVC(featuresCol=features, labelCol=label, regParam=1.0 / (C * total_weight(df, weight)), standardization=False, maxIter=max_iter)
    return (svm.setWeightCol(weight) if weight else svm).fit(df)


def fit_naive_bayes(df: DataFrame, features: str = "features", label: str = "label", kind: str = "complement", alpha: float = 1.0) -> Model:
    if kind not in ("complement", "multinomial", "bernoulli"):
        raise ValueError("kind must be 'complement', 'multinomial' or 'bernoulli'")
    return NaiveBayes(featuresCol=features, labelCol=label, modelType=kind, smoothing=alpha).fit(df)


def fit_random_forest(
    df: DataFrame, features: str = "features", label: str = "label", trees: int = 100, depth: int = 8, weight: str | None = None, seed: int = 42
) -> Model:
    rf = RandomForestClassifier(featuresCol=features, labelCol=label, numTrees=trees, maxDepth=depth, seed=seed)
    return (rf.setWeightCol(weight) if weight else rf).fit(df)


def fit_gbt(
    df: DataFrame, features: str = "features", label: str = "label", rounds: int = 50, depth: int = 5, step: float = 0.1,
    weight: str | None = None, validation: str | None = None, seed: int = 42,
) -> Model:
    """Boosted trees; rows flagged by ``validation`` decide early stopping."""
    gbt = GBTClassifier(featuresCol=features, labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed)
    if weight:
        gbt = gbt.setWeightCol(weight)
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return gbt.fit(df)


def add_score(model: Model, df: DataFrame, out: str = "score") -> DataFrame:
    """Class-1 probability; margin models pass their margin through a logistic curve."""
    scored = model.transform(df)
    if "probability" in scored.columns:
        scored = scored.withColumn(out, vector_to_array("probability")[1])
    else:
        scored = scored.withColumn(out, 1 / (1 + F.exp(-vector_to_array("rawPrediction")[1])))
    return scored.drop("rawPrediction", "probability", "prediction")


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="keep").transform(df)


def oof_predict(df: DataFrame, fold: str, folds: Sequence[int], fit: Fit, out: str = "oof_proba") -> DataFrame:
    """Every row scored by the model that never saw its fold."""
    require(df, fold)
    parts = [add_score(fit(df.where(F.col(fold) != k)), df.where(F.col(fold) == k), out) for k in folds]
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    return scored


def fold_models(df: DataFrame, fold: str, folds: Sequence[int], fit: Fit) -> list[Model]:
    return [fit(df.where(F.col(fold) != k)) for k in folds]


def fold_average(scores: DataFrame, key: str, score: str, out: str = "score") -> DataFrame:
    """Mean score per id over fold models or seeds."""
    return scores.groupBy(key).agg(F.avg(score).alias(out))


def predict_with_threshold(df: DataFrame, score: str, threshold: float, out: str = "label") -> DataFrame:
    return df.withColumn(out, (F.col(score) >= threshold).cast("int"))


# --- calibration ------------------------------------------------------------


def fit_calibrator(df: DataFrame, score: str, label: str, method: str = "isotonic") -> Model | IsotonicTable:
    if method == "isotonic":
        return fit_isotonic(df, score, label)
    if method == "sigmoid":
        return LogisticRegression(featuresCol="_x", labelCol=label, regParam=0.0).fit(assemble(df, [score], "_x"))
    raise ValueError("method must be 'isotonic' or 'sigmoid'")


def apply_calibrator(model: Model | IsotonicTable, df: DataFrame, score: str, out: str, method: str = "isotonic") -> DataFrame:
    if method == "isotonic":
        return model.apply(df, score, out)
    return add_score(model, assemble(df, [score], "_x"), out).drop("_x")


def calibrate(df: DataFrame, target: DataFrame, fold: str, folds: Sequence[int], fit: Fit, label: str, key: str, method: str = "isotonic", out: str = "score") -> DataFrame:
    """Mean over folds of a model fitted without the fold and calibrated on it."""
    parts = None
    for k in folds:
        model = fit(df.where(F.col(fold) != k))
        calibrator = fit_calibrator(add_score(model, df.where(F.col(fold) == k), "_raw"), "_raw", label, method)
        scored = apply_calibrator(calibrator, add_score(model, target, "_raw"), "_raw", "_one", method).select(key, "_one")
        parts = scored if parts is None else parts.unionByName(scored)
    return fold_average(parts, key, "_one", out)


# --- search -----------------------------------------------------------------


class MacroF1Evaluator(Evaluator):
    """Mean of the two classes' F1, for MLlib tuning."""

    def __init__(self, label: str = "label", prediction: str = "prediction"):
        super().__init__()
        self.label, self.prediction = label, prediction

    def _evaluate(self, dataset: DataFrame) -> float:
        return float(binary_metrics(dataset, self.label, self.prediction, metrics=["macro_f1"]).first()[0])

    def isLargerBetter(self) -> bool:
        return True


def full_grid(space: dict[str, Sequence]) -> list[dict]:
    return [dict(zip(space, values)) for values in itertools.product(*space.values())]


def log_uniform(low: float, high: float) -> Callable[[random.Random], float]:
    return lambda rng: math.exp(rng.uniform(math.log(low), math.log(high)))


def random_draws(space: dict[str, Sequence | Callable], n: int, seed: int = 42) -> list[dict]:
    rng = random.Random(seed)
    return [{k: (v(rng) if callable(v) else rng.choice(list(v))) for k, v in space.items()} for _ in range(n)]


def search(
    df: DataFrame, label: str, fold: str, folds: Sequence[int], fit: Callable[..., Model], candidates: Sequence[dict], cutoff: float = 0.5
) -> list[dict]:
    """Candidates ranked by mean fold macro-F1, ties in the order given; one aggregate ranks them all."""
    return _ranked(_votes(df, label, fold, folds, fit, candidates, cutoff, 0), label, fold, candidates)[0]


def _votes(df: DataFrame, label: str, fold: str, folds: Sequence[int], fit, candidates: Sequence[dict], cutoff: float, level: int) -> DataFrame:
    """``_level, _c, fold, label, _p``: every row's prediction by each candidate fitted without its fold."""
    parts = None
    for c, params in enumerate(candidates):
        scored = oof_predict(df, fold, folds, lambda d, p=params: fit(d, **p), "_s")
        voted = predict_with_threshold(scored, "_s", cutoff, "_p").select(F.lit(level).alias("_level"), F.lit(c).alias("_c"), fold, label, "_p")
        parts = voted if parts is None else parts.unionByName(voted)
    return parts


def _ranked(votes: DataFrame, label: str, fold: str, candidates: Sequence[dict]) -> dict[int, list[dict]]:
    """Per level the candidates, best first; one row comes back for each."""
    per = binary_metrics(votes, label, "_p", ["_level", "_c", fold], ["macro_f1"])
    rows = per.groupBy("_level", "_c").agg(F.avg("macro_f1").alias("m"), F.stddev_pop("macro_f1").alias("s")).collect()
    found: dict[int, list[dict]] = {}
    for r in sorted(rows, key=lambda r: (r["_level"], -r["m"], r["_c"])):
        found.setdefault(r["_level"], []).append({**candidates[r["_c"]], "mean_macro_f1": r["m"], "std_macro_f1": r["s"]})
    return found


def nested_search(
    df: DataFrame, label: str, outer: str, folds: Sequence[int], inner: str, inner_folds: Sequence[int], fit, candidates, cutoff: float = 0.5
) -> list[dict]:
    """Per outer fold the best candidate, searched on that fold's training rows only, and its macro-F1 on the fold.

    ``df`` should be cached: all fits read the one fold-tagged frame. One aggregate ranks the candidates of all
    outer folds, another judges the winners on the rows that none of their fits saw.
    """
    votes = None
    for k in folds:
        part = _votes(df.where(F.col(outer) != k), label, inner, inner_folds, fit, candidates, cutoff, k)
        votes = part if votes is None else votes.unionByName(part)
    best = {k: found[0] for k, found in _ranked(votes, label, inner, candidates).items()}
    judged = None
    for k in folds:
        model = fit(df.where(F.col(outer) != k), **{n: v for n, v in best[k].items() if n not in ("mean_macro_f1", "std_macro_f1")})
        part = predict_with_threshold(add_score(model, df.where(F.col(outer) == k), "_s"), "_s", cutoff, "_p").select(outer, label, "_p")
        judged = part if judged is None else judged.unionByName(part)
    outside = {r[outer]: r["macro_f1"] for r in binary_metrics(judged, label, "_p", [outer], ["macro_f1"]).collect()}
    return [{"fold": k, **best[k], "outer_macro_f1": outside.get(k)} for k in folds]


def aggregate_hyperparams(df: DataFrame, param: str, value: str, kinds: dict[str, str]) -> DataFrame:
    """Final value per parameter: ``geometric`` mean, ``mode`` (ties to the smaller) or ``median``."""
    bad = set(kinds.values()) - {"geometric", "mode", "median"}
    if bad:
        raise ValueError(f"unknown kind(s) {sorted(bad)}")
    picked = df.where(F.col(param).isin(list(kinds))).select(F.col(param).alias("param"), F.col(value).cast("double").alias("v"))
    kind = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("param")]
    counts = picked.groupBy("param", "v").agg(F.count(F.lit(1)).alias("n"))
    simple = counts.groupBy("param").agg(
        F.exp(F.sum(F.when(F.col("v") > 0, F.log("v") * F.col("n"))) / F.sum("n")).alias("geometric"),
        F.max_by("v", F.struct("n", -F.col("v"))).alias("mode"),
    )
    out = simple.withColumn("kind", kind)
    medians = [p for p, k in kinds.items() if k == "median"]
    if medians:
        cols = picked.select(*[F.when(F.col("param") == p, F.col("v")).alias(p) for p in medians])
        q = exact_quantiles(cols, medians, [0.5]).select(F.col("column").alias("param"), F.col("value").alias("median"))
        out = out.join(q, "param", "left")
    else:
        out = out.withColumn("median", F.lit(None).cast("double"))
    chosen = F.when(F.col("kind") == "geometric", F.col("geometric")).when(F.col("kind") == "mode", F.col("mode")).otherwise(F.col("median"))
    return out.select("param", "kind", chosen.alias("value"))


# --- stacking ---------------------------------------------------------------


def stack(oof_tables: dict[str, DataFrame], label: str, key: str = "id", score: str = "oof_proba", C: float = 1.0):
    """Meta logistic regression over joined out-of-fold scores; returns (model, joined, coefficients)."""
    joined = None
    for name, table in oof_tables.items():
        cols = [key, F.col(score).alias(name)] + ([label] if joined is None else [])
        part = table.select(*cols)
        joined = part if joined is None else joined.join(part, key)
    features = assemble(joined, list(oof_tables), "features")
    model = fit_logistic(features, label=label, C=C)
    return model, features, dict(zip(oof_tables, model.coefficients.toArray().tolist()))


def sweep_oof(oof: DataFrame, label: str, score: str, grid: Sequence[float], metric: str = "macro_f1") -> float:
    """Best cutoff on out-of-fold scores."""
    rows = threshold_sweep(oof, label, score, grid, [metric]).orderBy(F.desc(metric), "threshold").first()
    return float(rows["threshold"])
