"""Classifier evaluation and blending on score tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimforge.functions.scores import METRICS, frange
from claimforge.operators import blend as B
from claimforge.operators import evaluate as N
from claimforge.operators import models as O

from .categories import r6
from .registry import SCORED, query, scored, table

_CELLS = "count(*) FILTER (label = 0 AND pred = 0) AS tn, count(*) FILTER (label = 0 AND pred = 1) AS fp, count(*) FILTER (label = 1 AND pred = 0) AS fn, count(*) FILTER (label = 1 AND pred = 1) AS tp"


def s_metrics(names) -> str:
    div = "coalesce(({a}) / nullif(({b})::DOUBLE, 0), 0)"
    f1 = div.format(a="2 * tp", b="2 * tp + fp + fn")
    f0 = div.format(a="2 * tn", b="2 * tn + fn + fp")
    rec1, rec0 = div.format(a="tp", b="tp + fn"), div.format(a="tn", b="tn + fp")
    all_ = {
        "accuracy": div.format(a="tp + tn", b="tp + fp + fn + tn"),
        "precision": div.format(a="tp", b="tp + fp"),
        "recall": rec1,
        "f1": f1,
        "macro_f1": f"({f1} + {f0}) / 2",
        "weighted_f1": div.format(a=f"{f1} * (tp + fn) + {f0} * (tn + fp)", b="tp + fp + fn + tn"),
        "mcc": div.format(a="tp::DOUBLE * tn - fp::DOUBLE * fn", b="sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn))"),
        "balanced_acc": f"({rec1} + {rec0}) / 2",
    }
    return ", ".join(f"round({all_[n]}, 6) AS {n}" for n in names)


_PRED = f"{SCORED}, p AS (SELECT *, CAST(s1 >= 0.5::DOUBLE AS INTEGER) AS pred FROM scored)"


def pred(spark, sf):
    return scored(spark, sf).withColumn("pred", (F.col("s1") >= 0.5).cast("int"))


# Line items as a large score table: returned or not, scored by price.
_LINES = """lines AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS label, l_extendedprice / 110000 AS score, l_linestatus FROM lineitem)"""


def lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_extendedprice") / 110000).alias("score"), "l_linestatus"
    )


@query("N1_confusion", f"WITH {_PRED} SELECT {_CELLS} FROM p")
def n1(spark, sf):
    return N.confusion(pred(spark, sf), "label", "pred")


@query("N2_binary_metrics", f"WITH {_PRED}, c AS (SELECT fold, {_CELLS} FROM p GROUP BY fold) SELECT fold, {s_metrics(METRICS)} FROM c")
def n2(spark, sf):
    return N.binary_metrics(pred(spark, sf), "label", "pred", ["fold"]).select("fold", *r6(*METRICS))


_AUC = """(SELECT sum(CASE WHEN a.{s} > b.{s} THEN 1.0 WHEN a.{s} = b.{s} THEN 0.5 ELSE 0 END) / count(*) FROM {t} a JOIN {t} b ON a.label = 1 AND b.label = 0)"""


@query("N3_roc_auc", f"WITH {SCORED} SELECT round({_AUC.format(s='s1', t='scored')}, 6)::DOUBLE AS roc_auc")
def n3(spark, sf):
    return N.roc_auc(scored(spark, sf), "label", "s1").select(*r6("roc_auc"))


_RANK_AUC = """r AS (SELECT l_linestatus, label, score, avg(rn) OVER (PARTITION BY l_linestatus, score) AS rk FROM (SELECT *, row_number() OVER (PARTITION BY l_linestatus ORDER BY score) AS rn FROM lines))"""


@query(
    "N3_roc_auc_lineitem",
    f"""WITH {_LINES}, {_RANK_AUC}, s AS (SELECT l_linestatus, sum(rk) FILTER (label = 1) AS sr, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM r GROUP BY 1)
    SELECT l_linestatus, round((sr - p * (p + 1) / 2) / (p::DOUBLE * n), 6) AS roc_auc FROM s""",
)
def n3_lines(spark, sf):
    return N.roc_auc(lines(spark, sf), "label", "score", ["l_linestatus"]).select("l_linestatus", *r6("roc_auc"))


def s_ladder(source: str, score: str) -> str:
    return f"""d AS (SELECT {score} AS score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM {source} GROUP BY 1),
      ladder AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM d WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))"""


@query("N4_average_precision", f"WITH {SCORED}, {s_ladder('scored', 's1')} SELECT round(sum(pos * (tp / (tp + fp))) / max(p), 6)::DOUBLE AS average_precision FROM ladder")
def n4(spark, sf):
    return N.average_precision(scored(spark, sf), "label", "s1").select(*r6("average_precision"))


@query("N4_average_precision_lineitem", f"WITH {_LINES}, {s_ladder('lines', 'score')} SELECT round(sum(pos * (tp / (tp + fp))) / max(p), 6)::DOUBLE AS average_precision FROM ladder")
def n4_lines(spark, sf):
    return N.average_precision(lines(spark, sf), "label", "score").select(*r6("average_precision"))


@query(
    "N5_curve_points",
    f"""WITH {SCORED}, {s_ladder('scored', 's1')} SELECT score AS threshold, round(fp / n, 6)::DOUBLE AS fpr, round(tp / p, 6)::DOUBLE AS tpr, round(tp / (tp + fp), 6)::DOUBLE AS precision, round(tp / p, 6)::DOUBLE AS recall FROM ladder""",
)
def n5(spark, sf):
    return N.curve_points(scored(spark, sf), "label", "s1").select("threshold", *r6("fpr", "tpr", "precision", "recall"))


@query(
    "N6_classification_report",
    f"""WITH {_PRED}, c AS (SELECT {_CELLS} FROM p), m AS (SELECT *, tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, 2 * tp / (2 * tp + fp + fn) AS f1, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, 2 * tn / (2 * tn + fn + fp) AS f0, tp + fn AS n1, tn + fp AS n0, tp + tn + fp + fn AS n FROM c)
    SELECT '0' AS row, round(p0, 6) AS precision, round(r0, 6) AS recall, round(f0, 6) AS f1, n0 AS support FROM m
    UNION ALL SELECT '1', round(p1, 6), round(r1, 6), round(f1, 6), n1 FROM m
    UNION ALL SELECT 'accuracy', round((tp + tn) / n, 6), round((tp + tn) / n, 6), round((tp + tn) / n, 6), n FROM m
    UNION ALL SELECT 'macro avg', round((p0 + p1) / 2, 6), round((r0 + r1) / 2, 6), round((f0 + f1) / 2, 6), n FROM m
    UNION ALL SELECT 'weighted avg', round((p0 * n0 + p1 * n1) / n, 6), round((r0 * n0 + r1 * n1) / n, 6), round((f0 * n0 + f1 * n1) / n, 6), n FROM m""",
)
def n6(spark, sf):
    return N.classification_report(pred(spark, sf), "label", "pred").select("row", *r6("precision", "recall", "f1"), "support")


def s_grid(grid) -> str:
    return f"g AS (SELECT unnest([{', '.join(repr(float(t)) + '::DOUBLE' for t in grid)}]) AS threshold)"


def s_sweep(source: str, score: str, op: str, grid, by: str = "") -> str:
    key = f"{by}, " if by else ""
    return f"""{s_grid(grid)}, c AS (SELECT {key}threshold, count(*) FILTER (label = 1 AND {score} {op} threshold) AS tp, count(*) FILTER (label = 0 AND {score} {op} threshold) AS fp,
      count(*) FILTER (label = 1 AND NOT {score} {op} threshold) AS fn, count(*) FILTER (label = 0 AND NOT {score} {op} threshold) AS tn FROM {source}, g GROUP BY ALL)"""


_SWEEP = ["macro_f1", "mcc", "balanced_acc"]
GRID = frange(0.20, 0.75, 0.01)


@query("N7_threshold_sweep", f"WITH {SCORED}, {s_sweep('scored', 's1', '>=', GRID)} SELECT threshold, {s_metrics(_SWEEP)} FROM c")
def n7(spark, sf):
    return N.threshold_sweep(scored(spark, sf), "label", "s1", GRID, _SWEEP).select("threshold", *r6(*_SWEEP))


STRICT = frange(0.30, 0.69, 0.01)


@query("N7_threshold_sweep_strict_best", f"WITH {SCORED}, {s_sweep('scored', 's1', '>', STRICT)}, m AS (SELECT threshold, {s_metrics(['macro_f1'])} FROM c) SELECT * FROM m ORDER BY macro_f1 DESC, threshold LIMIT 1")
def n7_best(spark, sf):
    sweep = N.threshold_sweep(scored(spark, sf), "label", "s1", STRICT, ["macro_f1"], inclusive=False)
    return N.best_threshold(sweep.select("threshold", *r6("macro_f1")))


@query("N7_threshold_sweep_lineitem", f"WITH {_LINES}, {s_sweep('lines', 'score', '>=', GRID, 'l_linestatus')} SELECT l_linestatus, threshold, {s_metrics(_SWEEP)} FROM c")
def n7_lines(spark, sf):
    return N.threshold_sweep(lines(spark, sf), "label", "score", GRID, _SWEEP, by=["l_linestatus"]).select("l_linestatus", "threshold", *r6(*_SWEEP))


_FOLD = f"""{_PRED}, c AS (SELECT fold, {_CELLS} FROM p GROUP BY fold), m AS (SELECT fold, {s_metrics(METRICS)} FROM c),
  a AS (SELECT x.fold, sum(CASE WHEN x.s1 > y.s1 THEN 1.0 WHEN x.s1 = y.s1 THEN 0.5 ELSE 0 END) / count(*) AS roc_auc FROM scored x JOIN scored y ON x.fold = y.fold AND x.label = 1 AND y.label = 0 GROUP BY 1),
  d AS (SELECT fold, s1, count(*) FILTER (label = 1) AS pos, count(*) AS n FROM scored GROUP BY ALL),
  e AS (SELECT fold, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS k, sum(pos) OVER (PARTITION BY fold) AS p FROM d WINDOW w AS (PARTITION BY fold ORDER BY s1 DESC ROWS UNBOUNDED PRECEDING)),
  ap AS (SELECT fold, sum(pos * (tp / k)) / max(p) AS average_precision FROM e GROUP BY fold),
  f AS (SELECT m.*, round(roc_auc, 6)::DOUBLE AS roc_auc, round(average_precision, 6)::DOUBLE AS average_precision FROM m JOIN a USING (fold) JOIN ap USING (fold))"""
_ALL = [*METRICS, "roc_auc", "average_precision"]


def _folds(spark, sf):
    return N.fold_metrics(scored(spark, sf), "label", "s1", "fold").select("fold", *r6(*_ALL))


@query("N8_fold_metrics", f"WITH {_FOLD} SELECT * FROM f")
def n8(spark, sf):
    return _folds(spark, sf)


@query("N8_cv_summary", f"WITH {_FOLD} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, round(avg({m}), 5)::DOUBLE AS mean, round(stddev_pop({m}), 5)::DOUBLE AS std FROM f" for m in _ALL))
def n8_summary(spark, sf):
    return N.cv_summary(_folds(spark, sf)).select("metric", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


_CUTS = N.thresholds_around(0.5)


@query("N9_multi_threshold_predictions", f"WITH {SCORED}, {s_grid(_CUTS)} SELECT id, threshold, CAST(s1 >= threshold AS INTEGER) AS label FROM scored, g")
def n9(spark, sf):
    return N.multi_threshold_predictions(scored(spark, sf), "id", "s1", _CUTS)


@query(
    "O8_aggregate_hyperparams",
    """SELECT l_shipmode AS param, kind, value FROM (
      SELECT 'A' AS l_shipmode, 'geometric' AS kind, round(exp(avg(ln(l_quantity))), 6) AS value FROM lineitem WHERE l_returnflag = 'A'
      UNION ALL SELECT 'N', 'median', round(quantile_cont(l_quantity, 0.5), 6) FROM lineitem WHERE l_returnflag = 'N'
      UNION ALL SELECT 'R', 'mode', (SELECT l_quantity FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))""",
)
def o8(spark, sf):
    out = O.aggregate_hyperparams(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", {"A": "geometric", "N": "median", "R": "mode"})
    return out.select("param", "kind", *r6("value"))


@query(
    "O11_fold_average",
    f"WITH {SCORED} SELECT id, round(avg(s), 6) AS score FROM (SELECT id, s1 AS s FROM scored UNION ALL SELECT id, s2 FROM scored) GROUP BY id",
)
def o11(spark, sf):
    s = scored(spark, sf)
    return O.fold_average(s.select("id", F.col("s1").alias("s")).unionByName(s.select("id", F.col("s2").alias("s"))), "id", "s").select("id", *r6("score"))


@query("O12_predict_with_threshold", f"WITH {SCORED} SELECT id, CAST(s1 >= 0.62::DOUBLE AS INTEGER) AS label FROM scored")
def o12(spark, sf):
    return O.predict_with_threshold(scored(spark, sf), "s1", 0.62).select("id", "label")


# --- blending ---------------------------------------------------------------

_WEIGHTS = B.weight_grid(2, 0.1)
_CUT41 = frange(0.30, 0.70, 0.02)


def s_blend(weights, grid) -> str:
    rows = ", ".join(f"({i}, {w[0]}::DOUBLE, {w[1]}::DOUBLE)" for i, w in enumerate(weights))
    return f"""w AS (SELECT * FROM (VALUES {rows}) AS v(weight_no, w1, w2)), {s_grid(grid)}, b AS (SELECT weight_no, w1, w2, label, w1 * s1 + w2 * s2 AS s FROM scored, w),
      c AS (SELECT weight_no, w1, w2, threshold, count(*) FILTER (label = 1 AND s >= threshold) AS tp, count(*) FILTER (label = 0 AND s >= threshold) AS fp, count(*) FILTER (label = 1 AND s < threshold) AS fn, count(*) FILTER (label = 0 AND s < threshold) AS tn FROM b, g GROUP BY ALL),
      m AS (SELECT weight_no, w1, w2, threshold, {s_metrics(['macro_f1'])} FROM c)"""


@query("P1_blend_search", f"WITH {SCORED}, {s_blend(_WEIGHTS, _CUT41)} SELECT * FROM m")
def p1(spark, sf):
    out = B.blend_search(scored(spark, sf), "label", ["s1", "s2"], _WEIGHTS, _CUT41)
    return out.select("weight_no", "w1", "w2", "threshold", *r6("macro_f1"))


@query("P1_best_blend", f"WITH {SCORED}, {s_blend(_WEIGHTS, _CUT41)} SELECT * FROM m ORDER BY macro_f1 DESC, weight_no, threshold LIMIT 1")
def p1_best(spark, sf):
    out = B.blend_search(scored(spark, sf), "label", ["s1", "s2"], _WEIGHTS, _CUT41)
    return B.best_blend(out.select("weight_no", "w1", "w2", "threshold", *r6("macro_f1")))


@query("P2_blend", f"WITH {SCORED} SELECT id, round(0.95::DOUBLE * s1 + 0.05::DOUBLE * s2, 6) AS blend FROM scored")
def p2(spark, sf):
    return B.blend(scored(spark, sf), {"s1": 0.95, "s2": 0.05}).select("id", *r6("blend"))


def s_vote(hi: str, lo: str) -> str:
    return f"CAST(CASE WHEN pred = 0 AND s2 >= {hi} THEN 1 WHEN pred = 1 AND s2 <= {lo} THEN 0 ELSE pred END AS INTEGER)"


@query("P3_confidence_override", f"WITH {_PRED}, v AS (SELECT id, pred, {s_vote('0.70::DOUBLE', '0.30::DOUBLE')} AS vote FROM p) SELECT id, vote, CAST(vote <> pred AS INTEGER) AS flipped FROM v")
def p3(spark, sf):
    return B.confidence_override(pred(spark, sf), "pred", "s2").select("id", "vote", "flipped")


@query(
    "P3_override_report",
    f"WITH {_PRED}, v AS (SELECT pred, {s_vote('0.70::DOUBLE', '0.30::DOUBLE')} AS vote FROM p) SELECT count(*) AS rows, count(*) FILTER (vote <> pred) AS flips, round(count(*) FILTER (vote <> pred) * 100.0 / count(*), 6)::DOUBLE AS flip_pct, CAST(sum(vote) AS BIGINT) AS positives FROM v",
)
def p3_report(spark, sf):
    return B.override_report(B.confidence_override(pred(spark, sf), "pred", "s2")).select("rows", "flips", *r6("flip_pct"), "positives")


@query(
    "P4_group_aware_override",
    f"""WITH {_PRED}, r AS (SELECT speaker, avg(label) FILTER (s2 >= 0.5::DOUBLE) AS prec FROM scored GROUP BY 1),
      t AS (SELECT p.*, CASE WHEN prec > 0.80::DOUBLE THEN 0.5::DOUBLE WHEN prec < 0.60::DOUBLE THEN 0.85::DOUBLE ELSE 0.70::DOUBLE END AS hi, CASE WHEN prec > 0.80::DOUBLE THEN 0.5::DOUBLE WHEN prec < 0.60::DOUBLE THEN 0.15::DOUBLE ELSE 0.30::DOUBLE END AS lo FROM p LEFT JOIN r USING (speaker)),
      v AS (SELECT id, pred, {s_vote('hi', 'lo')} AS vote FROM t) SELECT id, vote, CAST(vote <> pred AS INTEGER) AS flipped FROM v""",
)
def p4(spark, sf):
    return B.group_aware_override(pred(spark, sf), scored(spark, sf), "speaker", "pred", "s2", oof_score="s2").select("id", "vote", "flipped")


@query(
    "P5_score_correlation",
    f"WITH {SCORED} SELECT round(corr(s1, s2), 6) AS correlation, round(avg(CASE WHEN (s1 >= 0.5::DOUBLE) = (s2 >= 0.5::DOUBLE) THEN 1.0 ELSE 0 END), 6)::DOUBLE AS agreement, count(*) AS rows FROM scored",
)
def p5(spark, sf):
    return B.score_correlation(scored(spark, sf), "s1", "s2").select(*r6("correlation", "agreement"), "rows")
