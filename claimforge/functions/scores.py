"""Metric expressions over confusion counts, and score helpers."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` with division by zero giving 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def log_gamma(a: Column) -> Column:
    """ln of the gamma function for a > 0: ten steps of its recurrence, then the asymptotic series."""
    z = a + 10.0
    series = (z - 0.5) * F.log(z) - z + 0.5 * F.log(F.lit(2 * math.pi)) + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * F.pow(z, 5))
    product = F.lit(1.0)
    for i in range(10):
        product = product * (a + float(i))
    return series - F.log(product)


def gamma_tail(a: Column, x: Column, steps: int = 5000) -> Column:
    """Regularised upper incomplete gamma function Q(a, x).

    Below a + 1 one minus the power series, above it the continued fraction, each folded over ``steps`` terms
    (more than enough up to a of some hundred thousands, since terms fall off around the square root of a).
    """
    start = F.exp(a * F.log(x) - x - log_gamma(a))
    state = F.struct((1 / a).alias("term"), (1 / a).alias("sum"))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] * x / (a + i)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    terms = F.sequence(F.lit(1), F.lit(steps))
    low = 1 - start * F.aggregate(terms, state, add, lambda s: s["sum"])
    b0 = x + 1 - a
    # Evaluated from the far end inwards: x+1-a + 2k - k(k-a)/(...).
    fraction = F.aggregate(F.sequence(F.lit(steps), F.lit(1)), b0 + 2.0 * (steps + 1), lambda f, k: b0 + 2 * (k - 1) - k * (k - a) / f)
    high = start / fraction
    return F.when(x <= 0, 1.0).when(x < a + 1, low).otherwise(high)


def chi_square_tail(statistic: Column, dof: Column) -> Column:
    """Probability of a larger chi-square value; null without degrees of freedom."""
    return F.when(dof > 0, gamma_tail(dof / 2.0, statistic / 2.0))


def f1_of(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def metric(name: str, tp: Column, fp: Column, fn: Column, tn: Column) -> Column:
    """One classification metric from confusion counts (positive class = 1)."""
    n = tp + fp + fn + tn
    f1_pos, f1_neg = f1_of(tp, fp, fn), f1_of(tn, fn, fp)
    if name == "accuracy":
        return ratio(tp + tn, n)
    if name == "precision":
        return ratio(tp, tp + fp)
    if name == "recall":
        return ratio(tp, tp + fn)
    if name == "f1":
        return f1_pos
    if name == "macro_f1":
        return (f1_pos + f1_neg) / 2
    if name == "weighted_f1":
        return ratio(f1_pos * (tp + fn) + f1_neg * (tn + fp), n)
    if name == "balanced_acc":
        return (ratio(tp, tp + fn) + ratio(tn, tn + fp)) / 2
    if name == "mcc":
        a, b, c, d = (x.cast("double") for x in (tp, fp, fn, tn))
        return ratio(a * d - b * c, F.sqrt((a + b) * (a + c) * (d + b) * (d + c)))
    raise ValueError(f"unknown metric {name!r}")


METRICS = ["accuracy", "precision", "recall", "f1", "macro_f1", "weighted_f1", "mcc", "balanced_acc"]


def grid_cell(score: Column, grid: Sequence[float], inclusive: bool = True) -> Column:
    """How many cutoffs of the ascending ``grid`` the score passes, by binary search."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        cut = F.lit(float(grid[mid]))
        passed = score >= cut if inclusive else score > cut
        return F.when(passed, tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(grid))


def frange(start: float, stop: float, step: float) -> list[float]:
    """Decimal grid ``start, start+step, ...`` up to and including ``stop``."""
    n = int(round((stop - start) / step))
    return [round(start + i * step, 6) for i in range(n + 1)]


def softmax(logits: Column) -> Column:
    x = F.transform(logits, lambda v: v.cast("double"))
    raw = bind(x, lambda v: bind(F.array_max(v), lambda peak: F.transform(v, lambda e: F.exp(e - peak))))
    summed = lambda r: F.aggregate(r, F.lit(0.0), lambda a, e: a + e)
    return bind(raw, lambda r: bind(summed(r), lambda total: F.transform(r, lambda e: e / total)))
