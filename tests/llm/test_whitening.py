"""Eigenpairs against dense ones, whitening against numpy, exact sums, odd rows."""

import numpy as np
import pytest

from claimforge.llm import whitening as W
from claimforge.llm.eigen import leading_pairs, minres_block


def pairs(a, k):
    e, x = leading_pairs(lambda u: a @ u, len(a), k)
    assert np.linalg.norm(a @ x - x * e, axis=0).max() <= 1e-13 * max(abs(e[0]), 1e-300)
    assert np.abs(x.T @ x - np.eye(x.shape[1])).max() < 1e-13
    return e, x


@pytest.mark.parametrize("width", [1, 5, 64, 200])
def test_pairs_of_a_covariance(width):
    r = np.random.default_rng(width)
    b = r.standard_normal((4 * width, width)) * np.linspace(1, 3, width)
    a = b.T @ b
    want = np.linalg.eigvalsh(a)[::-1][:16]
    assert np.allclose(pairs(a, 16)[0], want, rtol=1e-13)


def test_pairs_with_ties_and_low_rank():
    r = np.random.default_rng(2)
    b = r.standard_normal((90, 3))
    e, _ = leading_pairs(lambda u: b @ (b.T @ u), 90, 16)
    assert np.allclose(e[:3], np.linalg.eigvalsh(b.T @ b)[::-1], rtol=1e-12) and np.abs(e[3:]).max() < 1e-12 * e[0]
    assert np.allclose(pairs(np.diag(np.r_[np.full(50, 5.0), np.ones(150)]), 16)[0], 5.0)
    assert np.allclose(pairs(np.diag(10.0 ** -np.arange(100)), 16)[0], 10.0 ** -np.arange(16.0), rtol=1e-13, atol=1e-15)


def test_minres_solves_what_is_left():
    r = np.random.default_rng(4)
    a = np.diag(np.linspace(1, 4, 30))
    q = np.eye(30)[:, -2:]
    rhs = r.standard_normal((30, 3))
    theta = np.array([4.5, 5.0, -1.0])
    t = minres_block(lambda u: a @ u, q, theta, rhs, 60)
    off = rhs - q @ (q.T @ rhs)
    assert np.abs(q.T @ t).max() < 1e-12
    assert np.abs(a @ t - t * theta - off).max() < 1e-9


def plain(vectors, k=16):
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = fit - s / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:k], v[:, ::-1][:, :k]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ v / np.sqrt(e), e / np.trace(c.T @ c / n)


def test_query_columns_against_numpy(spark):
    r = np.random.default_rng(9)
    vectors = (r.standard_normal((300, 24)) * np.linspace(0.3, 1.5, 24)).astype(np.float32)
    rows = [(i, v.tolist(), "x") for i, v in enumerate(vectors)] + [(1000 + i, vectors[7].tolist(), "copy") for i in range(150)]
    bad = [(2000, None, ""), (2001, [1.0, None] + [0.0] * 22, ""), (2002, [float("nan")] * 24, ""), (2003, [float("inf")] + [0.0] * 23, ""), (2004, [], ""), (2005, [1.0], "")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, deviation string").repartition(5)
    out, model = W.whiten(df)
    n, deviation, whitened, explained = plain([v for _, v, _ in rows])
    got = {row["vec_id"]: row for row in out.collect()}
    assert model.n == n and sorted(got) == [k for k, _, _ in rows]
    assert [got[k]["deviation"] for k, _, _ in rows] == deviation.tolist()
    mine = np.array([got[k]["whitened"] for k, _, _ in rows])
    signs = np.sign((mine * whitened).sum(axis=0))
    assert np.abs(mine * signs - whitened).max() < 1e-9
    assert np.allclose(model.explained, explained, rtol=1e-10) and model.identity_error < 1e-12


def test_few_points_and_null_keys(spark):
    df = spark.createDataFrame([(None, [0.5, 1.0]), (1, [1.5, 1.0]), (1, [1.5, 1.0])], "vec_id long, embedding array<double>")
    out, model = W.whiten(df)
    rows = sorted(out.collect(), key=str)
    assert model.n == 2 and len(model.values) == 1
    assert sorted(round(abs(r["whitened"][0]), 12) for r in rows) == [1.0, 1.0, 1.0]
    assert [r["deviation"] for r in rows] == [64 * 64] * 3
    one, model = W.whiten(df.where("vec_id = 1"))
    assert [r["whitened"] for r in one.collect()] == [[], []] and model.n == 1
    none, model = W.whiten(df.limit(0))
    assert none.collect() == [] and model is None


def test_exact_deviation_of_large_entries(spark):
    df = spark.createDataFrame([(0, [3e4]), (1, [-3e4]), (2, [1e30])], "vec_id long, embedding array<double>")
    out, model = W.whiten(df)
    x = [64 * 30_000 + 10**6, -64 * 30_000 + 10**6, 2**40 + 10**6]
    want = [(3 * v - sum(x)) ** 2 for v in x]
    assert [r["deviation"] for r in out.orderBy("vec_id").collect()] == [v if v < 2**63 else None for v in want]
