"""Leading eigenpairs of a symmetric matrix known only through its products with blocks of vectors.

Jacobi-Davidson: Rayleigh-Ritz on a growing subspace; every wanted pair that is not yet exact asks for the
correction that solves (I - QQ')(A - theta I)(I - QQ') t = -residual, roughly, by a few steps of MINRES. All
corrections of a round advance in step, so each of their steps is one product with one block. Vectors are as
long as the matrix is wide; the matrix itself is never formed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Product = Callable[[np.ndarray], np.ndarray]
EPS = float(np.finfo(float).eps)


def _orthonormal(block: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """What ``block`` adds to ``basis``, as orthonormal columns; directions within rounding of it are left out."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-10]
    room = basis.shape[0] - basis.shape[1]
    return block[:, :room]


def minres_block(product: Product, q: np.ndarray, theta: np.ndarray, rhs: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions t, orthogonal to ``q``, of (A - theta_i I) t_i = rhs_i projected away from ``q``."""

    def off(x: np.ndarray) -> np.ndarray:
        return x - q @ (q.T @ x)

    v = off(rhs)
    beta = np.linalg.norm(v, axis=0)
    live = beta > 0
    v = v / np.where(live, beta, 1.0)
    eta, link = beta.copy(), np.zeros_like(beta)
    v_old = w0 = w1 = np.zeros_like(v)
    c0 = c1 = np.ones_like(beta)
    s0 = s1 = np.zeros_like(beta)
    t = np.zeros_like(v)
    for _ in range(steps):
        av = off(product(v)) - theta * v
        alpha = (v * av).sum(axis=0)
        new = av - alpha * v - link * v_old
        nxt = np.linalg.norm(new, axis=0)
        delta = c1 * alpha - c0 * s1 * link
        rho = np.hypot(delta, nxt)
        live = live & (rho > 0)
        safe = np.where(rho > 0, rho, 1.0)
        w = (v - (s0 * link) * w0 - (s1 * alpha + c0 * c1 * link) * w1) / safe
        c, s = delta / safe, nxt / safe
        t = t + np.where(live, c * eta, 0.0) * w
        eta, w0, w1, c0, c1, s0, s1 = -s * eta, w1, w, c1, c, s1, s
        live = live & (nxt > EPS * np.abs(theta))
        v_old, v, link = v, off(new) / np.where(nxt > 0, nxt, 1.0), nxt
        if not live.any():
            break
    return t


def leading_pairs(
    product: Product, width: int, wanted: int, steps: int = 4, spare: int = 4, most_rounds: int = 200, seed: int = 11
) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors as columns.

    A pair is locked once its residual is at rounding level; locked pairs stay in the subspace but ask for no
    more corrections. Before the end a fresh random block and its products join the subspace, so that a pair
    the start happened to miss would still surface.
    """
    rng = np.random.default_rng(seed)
    wanted = min(wanted, width)
    most_columns = min(width, max(8 * wanted, 40))
    q = _orthonormal(product(rng.standard_normal((width, min(width, wanted + spare)))), np.zeros((width, 0)))
    if q.shape[1] < wanted:  # the matrix has lower rank than asked for: any directions complete the start
        q = np.hstack([q, _orthonormal(rng.standard_normal((width, wanted + spare)), q)])
    aq = product(q)
    confirmed = False
    for _ in range(most_rounds):
        h = q.T @ aq
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        x, ax = q @ y[:, :wanted], aq @ y[:, :wanted]
        residual = ax - x * theta[:wanted]
        norm = max(abs(theta[0]), abs(theta[-1]))
        open_ = np.linalg.norm(residual, axis=0) > 4 * EPS * np.sqrt(width) * norm
        full = q.shape[1] == width
        if full or (confirmed and not open_.any()):
            return theta[:wanted], x
        if q.shape[1] + 2 * wanted > most_columns < width:  # restart from the best Ritz vectors
            kept = y[:, : 2 * wanted]
            q, aq = q @ kept, aq @ kept
            q, r = np.linalg.qr(q)
            aq = np.linalg.solve(r.T, aq.T).T
        if open_.any():
            new = minres_block(product, x, theta[:wanted][open_], -residual[:, open_], steps)
            confirmed = False
        else:
            new = rng.standard_normal((width, spare))
            new = np.hstack([new, product(new - q @ (q.T @ new))])
            confirmed = True
        new = _orthonormal(new, q)
        if not new.shape[1]:
            new = _orthonormal(rng.standard_normal((width, spare)), q)
        q, aq = np.hstack([q, new]), np.hstack([aq, product(new)])
    raise RuntimeError(f"eigenpairs not at rounding level after {most_rounds} rounds")
