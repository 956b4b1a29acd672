"""Eigenvectors of a symmetric matrix: tridiagonal form, divide and conquer, one refinement in extended precision.

The tridiagonal matrix is torn into two halves and a matrix of rank one (Cuppen); the
secular equation gives the eigenvalues of the sum, and vectors are formed from the
update that has exactly these (Gu and Eisenstat), so that they are orthogonal however
close the eigenvalues. The last step (Ogita and Aishima) corrects eigenvectors and values
against the matrix itself, in pairs of doubles.
"""

from __future__ import annotations

import numpy as np

from weft.llm import doubles

EPS = np.finfo(float).eps
#: The largest part of one eigenvector in another that is still corrected.
SMALL_TURN = 1e-6


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(diagonal, off-diagonal, q): q.T @ a @ q is tridiagonal, by Householder reflections."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        size = np.abs(x).max()
        if size == 0 or not np.abs(x[1:]).any():
            continue
        v = x / size
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        own = a[k + 1 :, k + 1 :]
        p = own @ v
        w = p - (v @ p) * v
        own -= 2 * (np.outer(v, w) + np.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ x)
        a[k, k + 1 :] = a[k + 1 :, k]
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def _secular(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z2 / (d - x)), d ascending, as (the nearest d's place, distance from it)."""
    n = len(d)
    right = np.append(d[1:], d[-1] + z2.sum())
    half = (right - d) / 2
    value = 1 + (z2 / ((d - d[:, None]) - half[:, None])).sum(1)  # at the middle of each interval
    pole = np.where((value >= 0) | (np.arange(n) == n - 1), np.arange(n), np.arange(n) + 1)
    low = np.where(pole == np.arange(n), 0.0, -half)
    high = np.where(pole == np.arange(n), half, 0.0)
    high[-1] = z2.sum() * (1 + 4 * EPS)
    delta = d - d[pole][:, None]
    for _ in range(1100):  # as many as doubles have steps; by far fewer are needed
        mid = (low + high) / 2
        if np.all((mid == low) | (mid == high)):
            break
        with np.errstate(divide="ignore"):
            above = 1 + (z2 / (delta - mid[:, None])).sum(1) >= 0
        low, high = np.where(above, low, mid), np.where(above, mid, high)
    return pole, np.where(np.abs(low) > np.abs(high), low, high)


def _update(d: np.ndarray, rho: float, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and vectors of diag(d) + rho * outer(z, z)."""
    n = len(d)
    if rho < 0:
        w, u = _update(-d, -rho, z)
        return -w[::-1], u[:, ::-1]
    order = np.argsort(d, kind="stable")
    d, z = d[order], z[order] * np.sqrt(rho)
    turn = np.eye(n)[:, order]
    tol = 8 * EPS * max(np.abs(d).max(), float(z @ z))
    keep, last = [], None
    for i in range(n):  # deflation: parts without weight, and equal values turned into one
        if abs(z[i]) * max(np.linalg.norm(z), 1e-300) <= tol:
            continue
        if last is not None:
            r = np.hypot(z[last], z[i])
            c, s = z[i] / r, z[last] / r
            if abs((d[i] - d[last]) * c * s) <= tol:
                turn[:, [last, i]] = turn[:, [last, i]] @ np.array([[c, s], [-s, c]])
                d[last], d[i] = c * c * d[last] + s * s * d[i], s * s * d[last] + c * c * d[i]
                z[last], z[i] = 0.0, r
                keep.pop()
        keep.append(i)
        last = i
    w, u = d.copy(), np.eye(n)
    if keep:
        k = np.array(keep)
        dk, zk = d[k], z[k]
        pole, tau = _secular(dk, zk * zk)
        w[k] = dk[pole] + tau
        gap = (dk[pole] - dk[:, None]) + tau  # root j minus d[i]
        m = len(k)
        z2 = gap[:, -1].copy()
        for j in range(m - 1):
            away = np.where(np.arange(m) <= j, dk[j + 1] - dk, dk[j] - dk)
            z2 *= gap[:, j] / away
        own = (np.copysign(np.sqrt(np.abs(z2)), zk)[:, None]) / -gap
        own /= np.linalg.norm(own, axis=0)
        u[np.ix_(k, k)] = own
    order = np.argsort(w, kind="stable")
    return w[order], (turn @ u)[:, order]


def divide(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and vectors of the tridiagonal matrix with diagonal d and off-diagonal e."""
    n = len(d)
    if n <= 1:
        return d.copy(), np.eye(n)
    m, rho = n // 2, float(e[n // 2 - 1])
    upper, lower = d[:m].copy(), d[m:].copy()
    upper[-1] -= rho
    lower[0] -= rho
    (w1, q1), (w2, q2) = divide(upper, e[: m - 1]), divide(lower, e[m:])
    w, z = np.concatenate((w1, w2)), np.concatenate((q1[-1], q2[0]))
    if rho:
        w, u = _update(w, rho, z)
    else:
        order = np.argsort(w, kind="stable")
        w, u = w[order], np.eye(n)[:, order]
    return w, np.concatenate((q1 @ u[:m], q2 @ u[m:]))


def _defect(x: np.ndarray) -> tuple[doubles.Pair, np.ndarray]:
    """(x.T, the identity minus x.T @ x)."""
    xt = doubles.exact(np.ascontiguousarray(x.T))
    g = doubles.product(xt, doubles.exact(x))
    return xt, (np.eye(len(x)) - g[0]) - g[1]


def refine(a: doubles.Pair, x: np.ndarray, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors corrected against a. Vectors whose correction wouldn't be small have equal eigenvalues to double precision; they are only kept orthogonal."""
    for _ in range(rounds):
        xt, r = _defect(x)
        s = doubles.product(xt, doubles.product(a, doubles.exact(x)))
        w = (s[0].diagonal() + s[1].diagonal()) / (1 - r.diagonal())
        off = s[0] - np.diag(s[0].diagonal()) + s[1]
        far = w[None, :] - w[:, None]
        turn = off + w[None, :] * r
        small = np.abs(turn) < SMALL_TURN * np.abs(far)
        step = np.where(small, turn / np.where(small, far, 1.0), r / 2)
        np.fill_diagonal(step, r.diagonal() / 2)
        x = x + x @ step
        if np.abs(step).max(initial=0.0) < 1e-9:  # the next would be below its square
            break
    return w, x + x @ (_defect(x)[1] / 2)


def eigen(a: doubles.Pair) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of the symmetric matrix a."""
    n = len(a[0])
    if not n:
        return np.zeros(0), np.zeros((0, 0))
    size = float(np.abs(a[0]).max()) or 1.0
    unit = 2.0 ** np.floor(np.log2(size))
    a = (a[0] / unit, a[1] / unit)
    d, e, q = tridiagonal(a[0])
    _, u = divide(d, e)
    w, x = refine(a, q @ u)
    order = np.argsort(-w, kind="stable")
    return w[order] * unit, x[:, order]
