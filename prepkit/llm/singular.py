"""Singular values and right singular vectors of a small square matrix by its bidiagonal form.

Householder reflections bring the matrix to an upper bidiagonal one; dqds (differential quotient-difference with
shifts) finds its singular values to high relative accuracy; twisted factorisations of B'B - x I give the vectors.
Values closer than ``GAP`` (relative) are a cluster: its vectors span the right space and are parted by Rayleigh's
quotients; where they are nearly the same (values equal to rounding), inverse iteration of a whole block comes first.
"""

from __future__ import annotations

import numpy as np

_EPS = float(np.finfo(float).eps)
_TINY = float(np.finfo(float).tiny) * 2**60
GAP = 1e-5


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and W of r = U B W' with upper bidiagonal B."""
    a = np.array(r, float)
    n = a.shape[1]
    w = np.eye(n)

    def reflector(x: np.ndarray) -> np.ndarray | None:
        """v of I - 2 v v' that turns x to a multiple of the first unit vector."""
        top = np.abs(x).max(initial=0.0)
        if top == 0 or not np.abs(x[1:]).max(initial=0.0):
            return None
        v = x / top
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        return v / np.linalg.norm(v)

    for k in range(n):
        if (v := reflector(a[k:, k])) is not None:
            a[k:, k:] -= 2 * np.outer(v, v @ a[k:, k:])
        if k + 2 < n and (v := reflector(a[k, k + 1 :])) is not None:
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ v, v)
            w[:, k + 1 :] -= 2 * np.outer(w[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), w


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]] | None:
    """One dqds transformation and its d's; None where the shift was too large."""
    d = q[0] - shift
    qs, es, ds = [], [], [d]
    for i in range(len(e)):
        if d < 0:
            return None
        top = d + e[i]
        if top <= _TINY:
            t = 0.0 if e[i] == 0 else q[i + 1] / _TINY
            top = max(top, 0.0)
        else:
            t = q[i + 1] / top
        qs.append(top)
        es.append(e[i] * t)
        d = d * t - shift if top > _TINY else q[i + 1] - shift
        ds.append(d)
    if d < 0 or not np.isfinite(d):
        return None
    return [*qs, d], es, ds


def _lowest(ds: list[float]) -> float:
    """A lower bound of the least eigenvalue from the d's of a transformation without shift: 1 / trace of the inverse."""
    least = min(ds)
    return 0.0 if least <= _TINY else least / sum(least / d for d in ds)


def squared_singular_values(diagonal: np.ndarray, superdiagonal: np.ndarray) -> np.ndarray:
    """Squares of the singular values of an upper bidiagonal matrix, falling.

    The shift is the Newton bound from a transformation without shift, which never passes the least value, so that
    the values come up one by one from below and each sum of shifts keeps its relative accuracy.
    """
    scale = float(max(np.abs(diagonal).max(initial=0.0), np.abs(superdiagonal).max(initial=0.0)))
    if scale == 0:
        return np.zeros(len(diagonal))
    found: list[float] = []
    todo = [(((diagonal / scale) ** 2).tolist(), ((superdiagonal / scale) ** 2).tolist(), 0.0)]
    while todo:
        q, e, base = todo.pop()
        while True:
            if len(q) == 1:
                found.append(q[0] + base)
                break
            small = _EPS * _EPS
            cut = next((i for i in range(len(e) - 1, -1, -1) if e[i] <= small * max(q[i], q[i + 1], base) or e[i] <= _TINY), None)
            if cut is not None:
                todo.append((q[: cut + 1], e[:cut], base))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if q[0] < q[-1]:
                q, e = q[::-1], e[::-1]  # small ones are found soonest at the end
            plain = _sweep(q, e, 0.0)
            q, e, shift = plain[0], plain[1], _lowest(plain[2]) * (1 - 8 * _EPS)
            while shift > _EPS * base * 1e-3 and shift > _TINY:
                if (moved := _sweep(q, e, shift)) is not None:
                    q, e, base = moved[0], moved[1], base + shift
                    break
                shift /= 4
    return np.sort(np.array(found))[::-1] * scale * scale


def _twisted(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """The vector of B'B (B by its diagonals) for an eigenvalue, from the twist where the two factorisations meet best."""
    n = len(a)
    big = max(np.abs(a).max(), np.abs(b).max(initial=0.0))
    guard = _EPS * _EPS * big * big
    pivot = np.where(np.abs(a) < guard / big, guard / big, a) ** 2  # L D L' = B'B
    low = b / np.where(np.abs(a) < guard / big, guard / big, a[:])[:-1]
    s, lower = np.empty(n), np.empty(max(n - 1, 0))
    s[0] = -value
    for i in range(n - 1):
        plus = s[i] + pivot[i]
        plus = plus if abs(plus) > guard else guard
        lower[i] = pivot[i] * low[i] / plus
        s[i + 1] = lower[i] * low[i] * s[i] - value
    p, upper = np.empty(n), np.empty(max(n - 1, 0))
    p[-1] = pivot[-1] - value
    for i in range(n - 2, -1, -1):
        minus = pivot[i] * low[i] ** 2 + p[i + 1]
        minus = minus if abs(minus) > guard else guard
        t = pivot[i] / minus
        upper[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    gamma = s + p + value
    k = int(np.argmin(np.abs(np.where(np.isfinite(gamma), gamma, np.inf))))
    z = np.zeros(n)
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -lower[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -upper[i] * z[i]
    return z / np.linalg.norm(z)


def _cluster(t: np.ndarray, z: np.ndarray, value: float, others: np.ndarray) -> np.ndarray:
    """Orthonormal vectors of a cluster, falling."""
    n, m = z.shape
    if np.linalg.svd(z, compute_uv=False)[-1] < 1e-2:
        z = z + 1e-1 * np.random.default_rng(m).standard_normal((n, m))
        moved = t - (value * (1 + 4 * _EPS) + _EPS * np.abs(t).max()) * np.eye(n)
        for _ in range(4):
            z = z - others @ (others.T @ z)
            z = np.linalg.solve(moved, np.linalg.qr(z)[0])
            z /= np.abs(z).max(axis=0)
    z = np.linalg.qr(z - others @ (others.T @ z))[0]
    return z @ np.linalg.eigh(z.T @ t @ z)[1][:, ::-1]


def right_singular(r: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Squared singular values (all, falling), the first ``count`` right singular vectors as columns, and which are sound.

    A vector whose value is zero to rounding is not sound; its column is zero.
    """
    a, b, w = bidiagonal(r)
    n = len(a)
    values = squared_singular_values(a, b)
    count = min(count, n)
    z = np.zeros((n, count))
    sound = values[:count] > (4 * n * _EPS) ** 2 * values[0] if n and values[0] > 0 else np.zeros(count, bool)
    t = np.diag(a * a) + np.diag(np.append(0.0, b * b)[:n]) + np.diag(a[:-1] * b, 1) + np.diag(a[:-1] * b, -1)
    start = 0
    while start < count and sound[start]:
        stop = start + 1
        while stop < n and values[stop - 1] - values[stop] <= GAP * values[stop - 1]:
            stop += 1  # the whole cluster, also beyond count
        own = np.column_stack([_twisted(a, b, v) for v in values[start:stop]])
        if stop - start > 1:
            own = _cluster(t, own, float(values[start:stop].mean()), z[:, :start])
        z[:, start : min(stop, count)] = own[:, : count - start]
        start = stop
    return values, w @ z, sound
