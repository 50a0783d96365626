"""Embedding whitening against dense NumPy solvers, and its odd rows."""

import math

import numpy as np
import pytest

from prepkit.llm import whitening
from prepkit.llm.common import tuned
from prepkit.llm.singular import bidiagonal, right_singular

RNG = np.random.default_rng(5)
Q = np.linalg.qr(RNG.standard_normal((40, 40)))[0]
MATRICES = {
    "one": np.array([[3.0]]),
    "random": np.triu(RNG.standard_normal((64, 64))),
    "level": np.linalg.qr(RNG.standard_normal((20_000, 48)), mode="r"),
    "falling": np.diag(10.0 ** -np.arange(12)) @ np.triu(RNG.standard_normal((12, 12))),
    "ties": np.diag([3.0, 3, 3, 1, 1, 0]) @ np.linalg.qr(RNG.standard_normal((6, 6)))[0],
    "clusters": np.diag(np.r_[np.full(10, 2.0), 2 + 1e-9 * np.arange(10), 1e-6 * np.ones(20)]) @ Q,
    "identity": np.eye(20),
    "short": np.vstack([RNG.standard_normal((7, 30)), np.zeros((23, 30))]),
    "zero": np.zeros((4, 4)),
}


@pytest.mark.parametrize("name", MATRICES)
def test_singular_values_and_vectors(name):
    r = MATRICES[name]
    values, d, sound = right_singular(r, 16)
    want = np.linalg.svd(r, compute_uv=False) ** 2
    assert np.allclose(values, want, rtol=1e-9, atol=1e-13 * max(want[0], 1e-300))
    kept = d[:, sound]
    first = want[: len(sound)]
    assert sound[first > 1e-24 * want[0]].all() and not sound[first < 1e-31 * want[0]].any() and (want[0] or not sound.any())
    assert np.allclose(kept.T @ kept, np.eye(kept.shape[1]), atol=1e-11)
    assert np.allclose(r.T @ (r @ kept), kept * values[: kept.shape[1]], atol=1e-12 * max(want[0], 1e-300))


def test_bidiagonal_form():
    r = RNG.standard_normal((9, 9))
    a, b, w = bidiagonal(r)
    left = r @ w
    assert np.allclose(w.T @ w, np.eye(9)) and np.allclose(left.T @ left, (np.diag(a) + np.diag(b, 1)).T @ (np.diag(a) + np.diag(b, 1)))


def test_small_values_keep_their_digits():
    """A graded bidiagonal matrix: its values come from the entries with relative accuracy, down to 1e-30."""
    a = 10.0 ** -np.arange(16)
    values, _, _ = right_singular(np.diag(a), 4)
    assert np.allclose(values, a * a, rtol=1e-14)


def _dense(vectors, count=16):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    y = u - u.mean(axis=0)
    e, d = np.linalg.eigh(y.T @ y / len(u))
    return x, len(u), u.sum(axis=0), e[::-1][:count], d[:, ::-1][:, :count]


def _frame(spark, rows):
    return tuned(spark).createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


def test_whitening_against_a_dense_solver(spark):
    vectors = (RNG.standard_normal((700, 24)) @ RNG.standard_normal((24, 24))).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    rows += [(1000 + i, vectors[3].tolist(), 0) for i in range(300)]  # copies count once in the fit
    x, n, sums, e, d = _dense([r[1] for r in rows])
    out = whitening.whiten(_frame(spark, rows)).toPandas()
    assert len(out) == 16 * len(rows) and set(out.n) == {n}
    place = {r[0]: i for i, r in enumerate(rows)}
    got = out.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    order = [place[i] for i in sorted(place)]
    want = ((n * x - sums) / n @ d / np.sqrt(e))[order]
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-8)
    assert np.allclose(out.groupby("component").explained.first(), e / (np.linalg.norm(np.unique(x, axis=0) - sums / n) ** 2 / n), rtol=1e-10)
    deviation = out.groupby("vec_id").deviation.first().to_dict()
    assert all(deviation[r[0]] == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[i], sums, strict=True)) for i, r in enumerate(rows))
    assert out.identity_error.nunique() == 1 and out.identity_error.iloc[0] < 1e-10


def test_odd_vectors(spark):
    rows = [(1, None, 0), (2, [1.0, None], 0), (3, [math.nan, 1.0], 0), (4, [math.inf, 1.0], 0), (5, [1e30, 1.0], 0),
            (6, [1.0, 2.0, 3.0], 0), (6, [1.0, 2.0, 3.0], 0), (7, [5.0], 0), (None, [2.0, 0.5, 3.0], 0), (8, [], 0), (9, [0.0, 0.0, 0.0], 0)]
    df = _frame(spark, rows).selectExpr("*", "1 AS n", "2 AS x", "3 AS id", "4 AS value", "5 AS component", "6 AS whitened")
    out = whitening.whiten(df).collect()
    ids = sorted((r.vec_id is None, r.vec_id or 0, r.component) for r in out)
    assert ids == sorted((i is None, i or 0, c) for i in (6, 6, 7, 8, 9, None) for c in (1, 2, 3))
    assert {r.n for r in out} == {4}  # a shorter vector counts as padded: 8 and 9 are the same
    assert len({(r.component, r.whitened) for r in out if r.vec_id in (8, 9)}) == 3
    assert whitening.whiten(df.where("false")).collect() == [] and whitening.whiten(_frame(spark, [(1, [], 0)])).collect() == []


def test_values_that_do_not_vary(spark):
    one = whitening.whiten(_frame(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect()
    assert len(one) == 4 and all((r.n, r.deviation, r.whitened, r.explained, r.identity_error) == (1, 0, None, None, None) for r in one)
    two = whitening.whiten(_frame(spark, [(i, [float(i), 7.0], 0) for i in range(5)])).collect()
    assert all((r.whitened is None) == (r.component == 2) and r.identity_error < 1e-12 for r in two)
    assert {round(r.explained, 12) for r in two} == {0.0, 1.0}


def test_large_components_stay_exact(spark):
    rows = [(1, [1e15], 0), (2, [-1e15], 0), (3, [3.0], 0)]
    got = {r.vec_id: r for r in whitening.whiten(_frame(spark, rows)).collect()}
    assert got[1].deviation is None and got[1].n == 3  # beyond a long
    x = [math.floor(64 * np.float64(np.float32(v[0]))) + 1_000_000 for _, v, _ in rows]
    assert got[3].deviation == (3 * x[2] - sum(x)) ** 2 and got[3].identity_error < 1e-10
