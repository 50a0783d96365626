"""Histogram boosting against a plain NumPy twin, split by split, and against one-versus-rest boosting."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from prepkit.plans import boosting
from prepkit.plans.boosting import BoostConfig, boost_predict, fit_boosting


@pytest.fixture(autouse=True)
def few_tasks(monkeypatch):
    monkeypatch.setattr(boosting, "GATHERED", 2)


def _rows(n, seed, classes=3, missing=0.2):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 4))
    x[:, 2] = rng.integers(0, 5, n)
    margin = np.column_stack([np.sin(2 * x[:, 0]) + 0.5 * x[:, 1], x[:, 0] ** 2 - 1, 0.6 * x[:, 2] - 1 - x[:, 1]])[:, :classes]
    gone = rng.random(n) < missing
    margin[gone, 0] += 1.5
    x[gone, 0] = math.nan  # missing values tell something
    label = (margin + rng.gumbel(size=margin.shape) * 0.5).argmax(axis=1)
    return x, label


def _frame(spark, x, label, parts=3):
    rows = [(i, *map(float, r), float(y)) for i, (r, y) in enumerate(zip(x, label, strict=True))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, d double, y double").repartition(parts)


class Twin:
    """The same trees by loops over rows, without histograms of siblings, tasks or tables."""

    def __init__(self, x, y, task, classes, cuts, cfg):
        self.x, self.y, self.task, self.cfg, self.cuts = x, y, task, cfg, cuts
        n = len(y)
        if task == "regression":
            self.m = np.full((n, 1), y.mean())
        elif task == "binary":
            self.m = np.full((n, 1), math.log(y.mean() / (1 - y.mean())))
        else:
            self.m = np.tile(np.log([max((y == k).sum(), 1e-6) / n for k in range(classes)]), (n, 1))

    def slopes(self):
        if self.task == "regression":
            return self.m - self.y[:, None], np.ones_like(self.m)
        if self.task == "binary":
            p = 1 / (1 + np.exp(-self.m))
            return p - self.y[:, None], p * (1 - p)
        p = np.exp(self.m) / np.exp(self.m).sum(axis=1, keepdims=True)
        return p - (self.y[:, None] == np.arange(p.shape[1])), p * (1 - p)

    def split(self, rows, g, h):
        score = lambda r: g[r].sum() ** 2 / (h[r].sum() + self.cfg.ridge)
        best = None
        for c in range(self.x.shape[1]):
            v = self.x[rows, c]
            for cut in self.cuts[c]:
                for missing_left in (True, False):
                    goes = np.where(np.isnan(v), missing_left, v <= cut)
                    left, right = rows[goes], rows[~goes]
                    if not len(left) or not len(right) or min(h[left].sum(), h[right].sum()) < self.cfg.least_hessian:
                        continue
                    gain = 0.5 * (score(left) + score(right) - score(rows))
                    if gain > self.cfg.least_gain and (best is None or gain > best[0] + 1e-9):
                        best = (gain, c, cut, left, right)
        return best

    def round(self):
        """For each class: {path: (gain, column, cut)} and {path: value}."""
        g, h = self.slopes()
        out = []
        for k in range(self.m.shape[1]):
            splits, values, todo = {}, {}, [("", np.arange(len(self.y)))]
            for path, rows in todo:
                values[path] = -self.cfg.rate * g[rows, k].sum() / (h[rows, k].sum() + self.cfg.ridge)
                best = self.split(rows, g[:, k], h[:, k]) if len(path) < self.cfg.depth else None
                if best:
                    splits[path] = best[:3]
                    todo += [(path + "l", best[3]), (path + "r", best[4])]
                else:
                    self.m[rows, k] += values[path]
            out.append((splits, values))
        return out


def _paths(model, tree):
    splits, values, todo = {}, {}, [("", 0)]
    for path, node in todo:
        values[path] = float(tree.value[node])
        c = int(tree.column[node])
        if c >= 0:
            splits[path] = (float(tree.gain[node]), c, model.cuts[c][int(tree.cut[node]) - 1])
            todo += [(path + "l", int(tree.left[node])), (path + "r", int(tree.right[node]))]
    return splits, values


@pytest.mark.parametrize(("task", "cells"), [("classes", 1 << 21), ("classes", 60), ("binary", 1 << 21), ("regression", 1 << 21)])
def test_trees_equal_those_of_a_plain_twin(spark, monkeypatch, task, cells):
    monkeypatch.setattr(boosting, "CELLS", cells)
    x, label = _rows(500, 3, 2 if task == "binary" else 3)
    y = x[:, 1] * 2 + np.nan_to_num(x[:, 0]) ** 2 if task == "regression" else label.astype(float)
    cfg = BoostConfig(rounds=3, depth=3, bins=12, refresh=2, least_hessian=1.5)
    model = fit_boosting(_frame(spark, x, y), ["a", "b", "c", "d"], "y", task, cfg)
    assert model.cuts[2] == [0.0, 1.0, 2.0, 3.0] and all(len(c) <= 12 for c in model.cuts)
    twin = Twin(x, y, task, 3, model.cuts, cfg)
    for trees in model.rounds:
        for tree, (splits, values) in zip(trees, twin.round(), strict=True):
            got_splits, got_values = _paths(model, tree)
            assert got_splits.keys() == splits.keys() and got_values.keys() == values.keys()
            for path, (gain, column, cut) in splits.items():
                assert got_splits[path][1:] == (column, cut) and got_splits[path][0] == pytest.approx(gain, rel=1e-7), path
            assert all(got_values[p] == pytest.approx(v, rel=1e-7, abs=1e-10) for p, v in values.items())
    p = model.probabilities(model.margins(model.binned(list(x.T))))
    assert np.allclose(model.margins(model.binned(list(x.T))), twin.m, atol=1e-8)
    if task != "regression":
        assert np.allclose(p.sum(axis=1), 1)


def test_better_log_loss_than_one_versus_rest(spark):
    x, label = _rows(3000, 5, missing=0.0)
    df = _frame(spark, x, label, 4)
    train, test = df.where("id % 4 <> 0"), df.where("id % 4 = 0")
    model = fit_boosting(train, ["a", "b", "c", "d"], "y", "classes", BoostConfig(rounds=8, depth=3))
    out = boost_predict(model, test).collect()
    ours = -np.mean([math.log(max(r["probability"][int(r["y"])], 1e-12)) for r in out])
    assembled = VectorAssembler(inputCols=["a", "b", "c", "d"], outputCol="features")
    each = []
    for k in range(3):
        one = assembled.transform(train.withColumn("own", (F.col("y") == k).cast("double")))
        fitted = GBTClassifier(labelCol="own", maxIter=8, maxDepth=3, seed=1).fit(one)
        each.append({r["id"]: float(r["probability"][1]) for r in fitted.transform(assembled.transform(test)).select("id", "probability").collect()})
    theirs = -np.mean([math.log(max(each[int(r["y"])][r["id"]] / sum(e[r["id"]] for e in each), 1e-12)) for r in out])
    assert ours < theirs and np.mean([r["prediction"] == r["y"] for r in out]) > 0.6


def test_missing_values_find_their_side(spark):
    rows = [(float(i % 10) if i % 3 else None, float(i % 3 == 0 or i % 10 > 6)) for i in range(600)]
    df = spark.createDataFrame(rows, "a double, y double")
    model = fit_boosting(df, ["a"], "y", "binary", BoostConfig(rounds=6, depth=2, rate=0.5))
    out = boost_predict(model, df).collect()
    assert all(r["prediction"] == r["y"] for r in out)
    nan = boost_predict(model, df.withColumn("a", F.lit(math.nan))).first()
    assert nan["prediction"] == 1 and nan["probability"][1] > 0.8


def test_odd_tables(spark):
    df = spark.createDataFrame([(1.0, None, 2.0, "x"), (2.0, None, None, "y"), (None, None, 3.0, "z")], "a double, none double, y double, probability string")
    model = fit_boosting(df, ["a", "none"], "y", "regression", BoostConfig(rounds=2, least_hessian=0.5))
    out = boost_predict(model, df).collect()
    assert len(out) == 3 and all(math.isfinite(r["prediction"]) for r in out)
    one = fit_boosting(df.withColumn("k", F.lit(0.0)), ["a"], "k", "classes")
    assert [r["probability"] for r in boost_predict(one, df).collect()] == [[1.0]] * 3
    with pytest.raises(ValueError, match="labelled"):
        fit_boosting(df.where("false"), ["a"], "y", "regression")
    with pytest.raises(ValueError, match="bins"):
        BoostConfig(bins=300)


def test_values_beyond_the_cuts_and_split_table(spark):
    df = spark.range(200).selectExpr("CAST(id AS double) AS a", "CAST(id >= 120 AS double) AS y")
    model = fit_boosting(df, ["a"], "y", "binary", BoostConfig(rounds=1, depth=1, bins=200))
    (root, *_) = boosting.split_table(model, spark).orderBy("node").collect()
    assert (root["column"], root["cut"]) == ("a", 119.0) and model.split_text(model.rounds[0][0], 0) == "a <= 119.0"
    far = spark.createDataFrame([(-1e300,), (math.inf,)], "a double")
    assert [r["prediction"] for r in boost_predict(model, far).orderBy("a").collect()] == [0, 1]


def test_rows_as_arrow_buffers():
    """Matrices become columns and back, also of a slice, without an object a row."""
    x, m = np.arange(12, dtype=np.uint8).reshape(6, 2), np.arange(18, dtype=float).reshape(6, 3)
    assert boosting._binaries(x[::-1]).to_pylist() == [bytes(r) for r in x[::-1]] and boosting._lists(m[:, :2]).to_pylist() == m[:, :2].tolist()
    batch = pa.RecordBatch.from_arrays([boosting._binaries(x), pa.array(m[:, 0]), boosting._lists(m)], names=["bins", "label", "margins"])
    for own, at in ((batch, slice(0, 6)), (batch.slice(2, 3), slice(2, 5)), (batch.slice(6), slice(6, 6))):
        bins, label, margins = boosting._matrix(own, 2) if own.num_rows else (x[at], m[at, 0], m[at])
        assert (bins == x[at]).all() and (label == m[at, 0]).all() and (margins == m[at]).all()
