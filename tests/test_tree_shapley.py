"""Exact tree attributions against brute force over all subsets of columns."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from prepkit.plans import automl as am
from prepkit.plans.attribution import attribution_sample
from prepkit.plans.tree_shapley import tree_shapley_values

FEATURES = ["a", "b", "c", "unused"]


def _brute(value, x, z):
    """value(rows) of mixtures: Shapley values of each row of x by its definition."""
    d = len(FEATURES)
    sets = [s for k in range(d + 1) for s in combinations(range(d), k)]
    mixed = [[xi[i] if i in s else zj[i] for i in range(d)] for xi in x for s in sets for zj in z]
    v = value(mixed).reshape(len(x), len(sets), len(z)).mean(axis=2)
    out = np.zeros((len(x), d))
    for i in range(d):
        for k, s in enumerate(sets):
            if i not in s:
                w = factorial(len(s)) * factorial(d - len(s) - 1) / factorial(d)
                out[:, i] += w * (v[:, sets.index(tuple(sorted((*s, i))))] - v[:, k])
    return out, v[:, 0], v[:, -1]


@pytest.mark.parametrize("estimator, output", [
    (lambda: RandomForestRegressor(labelCol="y", numTrees=4, maxDepth=4, seed=1), "prediction"),
    (lambda: GBTRegressor(labelCol="y", maxIter=3, maxDepth=3, seed=1), "prediction"),
    (lambda: RandomForestClassifier(labelCol="label", numTrees=4, maxDepth=4, seed=1), "probability"),
    (lambda: DecisionTreeClassifier(labelCol="label", maxDepth=5, seed=1), "probability"),
    (lambda: GBTClassifier(labelCol="label", maxIter=3, maxDepth=3, seed=1), "rawPrediction"),
])
def test_exact(spark, estimator, output):
    rng = np.random.RandomState(0)
    pdf = pd.DataFrame({"id": range(200), "a": rng.rand(200), "b": rng.rand(200).round(1), "c": rng.choice(["u", "v", "w"], 200), "unused": 1.0})
    pdf["y"] = 3 * pdf["a"] * pdf["b"] - 2 * (pdf["c"] == "v") * pdf["a"]
    pdf["label"] = (pdf["y"] > pdf["y"].median()).astype(float)
    df = spark.createDataFrame(pdf).coalesce(2)
    pre = am.build_preprocessor(df, FEATURES)
    model = am.Pipeline(stages=[*pre.getStages(), estimator()]).fit(df)
    got = tree_shapley_values(model, df, FEATURES, "id", max_samples=5, max_background=7).toPandas()
    asked, back = attribution_sample(df, ["id"], 5, 7)
    asked, back = asked.toPandas().sort_values("id"), back.toPandas()

    def value(rows):
        frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, a double, b double, c string, unused double").coalesce(1)
        scored = model.transform(frame)
        found = F.col("prediction") if output == "prediction" else vector_to_array(output)[1]
        return scored.select("n", found.alias("v")).toPandas().sort_values("n")["v"].to_numpy()

    want, base, whole = _brute(value, asked[FEATURES].values.tolist(), back[FEATURES].values.tolist())
    table = got.pivot(index="id", columns="feature", values="contribution")[FEATURES].to_numpy()
    assert np.abs(table - want).max() < 1e-9 and np.abs(got["base_value"] - base[0]).max() < 1e-9
    assert np.abs(table.sum(axis=1) - (whole - base)).max() < 1e-9
    assert (table[:, 3] == 0).all() and np.abs(table[:, :3]).max() > 0.01
    assert tree_shapley_values(model, df.where("false"), FEATURES, "id").count() == 0


def test_rows_of_one_partition_are_spread(spark):
    df = spark.range(0, 60_000, 1, 1).selectExpr("id", "id % 10 * 1.0D AS a", "id % 10 * 2.0D AS y")
    pre = am.build_preprocessor(df, ["a"])
    model = am.Pipeline(stages=[*pre.getStages(), RandomForestRegressor(labelCol="y", numTrees=1, maxDepth=2, seed=1)]).fit(df)
    got = tree_shapley_values(model, df, ["a"], "id", max_background=3)
    assert got.rdd.getNumPartitions() == 3 and got.count() == 60_000
