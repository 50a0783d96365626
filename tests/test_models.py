import tracemalloc

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prepkit.functions.sizing import spread
from prepkit.operators import metrics as mt
from prepkit.operators import scoring as sc
from prepkit.operators import splits as sp
from prepkit.plans import attribution as at
from prepkit.plans import automl as am
from tests.conftest import rows


def brute(y, s):
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    ap, last = 0.0, 0.0
    for t in np.unique(s)[::-1]:
        said = s >= t
        recall = (y[said] == 1).sum() / len(pos)
        ap += (recall - last) * (y[said] == 1).mean()
        last = recall
    return auc, ap


@pytest.mark.parametrize("levels", [1, 3, 1000])
def test_curves_with_ties(scaled, spark, levels):
    rng = np.random.RandomState(levels)
    y, s = rng.randint(0, 2, 500), rng.randint(0, levels, 500) / levels
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    for _ in range(2):
        r = mt.binary_metrics(df, "y", "s").first()
        assert (r["roc_auc"], r["pr_auc"]) == pytest.approx(brute(y, s))
        scaled.conf.unset("spark.prepkit.rangeRows")


def test_one_class_has_no_area(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.7)], "y int, s double")
    assert mt.binary_metrics(df, "y", "s").first()["roc_auc"] is None


def test_threshold_first_strict_maximum(spark):
    rng = np.random.RandomState(0)
    y, s = rng.randint(0, 2, 400), rng.rand(400).round(2)
    cuts = np.unique(np.quantile(s, np.linspace(.05, .95, 37)))
    best, score = 0.5, -np.inf
    for t in cuts:
        p = s >= t
        f1 = 2 * (p & (y == 1)).sum() / max((p.sum() + (y == 1).sum()), 1)
        if f1 > score:
            best, score = t, f1
    r = mt.best_threshold(spark.createDataFrame(pd.DataFrame({"y": y, "s": s})), "y", "s").first()
    assert (r["threshold"], r["score"]) == pytest.approx((best, score))


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_split_and_folds_do_not_depend_on_partitions(spark, table, parts):
    c = table("customer")
    want = rows(sp.stratified_split(c, ["c_custkey"], "c_mktsegment").select("c_custkey", "is_test"), "c_custkey")
    assert rows(sp.stratified_split(c.repartition(parts), ["c_custkey"], "c_mktsegment").select("c_custkey", "is_test"), "c_custkey") == want
    sizes = [r["count"] for r in sp.fold_assign(c.repartition(parts), ["c_custkey"]).groupBy("fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1


def test_large_split_equals_small(scaled, table):
    c = table("customer")
    large = rows(sp.stratified_split(c, ["c_custkey"], "c_mktsegment").select("c_custkey", "is_test"), "c_custkey")
    scaled.conf.unset("spark.prepkit.rangeRows")
    assert rows(sp.stratified_split(c, ["c_custkey"], "c_mktsegment").select("c_custkey", "is_test"), "c_custkey") == large


@pytest.mark.parametrize("pivots", [1, 9])
def test_neighbours_equal_brute_force(spark, pivots):
    v = np.random.RandomState(2).randint(0, 6, (300, 3)).astype(float)  # many copies
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id bigint, v array<double>")
    got = sp.nearest_neighbours(df, "id", "v", 4, pivots).orderBy("id", "rank").toPandas()
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    assert (got["neighbour"].values == np.argsort(d, 1, kind="stable")[:, :4].ravel()).all()


def test_oversample_balances_inside_class(spark):
    data = [(i, i % 10 == 0, [float(i), 1.0]) for i in range(100)] + [(200, None, [0.0, 0.0])]
    df = spark.createDataFrame(data, "id bigint, y boolean, v array<double>")
    out = sp.oversample_minority(df, "id", "y", "v")
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {True: 90, False: 90, None: 90}
    made = out.filter("id IS NULL AND y").toPandas()["v"]
    assert all(0 <= a[0] <= 90 and a[1] == 1.0 for a in made)
    assert len({a[0] for a in made}) > 40


def test_chunks(scaled, spark):
    df = spark.range(23).withColumn("p", F.col("id") * 1.0)
    for k in (1, 5, 30):
        want = [(i, len(x), [float(a) for a in x[:5]]) for i, x in enumerate(np.array_split(np.arange(23), k))]
        assert rows(sc.predict_chunks(df, "p", ["id"], k), "chunk") == want
    with pytest.raises(ValueError):
        sc.validate_features(df, ["id"])


def test_blend_rules(spark):
    trials = spark.createDataFrame([("a", 0.9), ("a", 0.7), ("b", 0.6), ("c", 0.5), ("d", 0.1), ("e", None)], "family string, score double")
    board = am.leaderboard(trials)
    assert [r["family"] for r in board.collect()] == ["a", "b", "c", "d"]
    w = {r["family"]: r["weight"] for r in am.blend_weights(board).collect()}
    assert w == pytest.approx({"a": 0.8 / 1.9, "b": 0.6 / 1.9, "c": 0.5 / 1.9})


def test_unknown_category_is_all_zeros(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (5.0, "a")], "x double, c string")
    pre = am.build_preprocessor(df, ["x", "c"]).fit(df)
    out = pre.transform(spark.createDataFrame([(2.0, "zzz"), (2.0, "b")], "x double, c string"))
    got = [r[0] for r in out.select(am.vector_to_array("features")).collect()]
    assert got[0][1:] == [0.0, 0.0] and got[1][1:] == [0.0, 1.0]
    assert got[0][0] == pytest.approx(2 / np.std([1, 3, 5]))
    assert am.feature_names(pre, ["x"]) == ["x", "c_a", "c_b"]


def test_baseline_learns(spark):
    rng = np.random.RandomState(0)
    x = rng.rand(600)
    pdf = pd.DataFrame({"id": range(600), "x": x, "noise": rng.rand(600), "y": np.where(x + rng.normal(0, .1, 600) > .5, "yes", "no")})
    r = am.train_baseline(spark.createDataFrame(pdf), "y", ["id"], trees=5, families=["RandomForest", "Linear"])
    assert r.problem_type == "classification" and r.metrics["f1"] > 0.8 and r.metrics["roc_auc"] > 0.9
    assert r.predictions.count() == sum(-(-n // 5) for n in pdf["y"].value_counts())
    assert {v[0] for v in r.predictions.select("y_pred").distinct().collect()} <= {"yes", "no"}


def test_fusion_and_shapley(spark):
    rng = np.random.RandomState(0)
    pdf = pd.DataFrame({"id": range(300), "a": rng.rand(300), "b": rng.rand(300)})
    pdf["y"] = 3 * pdf["a"] - 2 * pdf["b"]
    df = spark.createDataFrame(pdf)
    r = am.train_fusion(df, "y", "id", trials=1, folds=2, rounds=(3, 5), final_trees=5)
    assert r.problem_type == "regression" and sum(r.blend_weights.values()) == pytest.approx(1)
    assert mt.regression_metrics(r.predict(df), "y", "prediction").first()["r2"] > 0.8
    line = am.Pipeline(stages=[*am.build_preprocessor(df, ["a", "b"]).getStages(), am.LinearRegression(labelCol="y")]).fit(df)
    got = at.shapley_values(line, df, ["a", "b"], "id", 10, 7)
    _, back = at.attribution_sample(df, ["id"], 10, 7)
    want = at.linear_attribution(df, "id", {"a": 3.0, "b": -2.0}, back).withColumnRenamed("contribution", "w")
    both = got.join(want, ["id", "feature"]).toPandas()
    assert len(both) == 20 and np.allclose(both["contribution"], both["w"], atol=1e-6)


def test_fusion_of_a_target_that_nothing_tells(spark):
    rng = np.random.RandomState(1)
    df = spark.createDataFrame(pd.DataFrame({"id": range(200), "a": rng.rand(200), "y": rng.rand(200)}))
    r = am.train_fusion(df, "y", "id", trials=1, folds=2, rounds=(3, 5), final_trees=3)
    assert all(score <= 0 for _, score in r.leaderboard) and r.blend_weights == {r.leaderboard[0][0]: 1.0}
    assert r.predict(df).where("prediction IS NOT NULL").count() == 200


def test_members_below_the_mean_do_not_vote():
    got = am.member_weights([("A", 0.6), ("B", 0.2), ("C", -0.1)])
    assert got == {"A": pytest.approx(0.75), "B": pytest.approx(0.25)}


def test_nearest_points_of_blocks():
    """Against all differences: copies, far and missing numbers, own ids, fewer points than k; within bounded memory."""
    rng = np.random.RandomState(3)
    t = rng.rand(3000, 6).round(1)
    t[:200] = t[0]
    t[5, 2], t[6, 1], t[7] = np.nan, np.inf, 1e180
    t[100:110] += 1e6
    ti = rng.permutation(3000)
    for n in (3000, 40, 3):
        got = sp.k_nearest(ti[:400], t[:400], ti[:n], t[:n], 5)
        want = []
        for i in range(400):
            with np.errstate(invalid="ignore", over="ignore"):
                d = np.sqrt(((t[i] - t[:n]) ** 2).sum(-1))
            d[ti[:n] == ti[i]] = np.inf
            by = np.lexsort((ti[:n], d))[:5]
            want += [(ti[i], ti[j], d[j]) for j in by if np.isfinite(d[j])]
        assert sorted(zip(*got)) == sorted(want)
    q = rng.rand(4096, 64)
    tracemalloc.start()
    sp.k_nearest(np.arange(4096), q, np.arange(4096), q, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # all differences of 512 points with these are 1,074 MB


def test_only_the_first_copies_are_compared():
    """Copies beyond the k-th and one for the point itself can't be near first."""
    t = np.array([[0.0, 1.0], [2.0, 3.0], [-0.0, 1.0]])[np.arange(9000) % 3]
    assert sorted(sp._first_copies(t, 6)) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 13, 16]
    got = sp.k_nearest(np.arange(9000), t, np.arange(9000), t, 2)
    assert len(got[0]) == 18000 and not got[2].any() and set(got[1]) == {0, 2, 3, 1, 4, 7}


def test_rows_of_fits_are_spread(spark, tmp_path):
    """One partition of many rows becomes several, many of few rows become one; a search fits on them."""
    assert spread(spark.range(0, 100_000, 1, 1), 100_000, "id").rdd.getNumPartitions() == 5
    assert spread(spark.range(0, 100, 1, 64), 100, "id").rdd.getNumPartitions() == 1
    assert spread(spark.range(1), 5_000_000).rdd.getNumPartitions() == 16
    assert spread(spark.range(1), 50_000_000).rdd.getNumPartitions() == 100
    seen = []

    class Watch(am.LinearRegression):
        def _fit(self, dataset):
            seen.append(dataset.rdd.getNumPartitions())
            return super()._fit(dataset)

    data = spark.range(0, 60_000, 1, 1).selectExpr("id", "id % 7 + 0.5D AS label", "array(id % 7 * 1.0D) AS f")
    data = data.select("id", "label", am.array_to_vector("f").alias("features"))
    drawn, am.draw_candidates = am.draw_candidates, lambda *_: {"Linear": Watch()}
    try:
        assert am.search(data, "id", 0, trials=1, folds=2).first()["score"] > 0.99
    finally:
        am.draw_candidates = drawn
    assert seen == [3, 3]
