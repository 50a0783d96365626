"""Search that learns: densities, draws against random search, median stopping, and fits on Spark."""

import math

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from prepkit.plans import automl as am
from prepkit.plans.parzen import Density, Estimator, Range, optimise

RANGES = {"a": Range(0.0, 1.0), "b": Range(1e-3, 10.0, "log"), "n": Range(3, 10, "int")}


def hill(p, fold=0):
    """A fixed test function: 0 at a = 0.3, b = 0.1, n = 7, less elsewhere."""
    return -((p["a"] - 0.3) ** 2) * 4 - (math.log10(p["b"]) + 1) ** 2 / 4 - (p["n"] - 7) ** 2 / 25


def test_ranges_cover_their_ends():
    assert [Range(3, 10, "int").value(x) for x in (0.0, 0.1249, 0.125, 0.999, 1.0)] == [3, 3, 4, 10, 10]
    assert Range(0.6, 1.0).value(0.5) == 0.8 and Range(5, 5, "int").value(0.7) == 5
    assert math.isclose(Range(0.01, 1.0, "log").value(0.5), 0.1) and math.isclose(Range(0.01, 1.0, "log").value(1.0), 1.0)


def test_densities_integrate_to_one_and_follow_their_draws():
    x = (np.arange(20_000) + 0.5) / 20_000
    for points in ([], [0.5], [0.0, 1.0], [0.2, 0.2, 0.25, 0.9]):
        d = Density(points)
        assert abs(np.exp(d.log(x)).mean() - 1) < 1e-3
        drawn = d.draw(np.random.RandomState(1), 20_000)
        seen = np.histogram(drawn, 10, (0, 1))[0] / len(drawn)
        assert np.abs(seen - np.exp(d.log(x)).reshape(10, -1).mean(axis=1) / 10).max() < 0.015


def test_needs_fewer_fits_than_random_search():
    """Over 20 seeds: random draws needed for the score that 40 learned ones reach."""
    ratio, better = [], 0
    for seed in range(20):
        learned = optimise(Estimator(RANGES, seed), hill, 40, 1)
        best = max(t.score for t in learned)
        rng = np.random.RandomState(seed)
        random = [hill({n: r.value(rng.uniform()) for n, r in RANGES.items()}) for _ in range(400)]
        reached = next((i + 1 for i, x in enumerate(random) if x >= best), 400)
        ratio.append(reached / (1 + next(i for i, t in enumerate(learned) if t.score == best)))
        better += best > max(random[:40])
    assert better >= 14 and np.median(ratio) > 2


def test_same_seed_same_draws():
    one, two, other = (optimise(Estimator(RANGES, s), hill, 25, 1) for s in (5, 5, 6))
    assert one == two and one != other


def test_median_stopping_by_hand():
    given = iter([[3.0, 3.0], [1.0, 5.0], [2.0, 2.0], [2.0, 9.0], [0.0, 9.0], [math.nan, 1.0]])
    rows = []

    def objective(values, fold):
        if fold == 0:
            rows.append(next(given))
        return rows[-1][fold]

    out = optimise(Estimator({"a": Range(0, 1)}, 1), objective, 6, 2, warm=3)
    # the medians after the first fold: of 3, 1, 2 it is 2; of 3, 1, 2, 2 it is 2
    assert [(t.state, t.folds, t.score) for t in out[:5]] == [
        ("done", 2, 3.0), ("done", 2, 3.0), ("done", 2, 2.0), ("done", 2, 5.5), ("stopped", 1, None)]
    assert out[4].running == 0.0 and out[5].state == "stopped"


def test_failures_are_reported_and_avoided():
    def objective(values, fold):
        if values["a"] > 0.5:
            raise ValueError("too far")
        return values["a"]

    e = Estimator({"a": Range(0, 1)}, 2)
    out = optimise(e, objective, 30, 2)
    assert {t.state for t in out if t.values["a"] > 0.5} == {"failed"}
    assert all(t.error == "too far" and t.score is None for t in out if t.state == "failed")
    assert len(e.told) == 30 and sum(t.state == "failed" for t in out[15:]) <= sum(t.state == "failed" for t in out[:15])
    assert optimise(Estimator({"a": Range(0, 1)}), objective, 0, 2) == []


def test_search_on_spark_is_repeatable(spark):
    df = (spark.range(400).withColumn("x", F.rand(3)).withColumn("label", (F.col("x") + F.rand(4) / 4 > 0.6).cast("double"))
          .withColumn("features", array_to_vector(F.array("x", F.rand(5)))).select("id", "label", "features"))

    def run():
        return am.learned_search(df, "id", 2, trials=7, folds=2, rounds=(2, 4), families=["Linear"], oversample=False, startup=2)

    out = run()
    found = sorted(out.collect(), key=lambda r: r.trial)
    assert [r.trial for r in found] == list(range(7)) and {r.family for r in found} == {"Linear"}
    assert {r.state for r in found} <= {"done", "stopped"} and all((r.score is None) == (r.state == "stopped") for r in found)
    assert all(0.001 <= r.params["l2"] <= 10 for r in found) and max(r.score or 0 for r in found) > 0.7
    assert sorted(run().collect(), key=lambda r: r.trial) == found
    assert am.leaderboard(out).first().trials == sum(r.state == "done" for r in found)
