"""The registered queries ask for the whole job of their operators; a search fits every draw on every fold."""

import inspect

import pytest

from checks import models
from prepkit.plans import automl as am
from tests.conftest import DATA


class Asked(Exception):
    pass


def arguments(spark, monkeypatch, query, name):
    """What the query hands to the operator, its defaults filled in."""
    signature = inspect.signature(getattr(am, name))

    def stop(*args, **kw):
        bound = signature.bind(*args, **kw)
        bound.apply_defaults()
        raise Asked(bound.arguments)

    monkeypatch.setattr(am, name, stop)
    with pytest.raises(Asked) as asked:
        query(spark, DATA)
    return asked.value.args[0]


def test_search_query_asks_for_all_draws_folds_and_rounds(spark, monkeypatch):
    got = arguments(spark, monkeypatch, models.search, "search")
    assert (got["trials"], got["folds"], got["rounds"]) == (30, 5, (300, 900))


def test_fusion_query_asks_for_all_draws_folds_rounds_and_trees(spark, monkeypatch):
    got = arguments(spark, monkeypatch, models.train_fusion, "train_fusion")
    assert (got["trials"], got["folds"], got["rounds"], got["final_trees"]) == (30, 5, (300, 900), 600)


def test_candidates_query_asks_for_whole_families(spark, monkeypatch):
    assert arguments(spark, monkeypatch, models.train_candidates, "candidates")["trees"] == 300


def test_draws_of_all_folds(spark, monkeypatch):
    data = spark.range(0, 300, 1, 1).selectExpr("id", "id % 7 + id % 11 + 0.5D AS label", "array(id % 7 * 1.0D) AS f")
    data = data.select("id", "label", am.array_to_vector("f").alias("features"))
    rates = iter([0.0, 0.5, 9.0])
    monkeypatch.setattr(am, "draw_candidates", lambda *_: {"Linear": am.LinearRegression(regParam=next(rates))})
    got = {r["trial"]: r["score"] for r in am.search(data, "id", 0, trials=3, folds=3).collect()}
    folded = am.fold_assign(data, ["id"], None, 3, 42).persist()
    for trial, rate in enumerate([0.0, 0.5, 9.0]):
        one = [am.RegressionEvaluator(metricName="r2").evaluate(am.LinearRegression(regParam=rate).fit(folded.filter(f"fold <> {f}"))
               .transform(folded.filter(f"fold = {f}"))) for f in range(3)]
        assert got[trial] == pytest.approx(sum(one) / 3)
