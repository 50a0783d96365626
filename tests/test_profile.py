import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepkit.operators import profile as pf
from prepkit.plans.insights import eda_report, insights
from tests.conftest import rows


def test_health_contract(spark):
    assert pf.quality_health(spark.createDataFrame([(1,), (2,), (3,)], "a bigint")).first()["rows"] == 3


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(math.nan, None), (1.0, "a"), (None, "b")], "x double, s string")
    assert {r["feature"]: r["missing"] for r in pf.missing_ratio(df).collect()} == {"x": 2, "s": 1}
    got = {r["feature"]: (r["missing"], r["n_distinct"]) for r in pf.distinct_counts(df).collect()}
    assert got == {"x": (2, 1), "s": (1, 2)}


def test_constant_columns(spark):
    df = spark.createDataFrame([(1.0, "a", None, 1), (1.0, "a", None, 2)], "c double, s string, n double, v int")
    assert {r[0] for r in pf.constant_columns(df).collect()} == {"c", "s"}


def test_describe_and_corr_equal_pandas(spark, table):
    df = table("lineitem").withColumn("l_tax", F.expr("nullif(l_tax, 0.02D)"))
    p = df.toPandas()
    d = pf.describe_numeric(df).toPandas().set_index("feature")
    want = p.select_dtypes("number").describe().T
    assert np.allclose(d.loc[want.index, ["count", "mean", "std", "min", "q25", "q50", "q75", "max"]].astype(float),
                       want[["count", "mean", "std", "min", "25%", "50%", "75%", "max"]])
    c = pf.correlation_matrix(df).toPandas().pivot(index="x", columns="y", values="r")
    w = p.select_dtypes("number").corr()
    assert np.allclose(c.loc[w.index, w.columns], w, atol=1e-10)


def test_corr_constant_is_null(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (3.0, 1.0)], "a double, b double")
    got = {(r["x"], r["y"]): r["r"] for r in pf.correlation_matrix(df).collect()}
    assert got["a", "a"] == 1.0 and got["a", "b"] is None


def test_signals_rules(spark):
    df = spark.createDataFrame([(float(i), 1.0, i if i < 2 else None, i) for i in range(10)], "a double, k double, few int, y int")
    assert {r["feature"]: r["score"] for r in pf.numeric_signals(df, "y").collect()} == {"a": pytest.approx(1.0)}


def test_target_rules(spark, table):
    assert pf.infer_target(table("orders")) == "o_orderpriority"
    assert pf.infer_target(table("lineitem")) is None
    df = spark.createDataFrame([(i, i / 3) for i in range(60)], "id int, y double")
    assert pf.infer_target(df) is None and pf.infer_target(df, "id") == "id"
    assert pf.infer_problem_type(df, "y", "fusion") == "regression"
    few = df.withColumn("y", F.col("id") % 3 / 2.0)
    assert [pf.infer_problem_type(few, "y", r) for r in ("insights", "baseline", "fusion")] == ["regression", "regression", "classification"]
    assert pf.infer_problem_type(few.limit(0), "id") == "unknown"


def test_label_codes_large_plan(scaled, spark, monkeypatch):
    monkeypatch.setattr("prepkit.operators.ordering.LABELS_PER_TASK", 20)
    df = spark.range(500).select(F.format_string("k%03d", F.col("id") % 97).alias("s"))
    got = {r["label"]: r["code"] for r in pf.label_codes(df, "s").collect()}
    assert got == {f"k{i:03d}": i for i in range(97)}


def test_sample_is_stable(scaled, spark):
    df = spark.range(5000).withColumn("v", F.col("id") * 2)
    want = rows(pf.sample_rows(df, 50), "id")
    scaled.conf.unset("spark.prepkit.rangeRows")
    assert rows(pf.sample_rows(df.repartition(7), 50), "id") == want and len(want) == 50
    assert pf.sample_rows(df, 10_000).count() == 5000


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0, 5.0), (10.0, 5.0), (None, 5.0)], "a double, k double")
    got = pf.histogram(df, bins=4).toPandas()
    assert list(got[got.feature == "a"].sort_values("bin").n) == [1, 0, 0, 1] and list(got[got.feature == "k"].n) == [3]


def test_insights_and_report(spark, table):
    assert insights(spark.createDataFrame([], "a int")) is None
    found = insights(table("orders"))
    assert (found.target, found.problem_type) == ("o_orderpriority", "classification")
    sections = {r["section"] for r in found.table().select("section").distinct().collect()}
    assert {"summary", "schema", "missing", "signal", "class", "recommendation", "high_cardinality"} <= sections
    assert set(eda_report(table("orders"), {"f1": 1.0})) == {
        "metrics", "shape", "schema", "missing", "sample", "describe", "histograms", "correlation"}
