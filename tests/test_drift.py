import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prepkit.operators import drift as dr
from prepkit.operators.drift import PsiConfig
from prepkit.operators.quantiles import linear_quantiles
from prepkit.functions.columns import numeric_columns
from tests.conftest import rows


def reference_psi(base, curr, bins=10, strategy="quantile", clip=(None, None)):
    """The textbook definition with plain pandas."""
    def cut(x):
        lo, hi = (x.quantile(q) if q is not None else None for q in clip)
        return x.clip(lower=lo, upper=hi)

    base, curr = cut(base.dropna()), cut(curr.dropna())
    if strategy == "quantile":
        edges = np.unique(base.quantile(np.linspace(0, 1, bins + 1)))
        if len(edges) <= 2:
            edges = np.linspace(base.min(), base.max(), min(bins, 2) + 1)
    else:
        edges = np.linspace(base.min(), base.max(), bins + 1)
    b, c = (pd.cut(x, edges, include_lowest=True).value_counts(sort=False) for x in (base, curr))
    p, q = (np.maximum(x / max(x.sum(), 1), 1e-6) for x in (b, c))
    return float(((q - p) * np.log((q + 1e-12) / (p + 1e-12))).sum())


@pytest.mark.parametrize("cfg", [PsiConfig(), PsiConfig(strategy="uniform"), PsiConfig(bins=5, clip_low=0.05, clip_high=0.95)])
def test_psi_equals_pandas(spark, table, cfg):
    items = table("lineitem").withColumn("l_tax", F.expr("nullif(l_tax, 0.02D)"))
    base, curr = items.filter("year(l_shipdate) <= 1996"), items.filter("l_quantity > 10 AND year(l_shipdate) > 1996")
    found = {r["feature"]: r for r in dr.psi_table(base, curr, cfg=cfg).collect()}
    pb, pc = base.toPandas(), curr.toPandas()
    for c in numeric_columns(items):
        want = reference_psi(pb[c], pc[c], cfg.bins, cfg.strategy, (cfg.clip_low, cfg.clip_high))
        assert found[c]["psi"] == pytest.approx(want, rel=1e-9, abs=1e-12), c
    assert found["l_tax"]["dropped_base"] == pb["l_tax"].isna().sum()


def test_edge_cases(spark):
    schema = "none double, same double, flat double, two double, nan double"
    base = spark.createDataFrame([(None, 1.0, 5.0, float(i % 2), math.nan if i == 0 else float(i)) for i in range(10)], schema)
    curr = spark.createDataFrame([(1.0, 2.0, float(i), float(i % 2), 100.0) for i in range(10)], schema)
    found = {r["feature"]: r for r in dr.psi_table(base, curr).collect()}
    assert math.isnan(found["none"]["psi"]) and found["none"]["note"] == "empty" and found["none"]["severity"] == "ok"
    assert (found["same"]["psi"], found["same"]["note"]) == (0.0, "both_constant")
    assert (found["flat"]["psi"], found["flat"]["note"], found["flat"]["bins_count"]) == (0.0, "base_constant", 0)
    assert found["two"]["bins_count"] == 2 and found["two"]["psi"] == pytest.approx(0)
    assert found["nan"]["dropped_base"] == 1 and found["nan"]["n_curr"] == 0 and found["nan"]["severity"] == "alert"
    order = [r["feature"] for r in dr.psi_table(base, curr).collect()]
    assert order[0] == "nan" and order[-1] == "none"


def test_empty_current(spark):
    base = spark.range(10).select(F.col("id").cast("double").alias("x"))
    r = dr.psi_table(base, base.limit(0)).first()
    assert math.isnan(r["psi"]) and r["note"] == "empty"


@pytest.mark.parametrize("parts", [1, 3, 17])
def test_partition_invariance(spark, table, parts):
    items = table("lineitem")
    want = rows(dr.bin_counts(items, items, dr.plan_psi(items, ["l_quantity"])), "feature", "bin")
    moved = items.repartition(parts)
    assert rows(dr.bin_counts(moved, moved, dr.plan_psi(moved, ["l_quantity"])), "feature", "bin") == want


@pytest.mark.parametrize("gathered", [1, 50, 10_000])
def test_quantiles_are_exact(spark, monkeypatch, gathered):
    monkeypatch.setattr("prepkit.operators.quantiles.GATHERED", gathered)
    rng = np.random.RandomState(1)
    pdf = pd.DataFrame({"a": rng.normal(size=3000), "b": np.where(rng.rand(3000) < 0.4, 7.0, rng.rand(3000)),
                        "c": rng.randint(0, 5, 3000).astype(float), "d": 10.0 ** rng.uniform(-300, 300, 3000) * rng.choice([-1, 1], 3000),
                        "e": np.where(rng.rand(3000) < 0.1, 1e300, -0.0)})
    pdf.loc[::7, "a"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("empty", F.lit(None).cast("double"))
    probs = [0, 0.01, 0.3333, 0.5, 0.9, 1]
    got = linear_quantiles(df, ["a", "b", "c", "d", "e", "empty"], probs)
    for c in "abcde":
        assert got[c] == pytest.approx(list(pdf[c].quantile(probs)), rel=1e-12)
    assert got["empty"] == [None] * 6


def test_large_plan_equals_small(scaled, table):
    items = table("lineitem")
    base, curr = items.filter("year(l_shipdate) <= 1996"), items.filter("year(l_shipdate) > 1996")
    large = rows(dr.psi_table(base, curr).select("feature", F.round("psi", 12)), "feature")
    scaled.conf.unset("spark.prepkit.rangeRows")
    assert large == rows(dr.psi_table(base, curr).select("feature", F.round("psi", 12)), "feature")


def test_alert_rows(spark):
    found = spark.createDataFrame([("a", 0.3, "alert"), ("b", 0.15, "warn"), ("c", 0.0, "ok")], "feature string, psi double, severity string")
    got = rows(dr.alert_rows(found).select("feature", "channel", "message"), "feature", "channel")
    assert got == [("a", "email", "a PSI=0.300"), ("a", "slack", "a PSI=0.300"), ("b", "slack", "b PSI=0.150")]
    assert len({r["signature"] for r in dr.alert_rows(found).collect()}) == 3
