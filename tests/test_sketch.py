"""Quantile sketches against exact ranks, and drift against a sketched base."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepkit.functions import sketch as sk
from prepkit.functions.columns import numeric_columns
from prepkit.operators import drift as dr
from prepkit.operators import quantiles
from prepkit.operators.drift import PsiConfig

SHAPES = {
    "normal": lambda r, n: r.standard_normal(n),
    "ties": lambda r, n: r.integers(0, 7, n).astype(float),
    "rising": lambda r, n: np.arange(n) * 1.0,
    "heavy": lambda r, n: np.exp(5 * r.standard_normal(n)) * r.choice([-1.0, 1.0], n),
    "infinite": lambda r, n: np.where(r.random(n) < 0.01, math.inf, r.random(n)),
}


def _filled(values, parts, top=256):
    out = sk.Sketch(top, (9,))
    for i, part in enumerate(np.array_split(values, parts)):
        out.merge(sk.Sketch(top, (i,)).add(part))
    return out


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("parts", [1, 7])
def test_ranks_stay_in_the_stated_error(monkeypatch, shape, parts):
    monkeypatch.setattr(sk, "BUFFER", 512)
    values = SHAPES[shape](np.random.default_rng(3), 100_000)
    s = _filled(values, parts)
    ordered = np.sort(values)
    assert (s.n, s.low, s.high) == (len(values), ordered[0], ordered[-1])
    assert int(s.steps()[1][-1]) == s.n and sum(map(len, s.levels)) < 4 * 256 + 600
    at = np.quantile(values, np.linspace(0.001, 0.999, 200), method="nearest")
    off = np.abs(s.ranks(at) - np.searchsorted(ordered, at, "right"))
    assert 0 < s.error() <= s.most and off.max() <= s.error() < 0.08 * s.n
    for rank in (0, 1, 777, 50_000, 99_998, 99_999):
        low, high = s.bracket(rank)
        assert low <= ordered[rank] <= high


def test_small_columns_are_exact_and_missing_values_are_counted():
    s = sk.Sketch().add(np.array([3.0, math.nan, -0.0, 0.0, 5.0]))
    assert (s.n, s.missing, s.error()) == (4, 1, 0) and s.quantiles([0, 0.5, 1]) == [0.0, 1.5, 5.0]
    assert s.ranks([-1, 0, 3, 4, 9]).tolist() == [0, 2, 3, 3, 4] and math.copysign(1, s.low) == 1
    again = sk.Sketch.of(dict(zip([f.split()[0] for f in sk.SKETCH_SCHEMA.split(", ")], s.row("x"), strict=True)))
    assert again.quantiles([0.5, 1]) == [1.5, 5.0] and again.missing == 1
    assert sk.Sketch().quantiles([0.5]) == [None] and sk.Sketch().ranks([1.0]).tolist() == [0]


def test_the_error_is_kept_in_most_merges_of_many_orders(monkeypatch):
    """Mean of the signed errors near 0 (a fair bit), and none beyond the certain bound."""
    monkeypatch.setattr(sk, "BUFFER", 64)
    values = np.random.default_rng(1).random(5000)
    signed = []
    for seed in range(60):
        s = sk.Sketch(64, (seed,))
        for part in np.array_split(values, 50):
            s.add(part)
        off = float(s.ranks([0.5])[0] - (values <= 0.5).sum())
        assert abs(off) <= s.most
        signed.append(off)
    assert abs(np.mean(signed)) < 3 * np.std(signed) / 60**0.5 + 1


def _frame(spark, n=30_000):
    return spark.range(n).selectExpr("id", "CASE WHEN id % 11 = 0 THEN NULL ELSE pmod(id * 7919, 10007) / 3.0D END AS x", "CASE WHEN id % 5 = 0 THEN double('NaN') ELSE id % 4 END AS y",
                                     "CAST(NULL AS double) AS none", "'t' AS text").repartition(6)


def test_columns_of_a_table(spark, monkeypatch):
    df = _frame(spark)
    cols = numeric_columns(df)
    for buffer in (1 << 16, 500):
        monkeypatch.setattr(sk, "BUFFER", buffer)
        found = sk.sketches(df, cols, 512)
        assert found["x"].missing == 2728 and found["y"].missing == 6000 and found["none"].n == 0 and found["id"].high == 29_999
        exact = df.agg(*[F.count(F.when(F.col("x") <= v, 1)) for v in (10.0, 1700.0, 3300.0)]).first()
        assert np.abs(found["x"].ranks([10.0, 1700.0, 3300.0]) - np.array(exact)).max() <= found["x"].error()
    assert sk.sketches(df.where("false"), ["x"])["x"].n == 0 and sk.sketches(df, []) == {}


@pytest.mark.parametrize("cfg", [PsiConfig(), PsiConfig(strategy="uniform"), PsiConfig(bins=5, clip_low=0.05, clip_high=0.95)])
def test_drift_against_a_sketched_base(spark, table, monkeypatch, cfg):
    monkeypatch.setattr(sk, "BUFFER", 100)
    items = table("lineitem").withColumn("l_tax", F.expr("nullif(l_tax, 0.02D)"))
    base, curr = items.filter("year(l_shipdate) <= 1996"), items.filter("l_quantity > 10 AND year(l_shipdate) > 1996")
    reference = sk.sketch_columns(base, numeric_columns(base), 64)
    out = {r["feature"]: r for r in dr.sketch_psi_table(reference, curr, cfg=cfg).collect()}
    known = sk.read_sketches(reference)
    plan = dr.sketch_plan(known, list(known), cfg)
    plan = dr.PsiPlan(cfg, plan.edges, plan.base_clip, dr._clip_bounds(curr, list(known), cfg))
    exact = {r["feature"]: r for r in dr.psi_table(base, curr, cfg=cfg, plan=plan).collect()}
    assert set(out) == set(exact) and any(r["rank_error"] > 0 for r in out.values())
    for c, r in out.items():
        assert r["psi_low"] - 1e-12 <= exact[c]["psi"] <= r["psi_high"] + 1e-12, c
        assert r["psi_low"] <= r["psi"] <= r["psi_high"] and r["n_base"] == exact[c]["n_base"] and r["n_curr"] == exact[c]["n_curr"] and r["dropped_base"] == exact[c]["dropped_base"]


def test_drift_against_an_exact_sketch_is_the_exact_table(spark):
    schema = "none double, same double, flat double, two double, nan double"
    base = spark.createDataFrame([(None, 1.0, 5.0, float(i % 2), math.nan if i == 0 else float(i)) for i in range(10)], schema)
    curr = spark.createDataFrame([(1.0, 2.0, float(i), float(i % 2), 100.0) for i in range(10)], schema)
    reference = sk.sketch_columns(base, base.columns)
    keys = ["feature", "n_base", "n_curr", "bins_count", "dropped_base", "dropped_curr", "note", "severity"]
    got, want = (sorted((tuple(r[k] for k in keys), round(0 if math.isnan(r["psi"]) else r["psi"], 9)) for r in t.collect())
                 for t in (dr.sketch_psi_table(reference, curr), dr.psi_table(base, curr)))
    assert got == want
    assert dr.sketch_psi_table(reference, curr, include=["lost"]).count() == 0


@pytest.mark.parametrize(("buffer", "counted"), [(1 << 16, 1 << 15), (200, 1 << 15), (200, 40)])
def test_exact_quantiles_from_sketched_brackets(spark, monkeypatch, buffer, counted):
    monkeypatch.setattr(sk, "BUFFER", buffer)
    monkeypatch.setattr(quantiles, "COUNTED", counted)
    monkeypatch.setattr(quantiles, "GATHERED", 50)
    monkeypatch.setattr(quantiles, "STEPS", 64)
    df = _frame(spark, 20_000)
    probs = [0, 0.001, 0.1, 0.25, 0.5, 0.9, 0.999, 1]
    got, pdf = quantiles.linear_quantiles(df, ["x", "y", "none", "id"], probs), df.toPandas()
    for c in ("x", "y", "id"):
        assert np.allclose(got[c], pdf[c].astype(float).dropna().quantile(probs), rtol=1e-14), c
    assert got["none"] == [None] * len(probs)


def test_a_bracket_that_misses_its_rank_is_found_in_a_gap(spark, monkeypatch):
    monkeypatch.setattr(sk, "BUFFER", 200)
    monkeypatch.setattr(sk.Sketch, "error", lambda self, delta=0: 0.001)  # far less than it is
    df = spark.range(20_000).selectExpr("CAST(pmod(id * 7919, 20011) AS double) AS x")
    assert np.allclose(quantiles.linear_quantiles(df, ["x"], [0.1, 0.5])["x"], df.toPandas()["x"].quantile([0.1, 0.5]))
