import datetime as dtm

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prepkit.operators import conversations as cv
from prepkit.operators import series as sr
from prepkit.plans import forecast as fc
from tests.conftest import rows


def frame(spark, ds, y):
    pdf = pd.DataFrame({"ds": pd.to_datetime(ds), "y": y})
    return spark.createDataFrame(pdf).select(F.col("ds").cast("timestamp_ntz").alias("ds"), F.when(~F.isnan("y"), F.col("y")).alias("y"))


@pytest.mark.parametrize("freq,alias", [("D", "D"), ("W", "W"), ("MS", "MS"), ("2D", "2D"), ("6H", "6h"), ("5H", "5h"), ("W-WED", "W-WED")])
def test_resample_equals_pandas(spark, table, freq, alias):
    o = table("orders")
    got = sr.resample_mean(sr.to_series(o, "o_orderdate", "o_totalprice"), freq).orderBy("ds").toPandas()
    want = o.toPandas().set_index("o_orderdate")[["o_totalprice"]].resample(alias).mean()
    assert (got["ds"].values == want.index.values).all() and np.allclose(got["y"], want["o_totalprice"], equal_nan=True)


@pytest.mark.parametrize("freq,expected", [("D", "D"), ("h", "H"), ("3h", "3H"), ("min", "min"), ("W-WED", "W-WED"), ("MS", "MS"), ("ME", "MS"), ("s", "S")])
def test_infer_freq(spark, freq, expected):
    s = frame(spark, pd.date_range("2024-01-03", periods=60, freq=freq), np.arange(60.0))
    assert sr.infer_freq(s).first()["freq"] == expected


def test_irregular_has_no_freq(spark):
    s = frame(spark, ["2024-01-01", "2024-01-02", "2024-01-04"], [1.0, np.nan, 3.0])
    assert sr.infer_freq(s).first()["freq"] is None
    out = sr.prepare_series(s.withColumnRenamed("ds", "d"), "d", "y").orderBy("ds")
    assert [r["y"] for r in out.collect()] == [1.0, 1.0, 3.0] and out.count() == 3


@pytest.mark.parametrize("parts", [1, 5])
def test_fills(spark, parts):
    y = [np.nan, 1.0, np.nan, np.nan, 4.0, np.nan, 6.0, np.nan]
    s = frame(spark, pd.date_range("2024-01-01", periods=8), y)
    p = pd.Series(y)

    def got(df):
        return [r["y"] for r in df.orderBy("ds").collect()]

    assert got(sr.interpolate_linear(s, parts=parts)) == list(p.interpolate(limit_direction="both"))
    assert got(sr.impute_series(s, "ffill", parts=parts)) == list(p.ffill().bfill())
    assert got(sr.impute_series(s, "bfill", parts=parts)) == list(p.bfill().ffill())
    assert got(sr.impute_series(s, "zero")) == list(p.fillna(0)) and got(sr.impute_series(s, "mean")) == list(p.fillna(p.mean()))


def test_winsor_needs_more_than_20(spark):
    for n, clipped in ((20, False), (21, True)):
        y = np.r_[np.zeros(n - 1), 1000.0]
        out = sr.winsorize_sigma(frame(spark, pd.date_range("2024-01-01", periods=n), y), 4.0)
        assert (out.agg(F.max("y")).first()[0] < 1000) == clipped


def test_prepare_equals_pandas(spark, table):
    o = table("orders")
    got = sr.prepare_series(o, "o_orderdate", "o_totalprice", freq="D").orderBy("ds").toPandas()
    want = o.toPandas().set_index("o_orderdate")["o_totalprice"].resample("D").mean().interpolate(limit_direction="both")
    want = want.clip(want.mean() - 4 * want.std(), want.mean() + 4 * want.std())
    assert np.allclose(got["y"], want)


def test_keyed_mixed_frequencies(spark):
    day = frame(spark, pd.date_range("2024-01-01", periods=5), np.arange(5.0)).withColumn("k", F.lit("d"))
    odd = frame(spark, ["2024-01-01", "2024-01-02", "2024-01-09"], [1.0, 2.0, 3.0]).withColumn("k", F.lit("o"))
    out = sr.prepare_series(day.unionByName(odd), "ds", "y", keys=["k"])
    assert {r["k"]: r["count"] for r in out.groupBy("k").count().collect()} == {"d": 5, "o": 3}


def test_future_and_cutoffs(spark):
    s = frame(spark, pd.date_range("2024-01-01", periods=100), np.arange(100.0))
    assert sr.future_frame(s, 10).count() == 110
    cuts = rows(sr.cv_cutoffs(s, 10, 5, 30), "cutoff")
    last = dtm.datetime(2024, 4, 9)
    assert cuts[-1][0] == last - dtm.timedelta(days=10) and cuts[0][0] >= dtm.datetime(2024, 1, 31)


def made(n, seed=0, multiplicative=False):
    rng, i = np.random.RandomState(seed), np.arange(n)
    season = np.sin(2 * np.pi * i / 7) + np.sin(2 * np.pi * i / 365.25)
    return (20 + 0.01 * i) * (1 + 0.2 * season) + rng.normal(0, .2, n) if multiplicative else 20 + 0.01 * i + 2 * season + rng.normal(0, .2, n)


@pytest.mark.parametrize("mode", ["additive", "multiplicative"])
def test_forecast_beats_seasonal_naive(spark, mode):
    y, ds = made(830, 0, mode == "multiplicative"), pd.date_range("2020-01-01", periods=830)
    s = frame(spark, ds[:800], y[:800])
    f = fc.fit_forecast(s, fc.ForecastParams(periods=30, seasonality_mode=mode)).orderBy("ds").toPandas()
    assert len(f) == 830
    naive = y[793:800][np.arange(30) % 7]
    assert np.abs(f["yhat"].values[-30:] - y[800:]).mean() < 0.7 * np.abs(naive - y[800:]).mean()


def test_forecast_many_series_equals_one_by_one(spark):
    ds = pd.date_range("2022-01-01", periods=300)
    a, b = (frame(spark, ds, made(300, k)).withColumn("k", F.lit(k)) for k in (1, 2))
    both = fc.fit_forecast(a.unionByName(b), fc.ForecastParams(periods=5), ["k"])
    one = fc.fit_forecast(a.drop("k"), fc.ForecastParams(periods=5)).orderBy("ds").toPandas()["yhat"]
    assert np.allclose(both.filter("k = 1").orderBy("ds").toPandas()["yhat"], one)


def test_logistic_stays_in_bounds(spark):
    t = np.arange(200)
    s = frame(spark, pd.date_range("2024-01-01", periods=200), 100 / (1 + np.exp(-(t - 100) / 20)))
    with pytest.raises(ValueError):
        fc.fit_forecast(s, fc.ForecastParams(growth="logistic"))
    f = fc.fit_forecast(s, fc.ForecastParams(growth="logistic", cap=100.0)).toPandas()["yhat"]
    assert f.between(0, 100).all()


def test_context_window_rule(spark):
    def restated(msgs, limit, last):
        system, rest = [m for m in msgs if m[1] == "system"], [m for m in msgs if m[1] != "system"]
        kept = rest[-last:]

        def tokens(x):
            return max(1, sum(len(m[1]) + len(m[2]) for m in x) // 4)
        while tokens(system + kept) > limit and len(kept) > 1:
            kept = kept[1:]
        return sorted(m[0] for m in system + kept)

    rng = np.random.RandomState(3)
    data, want = [], {}
    for conv in range(60):
        msgs = [(t, rng.choice(["system", "user", "assistant"], p=[.1, .45, .45]), "x" * rng.randint(0, 200)) for t in range(rng.randint(1, 20))]
        data += [(conv, int(t), str(r), x) for t, r, x in msgs]
        want[conv] = restated(msgs, 100, 6)
    df = spark.createDataFrame(data, "conv_id int, turn int, role string, text string")
    got = {c: [] for c in want}
    for r in cv.context_window(df, 100, 6).collect():
        got[r["conv_id"]].append(r["turn"])
    assert {c: sorted(v) for c, v in got.items()} == want
