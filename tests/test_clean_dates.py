import datetime as dtm
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prepkit.functions import text as tx
from prepkit.operators import clean as cl
from prepkit.operators import dates as dt
from prepkit.operators import quantiles
from prepkit.operators.clean import CleanConfig
from tests.conftest import rows


@pytest.mark.parametrize("text,value", [
    ("12,345.67", 12345.67), ("(1,234.5)", -1234.5), ("1 234,56", 1234.56), ("1.234.567", 1234567.0), ("0.125", 125.0),
    ("1 000", 1000.0), ("1'000", 1000.0), ("-3", -3.0), ("1e3", 1000.0), ("abc", None), ("1d", None), ("", None)])
def test_number_text(spark, text, value):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(tx.parse_number(F.col("s"))).first()[0] == value


def test_clean_text_order(spark):
    df = spark.createDataFrame([("  a  b\t\nc ",), (" N/A ",), ("NaN",), ("--",), ("nap",), (None,)], "s string")
    assert [r[0] for r in cl.clean_text(df).collect()] == ["a b c", None, None, None, "nap", None]
    assert cl.clean_text(df, None, CleanConfig(lowercase_categoricals=True)).filter("s = 'a b c'").count() == 1


def test_names():
    assert cl.dedupe_names(["a", "a", "b", "a"]) == ["a", "a__1", "b", "a__2"]


def test_ratio_counts_nulls_as_failures(spark):
    df = spark.createDataFrame([("1",)] * 7 + [(None,)] * 3, "s string")
    assert cl.decide_types(df, None, CleanConfig(parse_dates=False)).numbers == ()
    assert cl.decide_types(df, None, CleanConfig(parse_dates=False, min_parse_success_ratio=0.7)).numbers == ("s",)


def test_dates_before_numbers_and_one_layout(spark):
    df = spark.createDataFrame([("2001", "2024-01-05", "31/01/2024")] * 9 + [("2002", "05.01.2024", "x")], "y string, m string, d string")
    d = cl.decide_types(df)
    assert d.dates["y"][1] == "yyyy" and d.dates["m"][1] == "yyyy-M-d" and "d" not in d.dates
    assert cl.decide_types(df, None, CleanConfig(date_dayfirst=True)).dates["d"][1] == "d/M/yyyy"


def test_pipeline(spark):
    df = spark.createDataFrame([(" x ", 1.0, "10"), ("x", math.inf, "20"), ("n/a", math.nan, "30"), ("x", 1.0, "10")], "k string, v double, n string")
    out = cl.clean(df.toDF(" k  1", "v", "n"))
    assert out.columns == ["k_1", "v", "n"]
    assert rows(out, "n") == [("x", 1.0, 10.0), ("x", 1.0, 20.0), ("missing", 1.0, 30.0)]


def test_impute_keeps_whole_types(spark):
    df = spark.createDataFrame([(1, None), (2, 3), (4, 5)], "a bigint, b bigint")
    out = cl.impute_numeric(df, "median")
    assert dict(out.dtypes) == {"a": "bigint", "b": "bigint"} and out.filter("a = 1").first()["b"] == 4
    assert dict(cl.impute_numeric(df.limit(3), "mean").dtypes)["a"] == "bigint"


def test_empty_table(spark):
    df = spark.createDataFrame([], "a string, b double")
    assert cl.clean(df).count() == 0


def test_drop_duplicates_first_by_order(spark):
    df = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (2, "c", 2)], "k int, v string, o int")
    assert rows(cl.drop_duplicates(df, ["k"], ["o"]), "k") == [(1, "b", 1), (2, "c", 2)]
    want = rows(cl.drop_duplicates(df, ["k"]), "k")
    assert rows(cl.drop_duplicates(df.repartition(5), ["k"]), "k") == want


def test_low_card_counts_null(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "2"), (None, "3"), ("a", "4")], "s string, u string")
    got = {r["feature"]: (r["n_distinct"], r["categorical"]) for r in cl.low_card_columns(df).collect()}
    assert got == {"s": (2, True), "u": (4, False)}


# --- dates -----------------------------------------------------------------------------------


def test_flags_false_on_missing(spark):
    df = spark.createDataFrame([(dtm.datetime(2024, 3, 31),), (None,)], "t timestamp_ntz")
    out = dt.date_features(df)
    missing = out.filter("t IS NULL").first()
    assert missing["t_year"] is None and missing["t_is_month_end"] is False and missing["t_is_weekend"] is False
    got = out.filter("t IS NOT NULL").first()
    assert got["t_is_quarter_end"] and got["t_is_weekend"] and not got["t_is_month_start"] and "t_hour" not in out.columns


def test_features_equal_pandas(spark, table):
    o = table("events").select("ts")
    got = dt.date_features(o).toPandas().sort_values("ts").reset_index(drop=True)
    s = o.toPandas()["ts"].sort_values().reset_index(drop=True)
    for part, want in {"year": s.dt.year, "quarter": s.dt.quarter, "dow": s.dt.dayofweek, "doy": s.dt.dayofyear, "hour": s.dt.hour,
                       "second": s.dt.second, "is_month_end": s.dt.is_month_end, "is_quarter_start": s.dt.is_quarter_start,
                       "is_year_start": s.dt.is_year_start}.items():
        assert (got[f"ts_{part}"].astype("int64") == want.astype("int64")).all(), part


def test_clash_names_and_cap(spark):
    df = spark.createDataFrame([(dtm.datetime(2024, 1, 1), dtm.datetime(2024, 1, 1), 5)], "a timestamp_ntz, b timestamp_ntz, a_year int")
    out = dt.date_features(df)
    assert "a_year__1" in out.columns and out.first()["a_year"] == 5
    capped = dt.date_features(df, dt.DateFeatureConfig(max_new_cols=5))
    assert not any(c.startswith("b_") for c in capped.columns)


def test_zone_gap_and_overlap(spark):
    df = spark.sql("SELECT explode(array(timestamp_ntz'2024-03-31 02:30:00', timestamp_ntz'2024-10-27 02:30:00', timestamp_ntz'2024-06-01 12:00:00')) AS t")
    got = df.select(dt.localize(F.col("t"), "Europe/Warsaw")).collect()
    assert [r[0] for r in got] == [None, None, dtm.datetime(2024, 6, 1, 12)]
    zoned = spark.sql("SELECT timestamp'2024-06-01 12:00:00Z' AS t")
    c = dt.ensure_datetime(zoned, "t", dt.DateFeatureConfig(tz_convert_to="Europe/Warsaw"))
    assert zoned.select(c).first()[0] == dtm.datetime(2024, 6, 1, 14)


def test_holidays(spark):
    days = spark.createDataFrame([("PL", "2024-01-01"), ("US", "2024-07-04"), ("PL", "2024-01-01")], "country string, day string")
    df = spark.createDataFrame([(dtm.datetime(2024, 1, 1, 5),), (dtm.datetime(2024, 7, 4),), (None,)], "t timestamp_ntz")
    assert [r[0] for r in dt.holiday_flag(df, "t", days).orderBy(F.asc_nulls_last("t")).select("is_holiday").collect()] == [True, False, False]


def test_detect_by_text(spark):
    df = spark.createDataFrame([("2024-01-01", "hello", "1.5")] * 5, "d string, t string, n string")
    assert dt.detect_datetime_cols(df) == ["d"]
    assert pd.Timestamp("2024-01-01") == cl.coerce_dates(df).first()["d"]


def test_shapes_equal_the_plain_rules(spark):
    """Number shapes turn away dates before the cast, spaces are matched letter by letter; no value changes."""
    texts = ["".join(p) for n in range(4) for p in itertools.product("-+().,'  1eE", repeat=n)]
    texts += [a + b for a in ("1996-09-13", "(1,234.5)", "-1'000e-2", "inf", "-Infinity", "1e", "5-", "( 5 )", "1.000.000", "1e1.000") for b in ("", " ", "\n", "0", ")", " ")]
    c, plain = F.col("s"), r"^[-+().,'  \deE]+$|^(?i)[-+]?inf(inity)?$"
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for thousands in (True, False):
        want = F.when(c.rlike(plain), tx.number_text(c, thousands).try_cast("double"))
        assert df.filter(~tx.parse_number(c, thousands).eqNullSafe(want)).count() == 0
    assert df.filter(c.rlike(plain) & c.rlike(r"^\d{4}-\d")).count() and not df.filter(c.rlike(tx._NUMBER_SHAPE) & c.rlike(r"^\d{4}-\d")).count()
    spaces = ["".join(p) for n in range(6) for p in itertools.product(" \t  \x85a", repeat=n)]
    df = spark.createDataFrame([(t,) for t in spaces], "s string")
    assert df.filter(F.regexp_replace(c, r"(?U)[^\S ]\s*| \s+", " ") != F.regexp_replace(c, tx.SPACE_RUN, " ")).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_fills_and_limits_share_their_passes(spark, monkeypatch, small):
    """Limits of the filled columns from the passes of the medians, equal to a second run over the filled table."""
    if small:
        monkeypatch.setattr(quantiles, "COUNTED", 64)
        monkeypatch.setattr(quantiles, "GATHERED", 50)
        monkeypatch.setattr(quantiles, "sketches", lambda df, cols, whole=quantiles.sketches: whole(df, cols, 64))
    rng = np.random.RandomState(5)
    n = 4000
    pdf = pd.DataFrame({"most": np.where(rng.rand(n) < 0.7, np.nan, rng.randn(n)), "few": np.where(rng.rand(n) < 0.01, np.nan, rng.rand(n)),
                        "ties": np.where(rng.rand(n) < 0.3, np.nan, rng.randint(0, 3, n)), "none": np.full(n, np.nan), "whole": rng.randint(0, 1000, n),
                        "one": np.where(np.arange(n) == 7, 2.5, np.nan), "ends": np.where(np.arange(n) < 2, [(-1) ** i * math.inf for i in range(n)], np.nan)})
    df = spark.createDataFrame(pdf).withColumns({"gaps": F.expr("CASE WHEN whole % 3 > 0 THEN whole * 2 + 1 END"), "none": F.lit(None).cast("double")})
    cols = df.columns
    for lo, hi in ((0.01, 0.99), (0.4, 0.6), (0.0, 1.0)):
        fills = cl.fill_values(df, cols, "median")
        limits = cl.clip_limits(cl.fill_numeric(df, fills), lo, hi, cols)
        got = cl.fills_and_limits(df, cols, lo, hi)
        assert repr(sorted(got[0].items())) == repr(sorted(fills.items())) and repr(sorted(got[1].items())) == repr(sorted(limits.items()))
    calls = []
    plain = quantiles.sketches
    monkeypatch.setattr(quantiles, "sketches", lambda *a, **k: calls.append(1) or plain(*a, **k))
    cl.decide(df, CleanConfig(clip_quantiles=(0.01, 0.99)))
    assert len(calls) == 1
