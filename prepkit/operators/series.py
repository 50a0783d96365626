"""Time series: frequency, resampling, filling, winsorising, metrics. One job for any number of series.

``keys`` name the columns that tell series apart; without keys the table is one series. Work that
needs neighbours in time runs inside (keys, time range) pieces, so one long series is still spread
over many tasks (see ``ordering``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit.functions import text as tx
from prepkit.functions.columns import number, quoted
from prepkit.operators.clean import parse_ratios
from prepkit.operators.ordering import RANGE, running_sums, with_range

FREQ_SAMPLE = 50

# Seconds per unit.
UNIT_SECONDS = {"S": 1, "min": 60, "H": 3600, "D": 86400}
WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")


def to_series(df: DataFrame, date_col: str, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, ds TIMESTAMP_NTZ, y DOUBLE); rows without a readable date are dropped."""
    c = quoted(date_col)
    if isinstance(df.schema[date_col].dataType, T.StringType):
        r = parse_ratios(df, [date_col], numbers=False).first()
        layout = tx.layouts()[r["layout"]] if r and r["layout"] is not None else tx.layouts()[0]
        c = tx.parse_layout(c, layout)
    return (df.select(*map(quoted, keys), c.cast("timestamp_ntz").alias("ds"), number(df, target).alias("y"))
            .filter("ds IS NOT NULL"))


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def _from_micros(c: Column) -> Column:
    return F.timestamp_micros(c).cast("timestamp_ntz")


def infer_freq(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, freq): the step of the first 50 timestamps when perfectly regular, else NULL.

    Steps: n S/min/H/D, weekly W-<DAY>, monthly MS (month starts or month ends). The top-50 per key
    is limited before the shuffle, so a long series costs 50 rows per task.
    """
    keys = list(keys)
    if keys:
        w = Window.partitionBy(*keys).orderBy("ds")
        first = series.select(*keys, "ds").withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= FREQ_SAMPLE)
    else:
        first = series.select("ds").orderBy("ds").limit(FREQ_SAMPLE)
    w = Window.partitionBy(*keys).orderBy("ds")  # at most 50 rows per key from here on
    months = F.year("ds") * 12 + F.month("ds")
    steps = first.withColumns({
        "step": (_micros(F.col("ds")) - _micros(F.lag("ds").over(w))),
        "mstep": months - F.lag(months).over(w)})
    g = steps.groupBy(*keys) if keys else steps
    facts = g.agg(
        F.count("*").alias("n"), F.min("step").alias("lo"), F.max("step").alias("hi"),
        F.min("mstep").alias("mlo"), F.max("mstep").alias("mhi"),
        F.bool_and(F.day("ds") == 1).alias("starts"), F.bool_and(F.to_date("ds") == F.last_day("ds")).alias("ends"),
        F.max("ds").alias("last"))
    sec = F.col("lo") / 1_000_000
    regular = (F.col("n") >= 3) & (F.col("lo") == F.col("hi")) & (F.col("lo") > 0) & (sec == F.floor(sec))
    day = F.array(*map(F.lit, WEEKDAYS))[F.weekday("last")]

    def every(unit: str) -> Column:
        k = (sec / UNIT_SECONDS[unit]).cast("bigint")
        return F.when(k == 1, F.lit(unit)).otherwise(F.concat(k.cast("string"), F.lit(unit)))

    freq = (F.when(regular & (sec == 7 * 86400), F.concat(F.lit("W-"), day))
            .when(regular & (sec % 86400 == 0), every("D"))
            .when(regular & (sec % 3600 == 0), every("H"))
            .when(regular & (sec % 60 == 0), every("min"))
            .when(regular, every("S"))
            .when((F.col("n") >= 3) & (F.col("mlo") == 1) & (F.col("mhi") == 1) & (F.col("starts") | F.col("ends")), "MS"))
    return facts.select(*keys, freq.alias("freq"))


def seasonality_defaults(freqs: DataFrame) -> DataFrame:
    """Add daily/weekly/yearly flags by frequency."""
    unit = F.regexp_extract(F.coalesce(F.col("freq"), F.lit("")), r"^\d*([A-Za-z])", 1)
    minute = F.coalesce(F.col("freq"), F.lit("")).endswith("min")
    hourly, long_step = (unit == "H"), (unit.isin("W", "M") & ~minute)
    return freqs.withColumns({"daily": hourly, "weekly": ~long_step, "yearly": F.lit(True)})


def seasonality_mode(series: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """multiplicative when every y is above 0, else additive."""
    g = series.groupBy(*keys) if keys else series
    positive = F.coalesce(F.bool_and(F.coalesce(F.col("y") > 0, F.lit(False))), F.lit(True))
    return g.agg(F.when(positive, "multiplicative").otherwise("additive").alias("mode"))


# --- resampling ----------------------------------------------------------------------------


def parse_freq(freq: str) -> tuple[int, str]:
    head = freq.lstrip("0123456789")
    n = int(freq[: len(freq) - len(head)] or 1)
    alias = {"T": "min", "h": "H", "s": "S", "d": "D", "M": "MS", "ME": "MS", "W": "W-SUN"}.get(head, head)
    if alias in UNIT_SECONDS or alias == "MS" or (alias.startswith("W-") and alias[2:] in WEEKDAYS):
        if n > 1 and alias not in UNIT_SECONDS:
            raise ValueError(f"multiples are supported for {list(UNIT_SECONDS)} only: {freq}")
        return n, alias
    raise ValueError(f"unknown frequency: {freq}")


def _anchor(freq: str, ds: Column, first: Column) -> Column:
    """Left label of a step, counted from midnight of the first day; weeks carry their closing day."""
    n, unit = parse_freq(freq)
    if unit == "MS":
        return F.date_trunc("month", ds).cast("timestamp_ntz")
    if unit.startswith("W-"):
        ahead = (F.lit(WEEKDAYS.index(unit[2:]) + 7) - F.weekday(ds)) % 7
        return F.date_add(F.to_date(ds), ahead).cast("timestamp_ntz")
    step = n * UNIT_SECONDS[unit] * 1_000_000
    origin = _micros(F.date_trunc("day", first).cast("timestamp_ntz"))
    return _from_micros(origin + F.floor((_micros(ds) - origin) / step).cast("bigint") * step)


def _grid(bounds: DataFrame, keys: Sequence[str], freq: str) -> DataFrame:
    """Every step from lo to hi. Short steps are made in two levels so that no array is long."""
    n, unit = parse_freq(freq)
    if unit == "MS":
        return bounds.select(*keys, F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 MONTH"))).alias("ds"))
    step = (7 * 86400 if unit.startswith("W-") else n * UNIT_SECONDS[unit]) * 1_000_000
    total = F.floor((_micros(F.col("hi")) - _micros(F.col("lo"))) / step).cast("bigint")
    block = 10_000
    outer = bounds.select(*keys, _micros(F.col("lo")).alias("_lo"), total.alias("_n"),
                          F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(total / block).cast("bigint"))).alias("_b"))
    inner = outer.select(*keys, "_lo", F.explode(F.sequence(
        F.col("_b") * block, F.least(F.col("_b") * block + (block - 1), F.col("_n")))).alias("_i"))
    return inner.select(*keys, _from_micros(F.col("_lo") + F.col("_i") * step).alias("ds"))


def resample_mean(series: DataFrame, freq: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean per step on a regular grid from first to last; empty steps are NULL."""
    keys = list(keys)
    n, unit = parse_freq(freq)
    if unit in UNIT_SECONDS and (n * UNIT_SECONDS[unit]) % 86400 and 86400 % (n * UNIT_SECONDS[unit]) or (
            unit in UNIT_SECONDS and n * UNIT_SECONDS[unit] > 86400):
        # steps that do not divide a day count from the first day of each series
        g = series.groupBy(*keys) if keys else series
        firsts = g.agg(F.min("ds").alias("_first"))
        tagged = series.join(firsts, keys) if keys else series.withColumn("_first", firsts.scalar())
        first = F.col("_first")
    else:
        tagged, first = series, F.lit("1970-01-01").cast("timestamp_ntz")
    steps = tagged.withColumn("ds", _anchor(freq, F.col("ds"), first)).groupBy(*keys, "ds").agg(F.avg("y").alias("y"))
    g = steps.groupBy(*keys) if keys else steps
    bounds = g.agg(F.min("ds").alias("lo"), F.max("ds").alias("hi")).filter("lo IS NOT NULL")
    return _grid(bounds, keys, freq).join(steps, [*keys, "ds"], "left")


# --- filling -------------------------------------------------------------------------------


def _neighbours(series: DataFrame, keys: Sequence[str], parts: int | None = None) -> DataFrame:
    """Add _pos and the nearest known (position, value) at or before and at or after each row."""
    keys = list(keys)
    ranged, n = with_range(series, "ds", parts)
    ranged = running_sums(ranged, keys, [F.col("ds")], {"_pos": F.lit(1).cast("bigint")}, n)
    known = F.when(F.col("y").isNotNull(), F.struct(F.col("_pos").alias("p"), F.col("y").alias("v")))
    w = Window.partitionBy(*keys, RANGE).orderBy("ds")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    out = ranged.withColumns({"_prev": F.last(known, True).over(back), "_next": F.first(known, True).over(ahead)})
    if n == 1:
        return out.drop(RANGE)
    edge = ranged.groupBy(*keys, RANGE).agg(F.max(known).alias("_l"), F.min(known).alias("_f"))
    by = Window.partitionBy(*keys).orderBy(RANGE)
    edge = edge.select(*keys, RANGE,
                       F.last("_l", True).over(by.rowsBetween(Window.unboundedPreceding, -1)).alias("_cp"),
                       F.first("_f", True).over(by.rowsBetween(1, Window.unboundedFollowing)).alias("_cn"))
    out = out.join(edge, [*keys, RANGE])
    return out.withColumns({"_prev": F.coalesce("_prev", "_cp"), "_next": F.coalesce("_next", "_cn")}).drop("_cp", "_cn", RANGE)


def interpolate_linear(series: DataFrame, keys: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Straight lines by position between known values; ends take the nearest known value."""
    near = _neighbours(series, keys, parts)
    p, q = F.col("_prev"), F.col("_next")
    line = p["v"] + (q["v"] - p["v"]) * (F.col("_pos") - p["p"]) / F.nullif(q["p"] - p["p"], F.lit(0))
    y = F.coalesce(F.col("y"), line, p["v"], q["v"])
    return near.withColumn("y", y).drop("_pos", "_prev", "_next")


def impute_series(series: DataFrame, how: str = "ffill", keys: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    if how == "none":
        return series
    if how == "zero":
        return series.fillna(0.0, ["y"])
    if how == "mean":
        return _with_stats(series, keys, {"_m": F.avg("y")}).withColumn("y", F.coalesce("y", "_m")).drop("_m")
    if how not in ("ffill", "bfill"):
        raise ValueError("impute must be ffill, bfill, zero, mean or none")
    near = _neighbours(series, keys, parts)
    pair = (F.col("_prev")["v"], F.col("_next")["v"])
    return near.withColumn("y", F.coalesce("y", *(pair if how == "ffill" else pair[::-1]))).drop("_pos", "_prev", "_next")


def _with_stats(series: DataFrame, keys: Sequence[str], stats: dict[str, Column]) -> DataFrame:
    """Per-series statistics next to each row: a pre-aggregated join, or a scalar subquery without keys."""
    if keys:
        facts = series.groupBy(*keys).agg(*[c.alias(n) for n, c in stats.items()])
        return series.join(facts, list(keys))
    facts = series.agg(F.struct(*[c.alias(n) for n, c in stats.items()]).alias("s"))
    return series.withColumn("_s", facts.scalar()).select(*series.columns, "_s.*")


def winsorize_sigma(series: DataFrame, sigma: float = 4.0, keys: Sequence[str] = ()) -> DataFrame:
    """Clip to mean +- sigma * std (n-1), for series of more than 20 rows."""
    out = _with_stats(series, keys, {"_n": F.count(F.lit(1)), "_mu": F.avg("y"), "_sd": F.stddev_samp("y")})
    lo, hi = F.col("_mu") - sigma * F.col("_sd"), F.col("_mu") + sigma * F.col("_sd")
    y = F.col("y")
    clipped = F.when((F.col("_n") > 20) & (y < lo), lo).when((F.col("_n") > 20) & (y > hi), hi).otherwise(y)
    return out.withColumn("y", clipped).drop("_n", "_mu", "_sd")


def prepare_series(df: DataFrame, date_col: str, target: str, freq: str | None = None, impute: str = "ffill",
                   clip_sigma: float | None = 4.0, keys: Sequence[str] = ()) -> DataFrame:
    """Select, resample and interpolate where a frequency is known, impute, winsorise.

    Without ``freq`` it is inferred per series; the few distinct frequencies found are handled one
    by one, series of no clear frequency keep their own timestamps.
    """
    keys = list(keys)
    series = to_series(df, date_col, target, keys)
    if freq:
        out = interpolate_linear(resample_mean(series, freq, keys), keys)
    else:
        found = infer_freq(series, keys)
        kinds = [r["freq"] for r in found.select("freq").distinct().collect()]
        out = None
        for kind in kinds:
            some = series
            if keys and len(kinds) > 1:
                mine = found.filter(F.col("freq").eqNullSafe(F.lit(kind))).select(*keys)
                some = series.join(mine, keys, "left_semi")
            if kind:
                some = interpolate_linear(resample_mean(some, kind, keys), keys)
            some = some.select(*keys, "ds", "y")
            out = some if out is None else out.unionByName(some)
        out = series if out is None else out
    out = impute_series(out, impute, keys)
    return (winsorize_sigma(out, clip_sigma, keys) if clip_sigma else out).select(*keys, "ds", "y")


# --- forecast helpers ----------------------------------------------------------------------


def future_frame(series: DataFrame, periods: int = 30, freq: str | None = None, keys: Sequence[str] = (),
                 history: bool = True) -> DataFrame:
    """History dates (distinct) plus ``periods`` steps after the last one; a day per step by default."""
    keys = list(keys)
    n, unit = parse_freq(freq or "D")
    g = series.groupBy(*keys) if keys else series
    last = g.agg(F.max("ds").alias("_last")).filter("_last IS NOT NULL")
    i = F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("_i")
    steps = last.select(*keys, "_last", i)
    if unit == "MS":
        ds = F.add_months(F.date_trunc("month", "_last"), F.col("_i")).cast("timestamp_ntz")
    elif unit.startswith("W-"):
        ahead = (F.lit(WEEKDAYS.index(unit[2:]) + 6) - F.weekday("_last")) % 7 + 1
        ds = F.date_add(F.to_date("_last"), ahead.cast("int") + (F.col("_i") - 1) * 7).cast("timestamp_ntz")
    else:
        ds = _from_micros(_micros(F.col("_last")) + F.col("_i").cast("bigint") * (n * UNIT_SECONDS[unit] * 1_000_000))
    future = steps.select(*keys, ds.alias("ds"))
    return series.select(*keys, "ds").distinct().unionByName(future) if history else future


def join_actuals(series: DataFrame, forecast: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return series.select(*keys, "ds", "y").join(forecast.select(*keys, "ds", "yhat"), [*keys, "ds"])


def forecast_metrics(pairs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, MAPE % and sMAPE % of (y, yhat)."""
    err = F.abs(F.col("y") - F.col("yhat"))
    eps = F.lit(1e-9)
    g = pairs.groupBy(*keys) if keys else pairs
    return g.agg(F.avg(err).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
                 (F.avg(err / F.greatest(F.abs("y"), eps)) * 100).alias("mape"),
                 F.avg(F.lit(200.0) * err / (F.abs("y") + F.abs("yhat") + eps)).alias("smape"))


def cv_cutoffs(series: DataFrame, horizon_days: float = 30, period_days: float | None = None,
               initial_days: float | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Rolling-origin cutoffs, counted back from (last - horizon) in steps of the period, as long as
    the first ``initial`` days stay before them. Defaults: period half the horizon, initial 3 horizons."""
    day = 86400 * 1_000_000
    h = int(horizon_days * day)
    p = int((period_days if period_days is not None else horizon_days / 2) * day)
    first = int((initial_days if initial_days is not None else horizon_days * 3) * day)
    g = series.groupBy(*keys) if keys else series
    b = g.agg(_micros(F.min("ds")).alias("lo"), _micros(F.max("ds")).alias("hi"))
    top = F.col("hi") - h
    n = F.floor((top - (F.col("lo") + first)) / p).cast("int")
    steps = b.filter(top >= F.col("lo") + first).select(*keys, top.alias("top"), F.explode(F.sequence(F.lit(0), n)).alias("i"))
    return steps.select(*keys, _from_micros(F.col("top") - F.col("i") * p).alias("cutoff"))
