"""Forecasting of any number of series: trend with changepoints, Fourier seasonality, holidays, regressors.

The fit is a ridge regression. Tasks fold their Arrow batches into per-series sums of outer products
(X'X, X'y), which are added up per series and solved there, so a long series is never gathered and
many short ones share tasks. Multiplicative seasonality takes a second pass with the seasonal columns
scaled by the fitted trend.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepkit.operators.dates import holiday_flag
from prepkit.operators.series import (
    cv_cutoffs,
    forecast_metrics,
    future_frame,
    infer_freq,
    join_actuals,
    seasonality_defaults,
    seasonality_mode,
)

CHANGEPOINTS = 25
CHANGEPOINT_RANGE = 0.8
YEARLY_TERMS, WEEKLY_TERMS, DAILY_TERMS = 10, 3, 4
TUNED_SCALES = (0.02, 0.05, 0.1)
NOISE = 0.05  # assumed noise of the scaled series; sets the ridge strength against the prior scales
SEASONAL_SCALE = 10.0
HINGE_RIDGE = 0.5  # slope changes are kept small unless the data insist
FLUSH_SERIES = 256


@dataclass(frozen=True)
class ForecastParams:
    periods: int = 30
    freq: str | None = None
    seasonality_mode: str = "auto"
    country_holidays: str | None = None
    growth: str = "linear"
    cap: float | None = None
    floor: float | None = None
    changepoint_prior_scale: float = 0.05
    weekly_seasonality: bool | None = None
    yearly_seasonality: bool | None = None
    daily_seasonality: bool | None = None
    regressors: tuple[str, ...] = ()
    tune_changepoint: bool = False
    cv_horizon_days: float = 30
    cv_period_days: float | None = None
    cv_initial_days: float | None = None


# Design layout: level, slope, hinges | yearly, weekly, daily | holiday, regressors
TREND = 2 + CHANGEPOINTS
SEASONAL = 2 * (YEARLY_TERMS + WEEKLY_TERMS + DAILY_TERMS)


def _design(t: np.ndarray, days: np.ndarray, use: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hinges = np.linspace(0, CHANGEPOINT_RANGE, CHANGEPOINTS + 1)[1:]
    trend = np.column_stack([np.ones_like(t), t, np.maximum(0.0, t[:, None] - hinges[None])])
    waves = []
    for on, period, terms in zip(use.T, (365.25, 7.0, 1.0), (YEARLY_TERMS, WEEKLY_TERMS, DAILY_TERMS)):
        k = 2 * np.pi * np.arange(1, terms + 1)[None] * (days[:, None] / period)
        waves += [np.sin(k) * on[:, None], np.cos(k) * on[:, None]]
    return trend, np.column_stack([*waves, extra])


def _penalty(scale: float, width: int) -> np.ndarray:
    lam = np.full(width, (NOISE / SEASONAL_SCALE) ** 2)
    lam[0] = lam[1] = (NOISE / 5.0) ** 2
    lam[2:TREND] = HINGE_RIDGE / scale
    return lam


def _describe(series: DataFrame, keys: list[str], p: ForecastParams) -> DataFrame:
    """Per series: time span, value scale, season switches and mode."""
    g = series.groupBy(*keys)
    days = F.unix_micros(F.col("ds").cast("timestamp")) / F.lit(86400e6)
    facts = g.agg(F.min(days).alias("t0"), F.max(days).alias("t1"), F.max(F.abs("y")).alias("scale"), F.count("*").alias("n"))
    freqs = infer_freq(series, keys) if p.freq is None else facts.select(*keys, F.lit(p.freq).alias("freq"))
    out = facts.join(seasonality_defaults(freqs), keys)
    for name, forced in (("yearly", p.yearly_seasonality), ("weekly", p.weekly_seasonality), ("daily", p.daily_seasonality)):
        if forced is not None:
            out = out.withColumn(name, F.lit(forced))
    if p.seasonality_mode == "auto":
        return out.join(seasonality_mode(series, keys), keys)
    return out.withColumn("mode", F.lit(p.seasonality_mode))


def _rows(series: DataFrame, facts: DataFrame, keys: list[str], extra: Sequence[str]) -> DataFrame:
    """(sid, t, days, use, extra, y) rows for the folds; sid is the series' text key."""
    days = F.unix_micros(F.col("ds").cast("timestamp")) / F.lit(86400e6)
    joined = series.join(facts.select(*keys, "t0", "t1", "scale", "yearly", "weekly", "daily", "mode"), keys)
    span = F.greatest(F.col("t1") - F.col("t0"), F.lit(1e-9))
    scale = F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0)
    y = [(F.col("y") / scale).alias("y")] if "y" in series.columns else []
    return joined.select(*keys, "ds", ((days - F.col("t0")) / span).alias("t"), days.alias("days"),
                         F.array(*[F.col(c).cast("double") for c in ("yearly", "weekly", "daily")]).alias("use"),
                         F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in extra]).cast("array<double>").alias("extra"),
                         scale.alias("scale"), (F.col("mode") == "multiplicative").alias("mult"), *y)


def _folder(keys: list[str], trend_only: bool):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        order: dict[tuple, tuple] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(*order[k], v.ravel().tolist()) for k, v in sums.items()], columns=[*keys, "m"])
            sums.clear()
            return out

        for pdf in batches:
            for key, part in pdf.groupby(keys, sort=False, dropna=False):
                trend, waves = _design(part["t"].to_numpy(), part["days"].to_numpy(), np.stack(part["use"].to_numpy()),
                                       np.stack(part["extra"].to_numpy()).reshape(len(part), -1))
                if not trend_only:
                    factor = np.where(part["mult"].to_numpy(), _trend_value(trend, part), 1.0)
                    waves = waves * factor[:, None]
                x = np.column_stack([trend, waves, part["y"].to_numpy()])
                key = key if isinstance(key, tuple) else (key,)
                order[key] = key
                sums[key] = sums.get(key, 0) + x.T @ x
                if len(sums) >= FLUSH_SERIES:
                    yield flush()
        if sums:
            yield flush()

    return fold


def _trend_value(trend: np.ndarray, part: pd.DataFrame) -> np.ndarray:
    beta = np.stack(part["beta"].to_numpy())[:, :TREND]
    return np.maximum((trend * beta).sum(1), 1e-6)


def _fit(rows: DataFrame, keys: list[str], width: int, scale: float, tuned: DataFrame | None = None,
         first: DataFrame | None = None) -> DataFrame:
    """(keys, beta). The changepoint prior scale is a number, or per series in ``tuned`` (_cps)."""
    fields = ", ".join(f"`{k}` {t}" for k, t in rows.select(*keys).dtypes)
    source = rows if first is None else rows.join(first, keys)
    partial = source.mapInPandas(_folder(keys, first is None), f"{fields}, m array<double>")
    if tuned is not None:
        partial = partial.join(tuned, keys)
    size = TREND + width + 1

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.sum([np.asarray(v) for v in pdf["m"]], axis=0).reshape(size, size)
        cps = float(pdf["_cps"].iloc[0]) if "_cps" in pdf else float(scale)
        a, b = m[:-1, :-1], m[:-1, -1]
        beta = np.linalg.solve(a + np.diag(_penalty(cps, size - 1)), b)
        return pd.DataFrame([[pdf[k].iloc[0] for k in keys] + [beta.tolist()]], columns=[*keys, "beta"])

    # sums of a series come one per task (and flush), so a group is small
    return partial.groupBy(*keys).applyInPandas(solve, f"{fields}, beta array<double>")


def _predict(rows: DataFrame, beta: DataFrame, keys: list[str]) -> DataFrame:
    fields = ", ".join(f"`{k}` {t}" for k, t in rows.select(*keys, "ds").dtypes)

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            trend, waves = _design(pdf["t"].to_numpy(), pdf["days"].to_numpy(), np.stack(pdf["use"].to_numpy()),
                                   np.stack(pdf["extra"].to_numpy()).reshape(len(pdf), -1))
            b = np.stack(pdf["beta"].to_numpy())
            level = (trend * b[:, :TREND]).sum(1)
            factor = np.where(pdf["mult"].to_numpy(), np.maximum(level, 1e-6), 1.0)
            out = pdf[[*keys, "ds"]].copy()
            out["yhat"] = (level + factor * (waves * b[:, TREND:]).sum(1)) * pdf["scale"].to_numpy()
            yield out

    return rows.join(beta, keys).mapInPandas(go, f"{fields}, yhat double")


def _bounded(p: ForecastParams) -> tuple[float, float]:
    if p.cap is None:
        raise ValueError("logistic growth needs a cap")
    return p.floor or 0.0, p.cap


def _to_line(y: Column, p: ForecastParams) -> Column:
    if p.growth != "logistic":
        return y
    lo, hi = _bounded(p)
    share = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), (y - lo) / (hi - lo)))
    return F.log(share / (1 - share))


def _from_line(y: Column, p: ForecastParams) -> Column:
    if p.growth != "logistic":
        return y
    lo, hi = _bounded(p)
    return F.lit(lo) + F.lit(hi - lo) / (1 + F.exp(-y))


def fit_forecast(series: DataFrame, params: ForecastParams = ForecastParams(), keys: Sequence[str] = (),
                 holidays: DataFrame | None = None, future_regressors: DataFrame | None = None,
                 at: DataFrame | None = None) -> DataFrame:
    """(keys, ds, yhat) for history and future. ``at`` gives the dates to predict instead.

    ``future_regressors`` holds the regressor columns for future dates, keyed by (keys, ds).
    """
    p = params
    if p.growth == "logistic":
        _bounded(p)
        p = replace(p, seasonality_mode="additive")
    keys = list(keys)
    single = not keys
    if single:
        keys = ["_series"]
        series = series.withColumn("_series", F.lit(0))
        at = at.withColumn("_series", F.lit(0)) if at is not None else None
        future_regressors = future_regressors.withColumn("_series", F.lit(0)) if future_regressors is not None else None
    known = series.filter("y IS NOT NULL").withColumn("y", _to_line(F.col("y"), p))
    facts = _describe(known, keys, p)
    if at is None:
        at = future_frame(series, p.periods, p.freq or "D", keys)
        if p.freq is None:
            at = _future_by_freq(series, facts, p.periods, keys)
    extra: list[str] = []
    if p.country_holidays and holidays is None:
        raise ValueError("country_holidays needs a calendar of holidays")
    if p.country_holidays:
        known = holiday_flag(known, "ds", holidays, p.country_holidays, "_holiday")
        at = holiday_flag(at, "ds", holidays, p.country_holidays, "_holiday")
        extra.append("_holiday")
    if p.regressors:
        history = series.select(*keys, "ds", *p.regressors)
        values = history if future_regressors is None else history.unionByName(future_regressors.select(*keys, "ds", *p.regressors))
        at = at.join(values.dropDuplicates([*keys, "ds"]), [*keys, "ds"], "left")
        if not at.filter(" OR ".join(f"`{r}` IS NULL" for r in p.regressors)).isEmpty():
            raise ValueError(f"regressors without a value at dates to forecast: {list(p.regressors)}")
        extra += list(p.regressors)
    width = SEASONAL + len(extra)
    scale_by_key = _tune(series, p, keys, holidays) if p.tune_changepoint else None
    rows = _rows(known, facts, keys, extra)
    beta = _fit_all(rows, keys, width, p, scale_by_key)
    out = _predict(_rows(at, facts, keys, extra), beta, keys).withColumn("yhat", _from_line(F.col("yhat"), p))
    return out.drop("_series") if single else out


def _fit_all(rows: DataFrame, keys: list[str], width: int, p: ForecastParams, tuned: DataFrame | None) -> DataFrame:
    """First pass without trend scaling; series with multiplicative seasons get a second one."""
    first = _fit(rows, keys, width, p.changepoint_prior_scale, tuned)
    if p.seasonality_mode == "additive":
        return first
    return _fit(rows, keys, width, p.changepoint_prior_scale, tuned, first)


def _future_by_freq(series: DataFrame, facts: DataFrame, periods: int, keys: list[str]) -> DataFrame:
    kinds = [r["freq"] for r in facts.select("freq").distinct().collect()]
    out = None
    for kind in kinds:
        mine = facts.filter(F.col("freq").eqNullSafe(F.lit(kind))).select(*keys)
        part = future_frame(series.join(mine, keys, "left_semi"), periods, kind or "D", keys)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else future_frame(series, periods, "D", keys)


def forecast_scores(series: DataFrame, forecast: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """In-sample MAE, RMSE, MAPE, sMAPE on the dates both have."""
    return forecast_metrics(join_actuals(series, forecast, keys), keys)


def rolling_origin_cv(series: DataFrame, params: ForecastParams = ForecastParams(), keys: Sequence[str] = (),
                      holidays: DataFrame | None = None) -> DataFrame:
    """(keys, cutoff, mae, rmse, mape, smape): every cutoff is refitted as one more series of the same job."""
    keys = list(keys)
    p = replace(params, tune_changepoint=False)
    cuts = cv_cutoffs(series, p.cv_horizon_days, p.cv_period_days, p.cv_initial_days, keys)
    series = series.filter("y IS NOT NULL")
    if keys:
        paired = series.join(cuts, keys)
    else:  # a short list of cutoffs, next to every row
        listed = cuts.agg(F.collect_list("cutoff")).scalar()
        paired = series.withColumn("cutoff", F.explode(listed))
    until = F.col("cutoff") + F.expr(f"INTERVAL '{int(p.cv_horizon_days * 86400)}' SECOND")
    train = paired.filter(F.col("ds") <= F.col("cutoff"))
    held = paired.filter((F.col("ds") > F.col("cutoff")) & (F.col("ds") <= until))
    grown = [*keys, "cutoff"]
    guess = fit_forecast(train, replace(p, regressors=()), grown, holidays, at=held.select(*grown, "ds").distinct())
    return forecast_metrics(join_actuals(held, guess, grown), grown)


def cv_scores(series: DataFrame, params: ForecastParams = ForecastParams(), keys: Sequence[str] = (),
              holidays: DataFrame | None = None) -> DataFrame:
    per = rolling_origin_cv(series, params, keys, holidays)
    g = per.groupBy(*keys) if keys else per
    return g.agg(F.avg("rmse").alias("rmse_cv"), F.avg("mape").alias("mape_cv"), F.avg("mae").alias("mae_cv"))


def _tune(series: DataFrame, p: ForecastParams, keys: list[str], holidays: DataFrame | None) -> DataFrame:
    """(keys, _cps): the changepoint scale with the lowest mean cross-validated MAPE per series."""
    tried = None
    for cps in TUNED_SCALES:
        one = cv_scores(series, replace(p, changepoint_prior_scale=cps), keys, holidays).withColumn("_cps", F.lit(cps))
        tried = one if tried is None else tried.unionByName(one)
    best = tried.groupBy(*keys).agg(F.min_by("_cps", "mape_cv").alias("_cps"))
    every = series.select(*keys).distinct().join(best, keys, "left")
    return every.withColumn("_cps", F.coalesce("_cps", F.lit(p.changepoint_prior_scale)))


def tune_changepoints(series: DataFrame, params: ForecastParams = ForecastParams(), keys: Sequence[str] = (),
                      holidays: DataFrame | None = None) -> DataFrame:
    """(keys, changepoint_prior_scale) chosen from 0.02, 0.05, 0.1."""
    keys = list(keys)
    if keys:
        return _tune(series, params, keys, holidays).withColumnRenamed("_cps", "changepoint_prior_scale")
    out = _tune(series.withColumn("_series", F.lit(0)), params, ["_series"], holidays)
    return out.select(F.col("_cps").alias("changepoint_prior_scale"))

