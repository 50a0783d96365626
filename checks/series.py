from __future__ import annotations

from pyspark.sql import functions as F

from checks import table
from prepkit.operators import conversations as cv
from prepkit.operators import series as sr
from prepkit.plans import forecast as fc
from checks.clean import holidays

KEY = ["o_orderpriority"]


TIE = 0.0000123  # means of cents fall on rounding ties; both sides step off them alike


def _r(df, *cols, places=6):
    return df.withColumns({c: F.round(F.col(c) + TIE, places) for c in cols})


def daily(spark, d, keys=KEY):
    return sr.to_series(table(spark, d, "orders"), "o_orderdate", "o_totalprice", keys)


def _steps(spark, d):
    """One row per priority and day, with holes: y is missing on a third of the days."""
    grid = sr.resample_mean(daily(spark, d), "D", KEY)
    return grid.withColumn("y", F.when(F.dayofyear("ds") % 3 != 0, F.col("y")))


def infer_freq(spark, d):
    return sr.infer_freq(sr.resample_mean(daily(spark, d), "D", KEY), KEY)


def seasonality_defaults(spark, d):
    hourly = sr.resample_mean(sr.to_series(table(spark, d, "events"), "ts", "value", ["event_type"]), "H", ["event_type"])
    monthly = sr.resample_mean(daily(spark, d), "MS", KEY).withColumnRenamed("o_orderpriority", "event_type")
    every = hourly.unionByName(monthly).unionByName(
        daily(spark, d).withColumnRenamed("o_orderpriority", "event_type").withColumn("event_type", F.concat("event_type", F.lit(" raw"))))
    return sr.seasonality_defaults(sr.infer_freq(every, ["event_type"]))


def seasonality_mode(spark, d):
    s = daily(spark, d).withColumn("y", F.when(F.col("o_orderpriority") == "5-LOW", F.col("y") - 300000).otherwise(F.col("y")))
    return sr.seasonality_mode(s, KEY)


def winsorize(spark, d):
    s = sr.resample_mean(daily(spark, d), "D", KEY)
    return _r(sr.winsorize_sigma(s, 1.0, KEY), "y", places=4)


def join_actuals(spark, d):
    s = sr.resample_mean(daily(spark, d), "W", KEY)
    shifted = s.select(*KEY, F.col("ds"), (F.col("y") * 1.01).alias("yhat")).filter("day(ds) > 7")
    return _r(sr.join_actuals(s.filter("y IS NOT NULL"), shifted, KEY), "y", "yhat", places=4)


def forecast_metrics(spark, d):
    s = sr.resample_mean(daily(spark, d), "D", KEY).filter("y IS NOT NULL")
    return _r(sr.forecast_metrics(s.withColumn("yhat", F.col("y") * 0.9 + 1000), KEY), "mae", "rmse", "mape", "smape", places=4)


def forecast(spark, d):
    weekly = sr.prepare_series(table(spark, d, "orders"), "o_orderdate", "o_totalprice", freq="W", keys=KEY)
    return fc.fit_forecast(weekly, fc.ForecastParams(periods=12, freq="W"), KEY)


def forecast_holidays(spark, d):
    s = sr.prepare_series(table(spark, d, "orders"), "o_orderdate", "o_totalprice", freq="D")
    return fc.fit_forecast(s, fc.ForecastParams(periods=30, country_holidays="PL", seasonality_mode="additive"), (), holidays(spark))


def forecast_regressor(spark, d):
    s = sr.prepare_series(table(spark, d, "orders"), "o_orderdate", "o_totalprice", freq="D").withColumn("promo", F.day("ds") % 2)
    later = sr.future_frame(s, 30, "D", history=False).withColumn("promo", F.day("ds") % 2)
    return fc.fit_forecast(s, fc.ForecastParams(periods=30, freq="D", regressors=("promo",)), (), None, later)


def forecast_logistic(spark, d):
    s = sr.prepare_series(table(spark, d, "orders"), "o_orderdate", "o_totalprice", freq="W")
    return fc.fit_forecast(s, fc.ForecastParams(periods=12, freq="W", growth="logistic", cap=1e6, floor=0.0))


def cv_scores(spark, d):
    s = sr.prepare_series(table(spark, d, "orders"), "o_orderdate", "o_totalprice", freq="W", keys=KEY)
    return fc.cv_scores(s, fc.ForecastParams(cv_horizon_days=180, cv_initial_days=1000, cv_period_days=365), KEY)


def tune(spark, d):
    s = sr.prepare_series(table(spark, d, "orders"), "o_orderdate", "o_totalprice", freq="MS")
    return fc.tune_changepoints(s, fc.ForecastParams(cv_horizon_days=365, cv_initial_days=1000))


QUERIES = {
    "infer_freq": infer_freq,
    "seasonality_defaults": seasonality_defaults,
    "seasonality_mode": seasonality_mode,
    "resample_mean": lambda s, d: _r(sr.resample_mean(daily(s, d), "D", KEY), "y", places=4),
    "resample_weekly": lambda s, d: _r(sr.resample_mean(daily(s, d, []), "W"), "y", places=4),
    "interpolate_linear": lambda s, d: _r(sr.interpolate_linear(_steps(s, d), KEY), "y", places=4),
    "impute_ffill": lambda s, d: _r(sr.impute_series(_steps(s, d), "ffill", KEY), "y", places=4),
    "impute_bfill": lambda s, d: _r(sr.impute_series(_steps(s, d), "bfill", KEY), "y", places=4),
    "impute_zero": lambda s, d: _r(sr.impute_series(_steps(s, d), "zero", KEY), "y", places=4),
    "impute_mean_series": lambda s, d: _r(sr.impute_series(_steps(s, d), "mean", KEY), "y", places=4),
    "winsorize_sigma": winsorize,
    "prepare_series": lambda s, d: _r(sr.prepare_series(table(s, d, "orders"), "o_orderdate", "o_totalprice", freq="D"), "y", places=4),
    "future_frame": lambda s, d: sr.future_frame(sr.resample_mean(daily(s, d), "D", KEY), 30, "D", KEY),
    "join_actuals": join_actuals,
    "forecast_metrics": forecast_metrics,
    "cv_cutoffs": lambda s, d: sr.cv_cutoffs(daily(s, d), 180, 90, 700, KEY),
    "forecast": forecast,
    "forecast_holidays": forecast_holidays,
    "forecast_regressor": forecast_regressor,
    "forecast_logistic": forecast_logistic,
    "cv_scores": cv_scores,
    "tune_changepoints": tune,
    "approx_tokens": lambda s, d: cv.approx_tokens(table(s, d, "conversations")),
    "context_window": lambda s, d: cv.context_window(table(s, d, "conversations"), 300, 4).withColumn("text", F.md5("text")),
}

# --- SQL ------------------------------------------------------------------------------------

_D = ("d AS (SELECT o_orderpriority, o_orderdate::DATE::TIMESTAMP AS ds, avg(o_totalprice) AS y FROM orders GROUP BY ALL), "
      "g AS (SELECT o_orderpriority, unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS ds FROM d GROUP BY o_orderpriority), "
      "grid AS (SELECT g.o_orderpriority, g.ds, d.y FROM g LEFT JOIN d USING (o_orderpriority, ds)), "
      "holes AS (SELECT o_orderpriority, ds, CASE WHEN dayofyear(ds) % 3 <> 0 THEN y END AS y FROM grid)")
_ONE = ("d AS (SELECT o_orderdate::DATE::TIMESTAMP AS ds, avg(o_totalprice) AS y FROM orders GROUP BY ALL), "
        "g AS (SELECT unnest(generate_series(min(ds), max(ds), INTERVAL 1 DAY)) AS ds FROM d), "
        "holes AS (SELECT 1 AS o_orderpriority, g.ds, d.y FROM g LEFT JOIN d USING (ds))")
_NEAR = ("near AS (SELECT *, last_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pp, last_value(y IGNORE NULLS) OVER b AS pv, "
         "first_value(CASE WHEN y IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS qp, first_value(y IGNORE NULLS) OVER a AS qv "
         "FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY ds) AS pos FROM holes) "
         "WINDOW b AS (PARTITION BY o_orderpriority ORDER BY ds ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), "
         "a AS (PARTITION BY o_orderpriority ORDER BY ds ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))")
_LINE = "coalesce(y, pv + (qv - pv) * (pos - pp) / nullif(qp - pp, 0), pv, qv)"
_WEEK = "(o_orderdate::DATE + ((13 - (isodow(o_orderdate) - 1)) % 7)::INT)::TIMESTAMP"
_W = f"w AS (SELECT o_orderpriority, {_WEEK} AS ds, avg(o_totalprice) AS y FROM orders GROUP BY ALL)"


def _filled(expr):
    return f"WITH {_D}, {_NEAR} SELECT o_orderpriority, ds, round({expr} + 0.0000123, 4) AS y FROM near"


ORACLES = {
    "infer_freq": "SELECT DISTINCT o_orderpriority, 'D' AS freq FROM orders",
    "seasonality_defaults": "SELECT DISTINCT event_type, 'H' AS freq, true AS daily, true AS weekly, true AS yearly FROM events UNION ALL "
                            "SELECT DISTINCT o_orderpriority, 'MS', false, false, true FROM orders UNION ALL "
                            "SELECT DISTINCT o_orderpriority || ' raw', NULL, false, true, true FROM orders",
    "seasonality_mode": "SELECT o_orderpriority, CASE WHEN bool_and(CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice - 300000 ELSE o_totalprice END > 0) "
                        "THEN 'multiplicative' ELSE 'additive' END AS mode FROM orders GROUP BY 1",
    "resample_mean": f"WITH {_D} SELECT o_orderpriority, ds, round(y + 0.0000123, 4) AS y FROM grid",
    "resample_weekly": f"WITH w AS (SELECT {_WEEK} AS ds, avg(o_totalprice) AS y FROM orders GROUP BY 1), "
                       "g AS (SELECT unnest(generate_series(min(ds), max(ds), INTERVAL 7 DAY)) AS ds FROM w) "
                       "SELECT ds, round(y + 0.0000123, 4) AS y FROM g LEFT JOIN w USING (ds)",
    "interpolate_linear": _filled(_LINE),
    "impute_ffill": _filled("coalesce(y, pv, qv)"),
    "impute_bfill": _filled("coalesce(y, qv, pv)"),
    "impute_zero": _filled("coalesce(y, 0.0)"),
    "impute_mean_series": f"WITH {_D} SELECT o_orderpriority, ds, round(coalesce(y, avg(y) OVER (PARTITION BY o_orderpriority)) + 0.0000123, 4) AS y FROM holes",
    "winsorize_sigma": f"WITH {_D}, s AS (SELECT o_orderpriority, count(*) AS n, avg(y) AS mu, stddev_samp(y) AS sd FROM grid GROUP BY 1) "
                       "SELECT o_orderpriority, ds, round(CASE WHEN n > 20 AND y < mu - sd THEN mu - sd WHEN n > 20 AND y > mu + sd THEN mu + sd ELSE y END + 0.0000123, 4) AS y "
                       "FROM grid JOIN s USING (o_orderpriority)",
    "prepare_series": f"WITH {_ONE}, {_NEAR}, f AS (SELECT ds, {_LINE} AS y FROM near), s AS (SELECT avg(y) AS mu, stddev_samp(y) AS sd FROM f) "
                      "SELECT ds, round(least(greatest(y, mu - 4 * sd), mu + 4 * sd) + 0.0000123, 4) AS y FROM f, s",
    "future_frame": f"WITH {_D}, m AS (SELECT o_orderpriority, max(ds) AS top FROM g GROUP BY 1) SELECT o_orderpriority, ds FROM g UNION ALL "
                    "SELECT o_orderpriority, top + INTERVAL 1 DAY * i FROM m, (SELECT unnest(range(1, 31)) AS i)",
    "join_actuals": f"WITH {_W} SELECT o_orderpriority, ds, round(y + 0.0000123, 4) AS y, round(y * 1.01 + 0.0000123, 4) AS yhat FROM w WHERE day(ds) > 7",
    "forecast_metrics": f"WITH {_D}, p AS (SELECT o_orderpriority, y, y * 0.9 + 1000 AS h FROM d) SELECT o_orderpriority, round(avg(abs(y - h)) + 0.0000123, 4) AS mae, "
                        "round(sqrt(avg((y - h) * (y - h))) + 0.0000123, 4) AS rmse, round(avg(abs(y - h) / greatest(abs(y), 1e-9)) * 100 + 0.0000123, 4) AS mape, "
                        "round(avg(200.0 * abs(y - h) / (abs(y) + abs(h) + 1e-9)) + 0.0000123, 4) AS smape FROM p GROUP BY 1",
    "cv_cutoffs": "WITH b AS (SELECT o_orderpriority, min(o_orderdate) AS lo, max(o_orderdate) - INTERVAL 180 DAY AS top FROM orders GROUP BY 1) "
                  "SELECT o_orderpriority, cutoff::TIMESTAMP AS cutoff FROM (SELECT o_orderpriority, lo, unnest(generate_series(top, lo, INTERVAL '-90' DAY)) AS cutoff FROM b) "
                  "WHERE cutoff >= lo + INTERVAL 700 DAY",
    "approx_tokens": "SELECT conv_id, greatest(1, sum(length(text) + length(role)) // 4)::BIGINT AS tokens FROM conversations GROUP BY conv_id",
    "context_window": """WITH m AS (SELECT *, length(text) + length(role) AS size FROM conversations),
        sys AS (SELECT conv_id, sum(size) AS s FROM m WHERE role = 'system' GROUP BY 1),
        r AS (SELECT *, row_number() OVER w AS back, sum(size) OVER w AS run FROM m WHERE role <> 'system' WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
        SELECT conv_id, turn, role, md5(text) AS text FROM m WHERE role = 'system' UNION ALL
        SELECT r.conv_id, turn, role, md5(text) FROM r LEFT JOIN sys USING (conv_id)
        WHERE back <= 4 AND (back = 1 OR (coalesce(s, 0) + run) // 4 <= 300)""",
}
