from __future__ import annotations

from pyspark.sql import functions as F

from checks import table
from prepkit.operators import profile as pf
from prepkit.plans.insights import eda_report, insights, recommendations

NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TEXT = ["l_returnflag", "l_linestatus"]


def _holes(spark, d):
    """lineitem with missing values and a constant column."""
    return table(spark, d, "lineitem").withColumns({
        "l_discount": F.expr("nullif(l_discount, 0.0D)"), "l_tax": F.expr("nullif(l_tax, 0.02D)"),
        "l_linestatus": F.expr("nullif(l_linestatus, 'O')")})


def _r(df, *cols, places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


def schema_profile(spark, d):
    return pf.schema_profile(table(spark, d, "lineitem"))


def missing_ratio(spark, d):
    return _r(pf.missing_ratio(_holes(spark, d)), "missing_ratio")


def constant_columns(spark, d):
    return pf.constant_columns(_holes(spark, d).withColumns({"k": F.lit(7), "t": F.lit("x")}))


def high_cardinality(spark, d):
    return _r(pf.high_cardinality(table(spark, d, "orders")), "distinct_ratio")


def infer_target(spark, d):
    rows = []
    for name in ("orders", "customer", "lineitem", "events", "part"):
        df = table(spark, d, name)
        found = pf.infer_target(df)
        rows.append(df.agg(F.lit(name).alias("table"), F.lit(found).cast("string").alias("target"), F.count("*").alias("n_rows")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def infer_problem_type(spark, d):
    cases = [("orders", "o_orderstatus"), ("orders", "o_totalprice"), ("lineitem", "l_quantity"), ("lineitem", "l_discount"),
             ("lineitem", "l_linenumber"), ("customer", "c_custkey")]
    out = None
    for name, col in cases:
        df = table(spark, d, name)
        kinds = {rule: pf.infer_problem_type(df, col, rule) for rule in ("insights", "baseline", "fusion")}
        r = df.agg(F.lit(f"{name}.{col}").alias("target"), F.count("*").alias("n_rows"),
                   *[F.lit(v).alias(k) for k, v in kinds.items()])
        out = r if out is None else out.unionByName(r)
    return out


def encode_target(spark, d):
    df = table(spark, d, "orders").withColumn("o_orderpriority", F.expr("nullif(o_orderpriority, '5-LOW')"))
    return pf.encode_target(df, "o_orderpriority").select("o_orderkey", "target_code")


def numeric_signals(spark, d):
    out = pf.numeric_signals(_holes(spark, d).drop("l_returnflag"), "l_extendedprice")
    return _r(pf.top_k(out), "score")


def recommend(spark, d):
    df = table(spark, d, "customer").withColumn("k", F.lit(1)).withColumn(
        "c_mktsegment", F.when(F.col("c_custkey") > 20, "A").otherwise(F.col("c_mktsegment")))
    found = recommendations(pf.constant_columns(df), pf.high_cardinality(df), "classification", pf.class_stats(df, "c_mktsegment"))
    return found


def describe_numeric(spark, d):
    out = pf.describe_numeric(_holes(spark, d))
    return _r(out, "mean", "std", "min", "q25", "q50", "q75", "max", places=4)


def describe_all(spark, d):
    out = pf.describe_all(_holes(spark, d).drop("l_shipdate"))
    out = out.withColumns({c: F.col(c).cast("double") for c in ("unique", "freq")})  # NULL for numeric columns
    return _r(out, "mean", "std", "min", "q25", "q50", "q75", "max", places=4)


def histogram(spark, d):
    out = pf.histogram(table(spark, d, "orders"), ["o_totalprice", "o_custkey"])
    return _r(out.withColumn("bin", F.col("bin").cast("bigint")), "bin_left", "bin_right", places=4)


def histogram_infinite(spark, d):
    """Infinite values have no bin and no part in the limits."""
    odd = table(spark, d, "orders").withColumn("o_totalprice", F.expr("CASE WHEN o_orderkey % 100 = 0 THEN double('inf') WHEN o_orderkey % 100 = 1 THEN double('-inf') ELSE o_totalprice END"))
    return _r(pf.histogram(odd, ["o_totalprice"]).withColumn("bin", F.col("bin").cast("bigint")), "bin_left", "bin_right", places=4)


def table_preview(spark, d):
    return pf.table_preview(table(spark, d, "orders"), order=["o_orderkey"])


def insight_rows(spark, d):
    return insights(table(spark, d, "orders"), "o_orderstatus").table()


def eda_rows(spark, d):
    parts = eda_report(table(spark, d, "lineitem"), {"f1": 0.5})
    out = None
    for name, df in parts.items():
        r = df.agg(F.lit(name).alias("table"), F.count("*").alias("n_rows"))
        out = r if out is None else out.unionByName(r)
    return out


QUERIES = {
    "schema_profile": schema_profile,
    "missing_ratio": missing_ratio,
    "missing_table": lambda s, d: pf.missing_table(_holes(s, d)),
    "null_counts": lambda s, d: pf.null_counts(_holes(s, d)),
    "quality_health": lambda s, d: pf.quality_health(_holes(s, d)).withColumn("cols", F.col("cols").cast("bigint")),
    "distinct_counts": lambda s, d: pf.distinct_counts(_holes(s, d)),
    "constant_columns": constant_columns,
    "high_cardinality": high_cardinality,
    "infer_target": infer_target,
    "infer_problem_type": infer_problem_type,
    "encode_target": encode_target,
    "numeric_signals": numeric_signals,
    "variance_signals": lambda s, d: _r(pf.variance_signals(table(s, d, "lineitem")), "score", places=3),
    "class_stats": lambda s, d: _r(pf.class_stats(table(s, d, "customer").withColumn(
        "c_mktsegment", F.expr("nullif(c_mktsegment, 'BUILDING')")), "c_mktsegment"), "fraction"),
    "recommendations": recommend,
    "insights": insight_rows,
    "describe_numeric": describe_numeric,
    "describe_all": describe_all,
    "correlation_matrix": lambda s, d: _r(pf.correlation_matrix(_holes(s, d)), "r"),
    "sample_rows": lambda s, d: pf.sample_rows(table(s, d, "orders"), 100, 42, ["o_orderkey"]),
    "head_rows": lambda s, d: pf.head(table(s, d, "orders"), 12, ["o_orderkey"]),
    "value_counts": lambda s, d: pf.value_counts(table(s, d, "part"), "p_name"),
    "histogram": histogram,
    "histogram_infinite": histogram_infinite,
    "table_preview": table_preview,
    "eda_report": eda_rows,
}

# --- SQL ------------------------------------------------------------------------------------

_HOLES = ("h AS (SELECT * REPLACE (nullif(l_discount, 0.0) AS l_discount, nullif(l_tax, 0.02) AS l_tax, "
          "nullif(l_linestatus, 'O') AS l_linestatus) FROM lineitem)")
_ALL = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus", "l_shipdate"]


def _each(cols, body, source="h"):
    return " UNION ALL ".join(body.format(c=c, s=source) for c in cols)


_MISSING = _each(_ALL, "SELECT '{c}' AS feature, count(*) AS n_rows, count(*) - count({c}) AS missing FROM {s}")
_STATS = ("count({c}) AS count{extra}, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c})::DOUBLE, 4) AS min, "
          "round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q25, round(quantile_cont({c}::DOUBLE, 0.5), 4) AS q50, "
          "round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q75, round(max({c})::DOUBLE, 4) AS max")
_TOPS = ("SELECT '{c}' AS feature, count({c}) AS count, count(DISTINCT {c})::DOUBLE AS \"unique\", "
         "(SELECT {c} FROM {s} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS top, "
         "(SELECT count(*)::DOUBLE FROM {s} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS freq, "
         "NULL::DOUBLE AS mean, NULL::DOUBLE AS std, NULL::DOUBLE AS min, NULL::DOUBLE AS q25, NULL::DOUBLE AS q50, "
         "NULL::DOUBLE AS q75, NULL::DOUBLE AS max FROM {s}")


def _kind(cols_float, t, c):
    n = f"(SELECT count(DISTINCT {c}) FROM {t})"
    few = f"{n} <= 50"
    ab = "'regression'" if cols_float else f"CASE WHEN {few} THEN 'classification' ELSE 'regression' END"
    return (f"SELECT '{t}.{c}' AS target, count(*) AS n_rows, {ab} AS insights, {ab} AS baseline, "
            f"CASE WHEN {few} THEN 'classification' ELSE 'regression' END AS fusion FROM {t}")


def _target(t, c, is_time=False):
    found = "NULL" if is_time else f"CASE WHEN (SELECT count(DISTINCT {c}) FROM {t}) > 0.95 * count(*) THEN NULL ELSE '{c}' END"
    return f"SELECT '{t}' AS \"table\", {found}::VARCHAR AS target, count(*) AS n_rows FROM {t}"


_DIGEST = "md5(o_orderkey::VARCHAR || '|42')"
_HIST = """SELECT feature, bin, round(lo + (bin - 1) * w, 4) AS bin_left, round(CASE WHEN bin = 30 THEN hi ELSE lo + bin * w END, 4) AS bin_right,
    coalesce(n, 0) AS n FROM (SELECT '{c}' AS feature, min({c}) AS lo, max({c}) AS hi, (max({c}) - min({c})) / 30.0 AS w FROM orders) b
    CROSS JOIN (SELECT unnest(range(1, 31)) AS bin) s
    LEFT JOIN (SELECT least(floor(({c} - (SELECT min({c}) FROM orders)) / ((SELECT max({c}) - min({c}) FROM orders) / 30.0))::BIGINT + 1, 30) AS bin,
                      count(*) AS n FROM orders GROUP BY 1) h USING (bin)"""

ORACLES = {
    "schema_profile": f"SELECT n_rows, 11::INT AS n_cols, (unnest(range(11)))::INT AS position, unnest({_ALL}) AS feature, "
                      "unnest(['bigint', 'bigint', 'bigint', 'int', 'double', 'double', 'double', 'double', 'string', 'string', 'timestamp_ntz']) AS dtype "
                      "FROM (SELECT count(*) AS n_rows FROM lineitem)",
    "missing_ratio": f"WITH {_HOLES} SELECT feature, n_rows, missing, round(missing / n_rows, 6) AS missing_ratio FROM ({_MISSING})",
    "missing_table": f"WITH {_HOLES} SELECT feature, missing, round(missing / n_rows * 100, 2) AS missing_pct FROM ({_MISSING}) WHERE missing > 0",
    "null_counts": f"WITH {_HOLES} SELECT feature, missing FROM ({_MISSING}) WHERE missing > 0",
    "quality_health": f"WITH {_HOLES} SELECT max(n_rows) AS rows, count(*) AS cols, count(*) FILTER (missing > 0)::INT AS cols_with_missing FROM ({_MISSING})",
    "distinct_counts": f"WITH {_HOLES} " + _each(_ALL, "SELECT '{c}' AS feature, count(*) AS n_rows, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS n_distinct FROM {s}"),
    "constant_columns": f"WITH {_HOLES}, g AS (SELECT *, 7 AS k, 'x' AS t FROM h) SELECT feature FROM ("
                        + _each([*_ALL, "k", "t"], "SELECT '{c}' AS feature, count(DISTINCT {c}) AS n FROM {s}", "g") + ") WHERE n = 1",
    "high_cardinality": "SELECT feature, n_distinct, round(n_distinct / n, 6) AS distinct_ratio FROM ("
                        + _each(["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
                                "SELECT '{c}' AS feature, count(DISTINCT {c}) AS n_distinct, count(*) AS n FROM {s}", "orders") + ") WHERE n_distinct / n >= 0.5",
    "infer_target": " UNION ALL ".join([_target("orders", "o_orderpriority"), _target("customer", "c_mktsegment"),
                                        _target("lineitem", "l_shipdate", True), _target("events", "props"), _target("part", "p_retailprice")]),
    "infer_problem_type": " UNION ALL ".join([_kind(False, "orders", "o_orderstatus"), _kind(True, "orders", "o_totalprice"),
                                              _kind(True, "lineitem", "l_quantity"), _kind(True, "lineitem", "l_discount"),
                                              _kind(False, "lineitem", "l_linenumber"), _kind(False, "customer", "c_custkey")]),
    "encode_target": "WITH t AS (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS p FROM orders) SELECT o_orderkey, "
                     "CASE WHEN p IS NULL THEN -1.0::DOUBLE ELSE (dense_rank() OVER (PARTITION BY p IS NULL ORDER BY p) - 1)::DOUBLE END AS target_code FROM t",
    "numeric_signals": f"WITH {_HOLES} " + _each([c for c in NUM if c != "l_extendedprice"],
                                                 "SELECT '{c}' AS feature, round(abs(corr({c}, l_extendedprice)), 6) AS score FROM {s}"),
    "variance_signals": _each(NUM, "SELECT '{c}' AS feature, round(var_pop({c}), 3) AS score FROM {s}", "lineitem"),
    "class_stats": "WITH t AS (SELECT nullif(c_mktsegment, 'BUILDING') AS label FROM customer) SELECT label, count(*) AS n, "
                   "round(count(*) / (SELECT count(*) FROM t), 6) AS fraction, (SELECT count(DISTINCT label) FROM t) AS n_classes FROM t GROUP BY label "
                   "ORDER BY n DESC, label LIMIT 10",
    "recommendations": "WITH t AS (SELECT *, 1 AS k, CASE WHEN c_custkey > 20 THEN 'A' ELSE c_mktsegment END AS seg FROM customer), "
                       "f AS (SELECT max(n) / sum(n) AS top FROM (SELECT count(*) AS n FROM t GROUP BY seg)), "
                       "c AS (" + _each(["c_custkey", "c_name", "c_nationkey", "c_acctbal", "seg", "k"],
                                        "SELECT '{c}' AS feature, count(DISTINCT {c}) AS nd, count(*) AS n FROM {s}", "t") + ") "
                       "SELECT 'constant' AS rule, 'Columns with one value, to be dropped: ' || string_agg(feature, ', ' ORDER BY feature) AS message FROM c WHERE nd = 1 HAVING count(*) > 0 UNION ALL "
                       "SELECT 'high_cardinality', 'Columns of mostly distinct values, to be encoded by target or hash: ' || string_agg(feature, ', ' ORDER BY feature) FROM c WHERE nd / n >= 0.5 HAVING count(*) > 0 UNION ALL "
                       "SELECT 'imbalance', printf('The largest class has %.1f%% of the rows: split by class, weight classes, judge by precision and recall.', top * 100) FROM f WHERE top > 0.8 UNION ALL "
                       "SELECT 'models', 'Compare boosted trees with a linear model, and calibrate before a threshold is set.' UNION ALL "
                       "SELECT 'drift', 'Track PSI of the features against the training table.'",
    "describe_numeric": f"WITH {_HOLES} " + _each(NUM, "SELECT '{c}' AS feature, " + _STATS.replace("{extra}", "") + " FROM {s}"),
    "describe_all": f"WITH {_HOLES} " + _each(NUM, "SELECT '{c}' AS feature, " + _STATS.replace(
        "{extra}", ", NULL::DOUBLE AS \"unique\", NULL::VARCHAR AS top, NULL::DOUBLE AS freq") + " FROM {s}") + " UNION ALL " + _each(TEXT, _TOPS),
    "correlation_matrix": f"WITH {_HOLES} " + " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}, {b}), 6) AS r FROM h" for a in NUM for b in NUM),
    "sample_rows": f"SELECT * FROM orders ORDER BY {_DIGEST} LIMIT 100",
    "head_rows": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 12",
    "value_counts": "SELECT p_name AS value, count(*) AS count FROM part GROUP BY 1 ORDER BY count DESC, value LIMIT 30",
    "histogram_infinite": _HIST.format(c="o_totalprice").replace("FROM orders", "FROM (SELECT * FROM orders WHERE o_orderkey % 100 > 1)"),
    "histogram": _HIST.format(c="o_totalprice") + " UNION ALL " + _HIST.format(c="o_custkey"),
    "table_preview": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 200",
}
