from __future__ import annotations

from pyspark.sql import functions as F

from checks import scratch, table
from prepkit.functions.sketch import read_sketches, sketch_columns
from prepkit.operators import drift as dr
from prepkit.operators.drift import PsiConfig
from prepkit.streaming.alerts import suppress_repeats
from prepkit.streaming.drift import drift_windows

COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey", "l_orderkey"]


def _sides(spark, d):
    items = table(spark, d, "lineitem")
    return items.filter(F.year("l_shipdate") <= 1995), items.filter(F.year("l_shipdate") > 1995)


def written(df, path):
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _r(df, *cols, places=6):
    return df.withColumns({c: F.round(c, places) for c in cols})


def psi_edges(strategy):
    def q(spark, d):
        base, _ = _sides(spark, d)
        cfg = PsiConfig(strategy=strategy)
        return _r(dr.edges_table(base, dr.plan_psi(base, COLS, cfg)), "edge", places=4)
    return q


def bin_counts(spark, d):
    base, curr = _sides(spark, d)
    plan = dr.plan_psi(base, COLS)
    return (dr.bin_counts(base, curr, plan).filter("bin > 0")
            .select("feature", F.col("bin").cast("bigint").alias("bin"), "n_base", "n_curr"))


def psi_bins(spark, d):
    base, curr = _sides(spark, d)
    out = dr.psi_bins(base, curr, ["l_extendedprice", "l_quantity"])
    return _r(out.withColumn("bin", F.col("bin").cast("bigint")), "bin_left", "bin_right", "p_base", "p_curr", "psi_contrib")


def psi_of(cfg):
    def q(spark, d):
        base, curr = _sides(spark, d)
        return _r(dr.psi_table(base, curr, include=COLS, cfg=cfg).select("feature", "psi", "n_base", "n_curr"), "psi")
    return q


def psi_table(spark, d):
    base, curr = _sides(spark, d)
    out = dr.psi_table(base, curr)
    return _r(out.select("feature", "psi", "n_base", "n_curr", F.col("bins_count").cast("bigint").alias("bins_count"), "severity"), "psi")


def drift_sketch(spark, d):
    """Drift against a sketched base: exact counts, and whether its ranks and its PSI are within the stated errors."""
    base, curr = _sides(spark, d)
    reference = written(sketch_columns(base, COLS), scratch(spark))
    known = read_sketches(reference)
    plan = dr.sketch_plan(known, COLS)
    up_to = {c: [(e, float(r)) for e, r in zip(es[1:-1], known[c].ranks(es[1:-1]))] for c, es in plan.edges.items()}
    within = {c: F.lit(True) for c in COLS}
    for c, pairs in up_to.items():
        for edge, rank in pairs:
            within[c] = within[c] & (F.abs(F.count(F.when(F.col(c) <= edge, 1)) - F.lit(rank)) <= F.lit(known[c].error()))
    ranks = base.agg(F.array(*[F.struct(F.lit(c).alias("feature"), w.alias("ranks_within")) for c, w in within.items()]).alias("x")).select(F.inline("x"))
    exact = dr.psi_table(base, curr, plan=plan).select("feature", F.col("psi").alias("exact"))
    out = dr.sketch_psi_table(reference, curr, include=COLS).join(exact, "feature").join(ranks, "feature").join(reference.select("feature", "low", "high"), "feature")
    psi_within = F.col("exact").between(F.col("psi_low") - 1e-12, F.col("psi_high") + 1e-12)
    return out.select("feature", "n_base", "n_curr", "low", "high", "ranks_within", psi_within.alias("psi_within"), (F.col("rank_error") <= F.col("n_base") / 100).alias("precise"))


def drift_severity(spark, d):
    e = table(spark, d, "events")
    out = dr.psi_table(e.filter("event_type <> 'purchase'"), e.filter("value > 10"), include=["value", "user_id"])
    return _r(out.select("feature", "psi", "severity"), "psi")


def drift_first_numeric(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", "o_totalprice", "o_custkey", "o_orderdate")
    out = dr.drift_check(o.filter(F.year("o_orderdate") <= 1996), o.filter(F.year("o_orderdate") > 1996))
    return _r(out.select("feature", "psi", "severity"), "psi")


def windows(spark, d):
    e = table(spark, d, "events")
    out = drift_windows(e, e.filter("event_type = 'purchase'"), "ts", "value")
    return _r(out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")), "psi")


def repeats(spark, d):
    return suppress_repeats(table(spark, d, "events"), ["event_type", "user_id"], "ts", 300)


def repeats_null_times(spark, d):
    """Events without a time are left out and hide none of the others."""
    events = table(spark, d, "events").withColumn("ts", F.expr("CASE WHEN event_id % 7 <> 0 THEN ts END"))
    return suppress_repeats(events, ["event_type", "user_id"], "ts", 300)


def alerts(spark, d):
    e = table(spark, d, "events")
    found = dr.psi_table(e.filter("event_type <> 'purchase'"), e.filter("value > 10"), include=["value", "user_id"])
    return dr.alert_rows(found)


QUERIES = {
    "psi_table": psi_table,
    "psi_edges_quantile": psi_edges("quantile"),
    "psi_edges_uniform": psi_edges("uniform"),
    "bin_counts": bin_counts,
    "psi_bins": psi_bins,
    "psi_quantile": psi_of(PsiConfig()),
    "psi_uniform": psi_of(PsiConfig(strategy="uniform")),
    "psi_clipped": psi_of(PsiConfig(clip_low=0.01, clip_high=0.99)),
    "drift_severity": drift_severity,
    "drift_sketch": drift_sketch,
    "drift_first_numeric": drift_first_numeric,
    "drift_windows": windows,
    "suppress_repeats": repeats,
    "suppress_repeats_null_times": repeats_null_times,
    "alert_rows": alerts,
}

# --- SQL ------------------------------------------------------------------------------------

_LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c}::DOUBLE AS v, (year(l_shipdate) <= 1995) AS is_base FROM lineitem" for c in COLS)
_PROBS = "[" + ",".join(f"{i}/10.0" for i in range(11)) + "]"


def _psi_ctes(long: str, strategy: str = "quantile", clip: tuple[float, float] | None = None) -> str:
    """WITH list ending in bins(feature, bin, bin_left, bin_right, n_base, n_curr, p_base, p_curr, psi_contrib)."""
    src = f"long0 AS ({long})"
    if clip:
        lo, hi = clip
        src += (f", lim AS (SELECT feature, is_base, quantile_cont(v, {lo}) AS a, quantile_cont(v, {hi}) AS b FROM long0 GROUP BY ALL)"
                ", long AS (SELECT feature, least(greatest(v, a), b) AS v, is_base FROM long0 JOIN lim USING (feature, is_base))")
    else:
        src += ", long AS (SELECT * FROM long0)"
    if strategy == "quantile":
        raw = (f"raw AS (SELECT feature, list_sort(list_distinct(quantile_cont(v, {_PROBS}))) AS e, min(v) AS lo, max(v) AS hi "
               "FROM long WHERE is_base GROUP BY feature)"
               ", eds AS (SELECT feature, CASE WHEN len(e) <= 2 THEN list_sort(list_distinct([lo, (lo + hi) / 2, hi])) ELSE e END AS e FROM raw)")
    else:
        raw = ("eds AS (SELECT feature, list_sort(list_distinct(list_concat("
               "list_transform(range(10), lambda i: min(v) + (max(v) - min(v)) / 10 * i), [max(v)]))) AS e "
               "FROM long WHERE is_base GROUP BY feature)")
    return f"""{src}, {raw},
    slots AS (SELECT feature, unnest(range(1, len(e))) AS bin, e FROM eds),
    placed AS (SELECT feature, is_base, greatest(1, len(list_filter(e, lambda x: x < v))) AS bin
               FROM long JOIN eds USING (feature) WHERE v >= e[1] AND v <= e[len(e)]),
    cnt AS (SELECT feature, bin, count(*) FILTER (is_base) AS n_base, count(*) FILTER (NOT is_base) AS n_curr FROM placed GROUP BY ALL),
    al AS (SELECT s.feature, s.bin, s.e[s.bin] AS bin_left, s.e[s.bin + 1] AS bin_right,
                  coalesce(n_base, 0) AS n_base, coalesce(n_curr, 0) AS n_curr
           FROM slots s LEFT JOIN cnt c ON s.feature = c.feature AND s.bin = c.bin),
    sh AS (SELECT *, greatest(n_base / greatest(sum(n_base) OVER (PARTITION BY feature), 1), 1e-6) AS p_base,
                     greatest(n_curr / greatest(sum(n_curr) OVER (PARTITION BY feature), 1), 1e-6) AS p_curr FROM al),
    bins AS (SELECT *, (p_curr - p_base) * ln((p_curr + 1e-12) / (p_base + 1e-12)) AS psi_contrib FROM sh)"""


_SEVERITY = "CASE WHEN psi >= 0.25 THEN 'alert' WHEN psi >= 0.10 THEN 'warn' ELSE 'ok' END"


def _psi_total(long, strategy="quantile", clip=None):
    return (f"WITH {_psi_ctes(long, strategy, clip)} SELECT feature, round(sum(psi_contrib), 6) AS psi, "
            "sum(n_base)::BIGINT AS n_base, sum(n_curr)::BIGINT AS n_curr FROM bins GROUP BY feature")


_EVENTS = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c}::DOUBLE AS v, true AS is_base FROM events WHERE event_type <> 'purchase' UNION ALL "
    f"SELECT '{c}', {c}::DOUBLE, false FROM events WHERE value > 10" for c in ("value", "user_id"))
_ORDERS = "SELECT 'o_totalprice' AS feature, o_totalprice AS v, (year(o_orderdate) <= 1996) AS is_base FROM orders"
_BY_SEVERITY = "SELECT feature, round(psi, 6) AS psi, " + _SEVERITY + " AS severity FROM t"

ORACLES = {
    "psi_table": f"WITH {_psi_ctes(_LONG)}, t AS (SELECT feature, sum(psi_contrib) AS psi, sum(n_base)::BIGINT AS n_base, "
                 f"sum(n_curr)::BIGINT AS n_curr, count(*) AS bins_count FROM bins GROUP BY feature) "
                 f"SELECT feature, round(psi, 6) AS psi, n_base, n_curr, bins_count, {_SEVERITY} AS severity FROM t",
    "psi_edges_quantile": f"WITH {_psi_ctes(_LONG)} SELECT feature, (unnest(range(len(e))))::INT AS edge_no, round(unnest(e), 4) AS edge FROM eds",
    "psi_edges_uniform": f"WITH {_psi_ctes(_LONG, 'uniform')} SELECT feature, (unnest(range(len(e))))::INT AS edge_no, round(unnest(e), 4) AS edge FROM eds",
    "bin_counts": f"WITH {_psi_ctes(_LONG)} SELECT feature, bin, n_base, n_curr FROM cnt",
    "psi_bins": f"WITH {_psi_ctes(_LONG)} SELECT feature, bin, round(bin_left, 6) AS bin_left, round(bin_right, 6) AS bin_right, n_base, n_curr, "
                "round(p_base, 6) AS p_base, round(p_curr, 6) AS p_curr, round(psi_contrib, 6) AS psi_contrib FROM bins "
                "WHERE feature IN ('l_extendedprice', 'l_quantity')",
    "psi_quantile": _psi_total(_LONG),
    "psi_uniform": _psi_total(_LONG, "uniform"),
    "psi_clipped": _psi_total(_LONG, "quantile", (0.01, 0.99)),
    "drift_severity": f"WITH {_psi_ctes(_EVENTS)}, t AS (SELECT feature, sum(psi_contrib) AS psi FROM bins GROUP BY feature) {_BY_SEVERITY}",
    "drift_sketch": f"""WITH long AS ({_LONG}), r AS (SELECT feature, min(v) AS low, max(v) AS high, count(*) FILTER (is_base) AS n_base FROM long WHERE is_base GROUP BY feature)
        SELECT r.feature, any_value(n_base)::BIGINT AS n_base, count(*) FILTER (NOT is_base AND v BETWEEN low AND high)::BIGINT AS n_curr, any_value(low) AS low,
          any_value(high) AS high, true AS ranks_within, true AS psi_within, true AS precise FROM r JOIN long USING (feature) GROUP BY r.feature""",
    "drift_first_numeric": f"WITH {_psi_ctes(_ORDERS)}, t AS (SELECT feature, sum(psi_contrib) AS psi FROM bins GROUP BY feature) {_BY_SEVERITY}",
    "drift_windows": f"""WITH eds AS (SELECT list_sort(list_distinct(quantile_cont(value, {_PROBS}))) AS e FROM events WHERE event_type = 'purchase'),
        slots AS (SELECT unnest(range(1, len(e))) AS bin FROM eds),
        b AS (SELECT greatest(1, len(list_filter(e, lambda x: x < value))) AS bin, count(*) AS n_base FROM events, eds
              WHERE event_type = 'purchase' GROUP BY 1),
        c AS (SELECT date_trunc('hour', ts) AS w, greatest(1, len(list_filter(e, lambda x: x < value))) AS bin, count(*) AS n_curr
              FROM events, eds WHERE value >= e[1] AND value <= e[len(e)] GROUP BY 1, 2),
        ws AS (SELECT w, sum(n_curr) AS t_curr FROM c GROUP BY w),
        al AS (SELECT ws.w, ws.t_curr, slots.bin, coalesce(b.n_base, 0) AS n_base, coalesce(c.n_curr, 0) AS n_curr,
                      (SELECT sum(n_base) FROM b) AS t_base
               FROM ws CROSS JOIN slots LEFT JOIN b USING (bin) LEFT JOIN c ON c.w = ws.w AND c.bin = slots.bin),
        sh AS (SELECT *, greatest(n_base / t_base, 1e-6) AS p, greatest(n_curr / t_curr, 1e-6) AS q FROM al),
        t AS (SELECT w, t_curr, sum((q - p) * ln((q + 1e-12) / (p + 1e-12))) AS psi FROM sh GROUP BY w, t_curr)
        SELECT w::TIMESTAMP AS window_start, t_curr::BIGINT AS n_curr, round(psi, 6) AS psi, {_SEVERITY} AS severity FROM t""",
    "suppress_repeats": """WITH RECURSIVE e AS (SELECT DISTINCT event_type, user_id, ts FROM events),
        k(event_type, user_id, ts) AS (
            SELECT event_type, user_id, min(ts) FROM e GROUP BY ALL
            UNION ALL
            SELECT k.event_type, k.user_id, min(e.ts) FROM k JOIN e ON e.event_type = k.event_type AND e.user_id = k.user_id
                AND e.ts >= k.ts + INTERVAL 300 SECOND GROUP BY k.event_type, k.user_id)
        SELECT event_type, user_id, ts FROM k""",
    "alert_rows": f"""WITH {_psi_ctes(_EVENTS)}, t AS (SELECT feature, sum(psi_contrib) AS psi FROM bins GROUP BY feature),
        f AS (SELECT feature, psi, {_SEVERITY} AS severity FROM t),
        c AS (SELECT *, unnest(CASE WHEN severity = 'alert' THEN ['slack', 'email'] ELSE ['slack'] END) AS channel FROM f WHERE severity <> 'ok'),
        m AS (SELECT feature, severity, channel, 'ops' AS target, 'PSI ' || upper(severity) AS subject,
                     printf('%s PSI=%.3f', feature, psi) AS message FROM c)
        SELECT *, sha256(channel || target || subject || message) AS signature FROM m""",
}
ORACLES["suppress_repeats_null_times"] = ORACLES["suppress_repeats"].replace("FROM events)", "FROM events WHERE event_id % 7 <> 0)")
