"""Population stability between a base and a current table.

Bin edges are decided from the base in one aggregate. Both tables are then binned and counted in a
single pass for all columns; everything after that works on (features x bins) rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepkit.functions.columns import aggregate_rows, local_rows, number, numeric_columns, quoted
from prepkit.functions.folds import COUNT_SCHEMA, bin_counter, right_closed
from prepkit.functions.sketch import Sketch, read_sketches
from prepkit.operators.quantiles import linear_quantiles

WARN_AT = 0.10
ALERT_AT = 0.25


@dataclass(frozen=True)
class PsiConfig:
    bins: int = 10
    strategy: str = "quantile"
    min_bin_pct: float = 1e-6
    epsilon: float = 1e-12
    clip_low: float | None = None
    clip_high: float | None = None

    def __post_init__(self) -> None:
        if self.strategy not in ("quantile", "uniform"):
            raise ValueError("strategy must be 'quantile' or 'uniform'")


@dataclass(frozen=True)
class PsiPlan:
    """Everything decided from data before counting; reusable on new current tables and streams."""

    config: PsiConfig
    edges: dict[str, list[float]]
    base_clip: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    curr_clip: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)


def shared_numeric(base: DataFrame, curr: DataFrame, include: Sequence[str] | None = None,
                   exclude: Sequence[str] | None = None) -> list[str]:
    names = include if include is not None else numeric_columns(base)
    return [c for c in names if c in base.columns and c in curr.columns and c not in (exclude or ())]


def _even(lo: float, hi: float, parts: int) -> list[float]:
    step = (hi - lo) / parts
    return [lo + step * i for i in range(parts)] + [hi]


def _distinct(edges: Sequence[float]) -> list[float]:
    return sorted(set(edges))


def quantile_edges(values: Sequence[float | None], bins: int) -> list[float]:
    """Distinct bin edges from bins+1 base quantiles; two equal bins when too few stay distinct."""
    if values[0] is None:
        return []
    edges = _distinct(values)
    if len(edges) <= 2:
        edges = _distinct(_even(edges[0], edges[-1], min(bins, 2)))
    return edges


def uniform_edges(lo: float | None, hi: float | None, bins: int) -> list[float]:
    return [] if lo is None else _distinct(_even(lo, hi, bins))


def _clip_bounds(df: DataFrame, cols: Sequence[str], cfg: PsiConfig) -> dict[str, tuple[float | None, float | None]]:
    asked = [q for q in (cfg.clip_low, cfg.clip_high) if q is not None]
    if not asked:
        return {c: (None, None) for c in cols}
    found = linear_quantiles(df, cols, asked)
    return {c: (found[c][0] if cfg.clip_low is not None else None,
                found[c][-1] if cfg.clip_high is not None else None) for c in cols}


def _clipped(x: Column, bounds: tuple[float | None, float | None]) -> Column:
    lo, hi = bounds
    x = x if lo is None else F.when(x < F.lit(lo), F.lit(lo)).otherwise(x)
    return x if hi is None else F.when(x > F.lit(hi), F.lit(hi)).otherwise(x)


def clip_for_drift(df: DataFrame, cols: Sequence[str], cfg: PsiConfig) -> DataFrame:
    """Clip each column by this table's own quantiles (NULLs stay NULL)."""
    bounds = _clip_bounds(df, cols, cfg)
    return df.withColumns({c: _clipped(number(df, c), bounds[c]) for c in cols})


def plan_psi(base: DataFrame, cols: Sequence[str], cfg: PsiConfig = PsiConfig(),
             curr: DataFrame | None = None) -> PsiPlan:
    """Decide clip bounds and bin edges."""
    clips = _clip_bounds(base, cols, cfg)
    source = base.select(*[_clipped(number(base, c), clips[c]).alias(c) for c in cols])
    if cfg.strategy == "quantile":
        probs = [i / cfg.bins for i in range(cfg.bins + 1)]
        edges = {c: quantile_edges(v, cfg.bins) for c, v in linear_quantiles(source, cols, probs).items()}
    else:
        rows = aggregate_rows(source, cols, {"lo": lambda c: F.min(quoted(c)), "hi": lambda c: F.max(quoted(c))})
        edges = {r["feature"]: uniform_edges(r["lo"], r["hi"], cfg.bins) for r in rows.collect()}
    curr_clips = _clip_bounds(curr, cols, cfg) if curr is not None else {c: (None, None) for c in cols}
    return PsiPlan(cfg, {c: edges[c] for c in cols}, clips, curr_clips)


def edges_table(base: DataFrame, plan: PsiPlan) -> DataFrame:
    rows = [(c, i, float(e)) for c, es in plan.edges.items() for i, e in enumerate(es)]
    return local_rows(base.sparkSession, rows, "feature string, edge_no int, edge double")


def bin_index(x: Column, edges: Sequence[float]) -> Column:
    """1-based right-closed bin; the first bin holds its left edge; 0 = outside; NULL = missing."""
    if len(edges) < 2:
        return F.when(x.isNotNull(), F.lit(0))
    under = (x > F.lit(edges[1])).cast("int")
    for e in edges[2:-1]:
        under = under + (x > F.lit(e)).cast("int")
    inside = under + 1 if len(edges) > 2 else F.lit(1)
    return F.when(x.isNull() | F.isnan(x), F.lit(None).cast("int")).when(
        (x >= F.lit(edges[0])) & (x <= F.lit(edges[-1])), inside).otherwise(F.lit(0))


def _side_counts(df: DataFrame, plan: PsiPlan, clips: dict, side: str) -> DataFrame:
    def place(c: str):
        lo, hi = clips.get(c, (None, None))
        inner = right_closed(plan.edges[c])
        if lo is None and hi is None:
            return inner
        return lambda v: inner(np.clip(v, lo, hi))

    cols = list(plan.edges)
    values = df.select(*[number(df, c).alias(f"c{i}") for i, c in enumerate(cols)])
    counts = values.mapInArrow(bin_counter([place(c) for c in cols]), COUNT_SCHEMA)
    return counts.select(F.array(*map(F.lit, cols))[F.col("col")].alias("feature"),
                         F.when(F.col("bin") >= 0, F.col("bin")).alias("bin"),
                         F.col("n").alias(side))


def bin_counts(base: DataFrame, curr: DataFrame, plan: PsiPlan) -> DataFrame:
    """(feature, bin, n_base, n_curr) over every bin value met, NULL and 0 (outside) included."""
    nothing = F.lit(0).cast("bigint")
    both = (_side_counts(base, plan, plan.base_clip, "n_base").withColumn("n_curr", nothing)
            .unionByName(_side_counts(curr, plan, plan.curr_clip, "n_curr").withColumn("n_base", nothing)))
    return both.groupBy("feature", "bin").agg(F.sum("n_base").alias("n_base"), F.sum("n_curr").alias("n_curr"))


def _slots(spark, plan: PsiPlan) -> DataFrame:
    rows = [(c, i + 1, es[i], es[i + 1]) for c, es in plan.edges.items() for i in range(len(es) - 1)]
    return local_rows(spark, rows, "feature string, bin int, bin_left double, bin_right double")


def _share(n: str, total: str, floor: float) -> Column:
    return F.greatest(F.col(n) / F.greatest(F.col(total), F.lit(1)), F.lit(floor))


def contributions(df: DataFrame, cfg: PsiConfig) -> DataFrame:
    """Add p_base, p_curr and psi_contrib from n_base, n_curr, t_base, t_curr."""
    b, c = F.col("p_base"), F.col("p_curr")
    return (df.withColumns({"p_base": _share("n_base", "t_base", cfg.min_bin_pct),
                            "p_curr": _share("n_curr", "t_curr", cfg.min_bin_pct)})
            .withColumn("psi_contrib", (c - b) * F.log((c + cfg.epsilon) / (b + cfg.epsilon))))


def _bins(counts: DataFrame, plan: PsiPlan) -> DataFrame:
    # Full alignment: every bin of the base appears, with 0 where neither or only one side has rows.
    totals = counts.filter("bin > 0").groupBy("feature").agg(
        F.sum("n_base").alias("t_base"), F.sum("n_curr").alias("t_curr"))
    aligned = (_slots(counts.sparkSession, plan).join(counts, ["feature", "bin"], "left")
               .join(totals, "feature", "left")
               .na.fill(0, ["n_base", "n_curr", "t_base", "t_curr"]))
    return contributions(aligned, plan.config)


def psi_bins(base: DataFrame, curr: DataFrame, cols: Sequence[str], cfg: PsiConfig = PsiConfig(),
             plan: PsiPlan | None = None) -> DataFrame:
    """Per-bin breakdown: edges, counts, shares and contribution."""
    plan = plan or plan_psi(base, cols, cfg, curr)
    return _bins(bin_counts(base, curr, plan), plan).select(
        "feature", "bin", "bin_left", "bin_right", "n_base", "n_curr", "p_base", "p_curr", "psi_contrib")


def severity(psi: Column, warn: float = WARN_AT, alert: float = ALERT_AT) -> Column:
    return F.when(psi >= alert, "alert").when(psi >= warn, "warn").otherwise("ok")


def _constant_current(curr: DataFrame, plan: PsiPlan) -> set[str]:
    """Which columns with a constant base are constant in the current table too."""
    suspects = [c for c, e in plan.edges.items() if len(e) == 1]
    if not suspects:
        return set()
    rows = aggregate_rows(curr, suspects, {
        "lo": lambda c: F.min(_clipped(number(curr, c), plan.curr_clip[c])),
        "hi": lambda c: F.max(_clipped(number(curr, c), plan.curr_clip[c]))}).collect()
    return {r["feature"] for r in rows if r["lo"] is not None and r["lo"] == r["hi"]}


def psi_table(base: DataFrame, curr: DataFrame, include: Sequence[str] | None = None,
              exclude: Sequence[str] | None = None, cfg: PsiConfig = PsiConfig(),
              plan: PsiPlan | None = None) -> DataFrame:
    """PSI of every shared numeric column, highest first, undefined ones last.

    Notes: ``empty`` (a side has no values: NaN), ``both_constant`` (0 even if the constants
    differ), ``base_constant`` (no bins can be cut: 0 over 0 bins).
    """
    cols = shared_numeric(base, curr, include, exclude)
    spark = base.sparkSession
    if not cols:
        return local_rows(spark, [], "feature string, psi double, n_base bigint, n_curr bigint, bins_count int, "
                                     "dropped_base bigint, dropped_curr bigint, note string, severity string")
    plan = plan or plan_psi(base, cols, cfg, curr)
    return _ranked(_psi_rows(bin_counts(base, curr, plan), plan, _constant_current(curr, plan)))


def _psi_rows(counts: DataFrame, plan: PsiPlan, constant: set[str]) -> DataFrame:
    """A row for each column of the plan from its counts by bin."""
    cols, spark = list(plan.edges), counts.sparkSession
    met = F.col("bin").isNotNull()
    sizes = counts.groupBy("feature").agg(
        F.sum(F.when(met, F.col("n_base")).otherwise(0)).alias("v_base"),
        F.sum(F.when(met, F.col("n_curr")).otherwise(0)).alias("v_curr"),
        F.sum(F.when(~met, F.col("n_base")).otherwise(0)).alias("dropped_base"),
        F.sum(F.when(~met, F.col("n_curr")).otherwise(0)).alias("dropped_curr"))
    parts = _bins(counts, plan).groupBy("feature").agg(
        F.sum("psi_contrib").alias("psi"), F.first("t_base").alias("t_base"), F.first("t_curr").alias("t_curr"),
        F.count("*").cast("int").alias("bins_count"))
    known = local_rows(spark, [(c, len(plan.edges[c]) == 1, c in constant) for c in cols],
                       "feature string, base_constant boolean, curr_constant boolean")
    note = (F.when((F.coalesce("v_base", F.lit(0)) == 0) | (F.coalesce("v_curr", F.lit(0)) == 0), "empty")
            .when(F.col("base_constant") & F.col("curr_constant"), "both_constant")
            .when(F.col("base_constant"), "base_constant"))
    full = F.col("note").isin("empty", "both_constant")
    return (known.join(sizes, "feature", "left").join(parts, "feature", "left").withColumn("note", note)
            .select(
               "feature",
               F.when(F.col("note") == "empty", F.lit(math.nan)).when(F.col("note").isNotNull(), F.lit(0.0))
               .otherwise(F.col("psi")).alias("psi"),
               F.coalesce(F.when(full, F.col("v_base") + F.col("dropped_base")).otherwise(F.col("t_base")),
                          F.lit(0)).alias("n_base"),
               F.coalesce(F.when(full, F.col("v_curr") + F.col("dropped_curr")).otherwise(F.col("t_curr")),
                          F.lit(0)).alias("n_curr"),
               F.when(F.col("note") == "empty", F.lit(plan.config.bins)).when(F.col("note") == "both_constant", 1)
               .otherwise(F.coalesce("bins_count", F.lit(0))).alias("bins_count"),
               F.coalesce("dropped_base", F.lit(0)).alias("dropped_base"),
               F.coalesce("dropped_curr", F.lit(0)).alias("dropped_curr"),
               "note"))


def _ranked(out: DataFrame) -> DataFrame:
    undefined = F.isnan("psi")
    return (out.withColumn("severity", F.when(undefined, F.lit("ok")).otherwise(severity(F.col("psi"))))
            .orderBy(undefined.asc(), F.desc("psi"), "feature"))


def sketch_plan(reference: dict[str, Sketch], cols: Sequence[str], cfg: PsiConfig = PsiConfig()) -> PsiPlan:
    """Clip bounds and bin edges from sketches of the base alone."""
    clips, edges = {}, {}
    for c in cols:
        s = reference[c]
        lo, hi = (None if q is None else s.quantiles([q])[0] for q in (cfg.clip_low, cfg.clip_high))
        clips[c] = (lo, hi)
        ends = s.quantiles([i / cfg.bins for i in range(cfg.bins + 1)]) if cfg.strategy == "quantile" else s.quantiles([0, 1])
        if s.n:
            ends = [min(max(e, -math.inf if lo is None else lo), math.inf if hi is None else hi) for e in ends]
        edges[c] = quantile_edges(ends, cfg.bins) if cfg.strategy == "quantile" else uniform_edges(ends[0], ends[-1], cfg.bins)
    return PsiPlan(cfg, edges, clips)


def _sketched_counts(reference: dict[str, Sketch], plan: PsiPlan) -> list[tuple[str, int | None, int, int]]:
    """(feature, bin, rows of the base by its sketch, 0), with missing values as no bin and a constant base outside."""
    rows: list[tuple[str, int | None, int, int]] = []
    for c, edges in plan.edges.items():
        s = reference[c]
        rows.append((c, None, s.missing, 0))
        if len(edges) < 2:
            rows.append((c, 0, s.n, 0))
            continue
        # values are clipped into the edges, so that all are inside: below the first edge there is none, up to the last are all
        up_to = [0, *s.ranks(edges[1:-1]).tolist(), s.n]
        rows += [(c, i + 1, int(up_to[i + 1] - up_to[i]), 0) for i in range(len(edges) - 1)]
    return rows


def sketch_psi_table(reference: DataFrame, curr: DataFrame, include: Sequence[str] | None = None, exclude: Sequence[str] | None = None,
                     cfg: PsiConfig = PsiConfig()) -> DataFrame:
    """``psi_table`` against a base that is known by its sketches (a table that ``sketch_columns`` made).

    The base isn't read. n_base and dropped_base are exact; the base's share of a bin is off by
    2 x rank_error / n_base at most, and the PSI of the base's rows over the same edges lies in psi_low .. psi_high.
    """
    known = read_sketches(reference)
    names = include if include is not None else list(known)
    cols = [c for c in names if c in known and c in curr.columns and c in numeric_columns(curr) and c not in (exclude or ())]
    spark = curr.sparkSession
    if not cols:
        return local_rows(spark, [], "feature string, psi double, n_base bigint, n_curr bigint, bins_count int, dropped_base bigint, "
                                     "dropped_curr bigint, note string, severity string, psi_low double, psi_high double, rank_error double")
    plan = sketch_plan(known, cols, cfg)
    plan = PsiPlan(cfg, plan.edges, plan.base_clip, _clip_bounds(curr, cols, cfg))
    base = local_rows(spark, _sketched_counts(known, plan), "feature string, bin int, n_base bigint, n_curr bigint")
    ours = _side_counts(curr, plan, plan.curr_clip, "n_curr").withColumn("n_base", F.lit(0).cast("bigint"))
    counts = base.unionByName(ours).groupBy("feature", "bin").agg(F.sum("n_base").alias("n_base"), F.sum("n_curr").alias("n_curr"))
    errors = local_rows(spark, [(c, float(known[c].error()), known[c].error() * 2 / max(1, known[c].n)) for c in cols], "feature string, rank_error double, slack double")

    def contribution(b: Column) -> Column:
        return (F.col("p_curr") - b) * F.log((F.col("p_curr") + cfg.epsilon) / (b + cfg.epsilon))

    least = F.greatest(F.col("p_base") - F.col("slack"), F.lit(cfg.min_bin_pct))
    most = F.greatest(F.least(F.col("p_base") + F.col("slack"), F.lit(1.0)), F.lit(cfg.min_bin_pct))
    ends = [contribution(least), contribution(most)]
    touched = (F.col("p_curr") >= least) & (F.col("p_curr") <= most)  # the least contribution is at equal shares
    bounds = _bins(counts, plan).join(errors, "feature").groupBy("feature").agg(
        F.sum(F.when(touched, F.lit(0.0)).otherwise(F.least(*ends))).alias("psi_low"), F.sum(F.greatest(*ends)).alias("psi_high"))
    out = _psi_rows(counts, plan, _constant_current(curr, plan)).join(bounds, "feature", "left").join(errors.drop("slack"), "feature", "left")
    plain = F.col("note").isNotNull() | F.col("psi_low").isNull()
    return _ranked(out.withColumns({c: F.when(plain, F.col("psi")).otherwise(F.col(c)) for c in ("psi_low", "psi_high")}))


def psi(base: DataFrame, curr: DataFrame, column: str, cfg: PsiConfig = PsiConfig()) -> DataFrame:
    """One-column form of ``psi_table``."""
    return psi_table(base, curr, include=[column], cfg=cfg)


def drift_check(reference: DataFrame, current: DataFrame, cfg: PsiConfig = PsiConfig(),
                warn: float = WARN_AT, alert: float = ALERT_AT) -> DataFrame:
    """PSI and severity of the first numeric column of each table (by its own column order)."""
    ours, theirs = numeric_columns(reference), numeric_columns(current)
    if not ours or not theirs:
        return psi_table(reference, current, include=[], cfg=cfg)
    name = ours[0]
    base = reference.select(quoted(name).alias(name))
    curr = current.select(quoted(theirs[0]).alias(name))
    return psi_table(base, curr, cfg=cfg).withColumn("severity", severity(F.col("psi"), warn, alert))


def alert_rows(findings: DataFrame, channels: Sequence[str] = ("slack", "email"), target: str = "ops",
               subject: str = "PSI") -> DataFrame:
    """One row per finding worth telling and channel, with the signature used to drop repeats.

    Warnings go to the first channel only, alerts to all of them.
    """
    text = F.format_string("%s PSI=%.3f", F.col("feature"), F.col("psi"))
    head = F.concat(F.lit(subject), F.lit(" "), F.upper("severity"))
    out = findings.filter("severity != 'ok'").select("*", head.alias("subject"), text.alias("message"))
    first = F.array(F.lit(channels[0]))
    sent_to = F.when(F.col("severity") == "alert", F.array(*map(F.lit, channels))).otherwise(first)
    return (out.withColumn("channel", F.explode(sent_to))
            .withColumn("target", F.lit(target))
            .withColumn("signature", F.sha2(F.concat("channel", "target", "subject", "message"), 256))
            .select("feature", "severity", "channel", "target", "subject", "message", "signature"))
