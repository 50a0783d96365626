"""Column profiles, signals and EDA tables. Each operator is one aggregate over the input."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit.functions.columns import (
    aggregate_rows,
    is_floating,
    is_numeric,
    local_rows,
    number,
    numeric_columns,
    present,
    quoted,
    timestamp_columns,
    unpivot_typed,
)
from prepkit.functions.folds import COUNT_SCHEMA, bin_counter, equal_width
from prepkit.functions.hashing import row_digest
from prepkit.functions.sizing import lookup_side
from prepkit.operators.ordering import dense_codes
from prepkit.operators.quantiles import quantile_columns

# Thresholds and sizes of the reports.
CONSTANT_TOLERANCE = 1e-12
HIGH_CARDINALITY = 0.5
TOP_SIGNALS = 12
MAX_CLASSES = 50


def _first(cols: Sequence[str], limit: int | None) -> list[str]:
    return list(cols) if limit is None else list(cols)[:limit]


# --- schema and missing values -------------------------------------------------------------


def schema_profile(df: DataFrame, max_cols: int | None = None) -> DataFrame:
    """One row per column: position, name, type, and the shape of the table."""
    width = len(df.columns)
    entries = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("feature"),
                        F.lit(f.dataType.simpleString()).alias("dtype"))
               for i, f in enumerate(df.schema.fields[:max_cols])]
    return (df.agg(F.count("*").alias("n_rows")).withColumn("n_cols", F.lit(width))
            .select("n_rows", "n_cols", F.inline(F.array(*entries))))


def missing_ratio(df: DataFrame, max_cols: int | None = None) -> DataFrame:
    cols = _first(df.columns, max_cols)
    out = aggregate_rows(df, cols, {"n_rows": lambda c: F.count(F.lit(1)), "missing": lambda c: _nulls(df, c)})
    return out.withColumn("missing_ratio", F.try_divide(F.col("missing"), F.col("n_rows")))


def _nulls(df: DataFrame, c: str) -> Column:
    return F.count_if(present(df, c).isNull())


def missing_table(df: DataFrame, top_k: int = 20) -> DataFrame:
    """Columns with missing values, most missing first, with the percentage to 2 places."""
    out = missing_ratio(df, None).filter("missing > 0")
    return (out.select("feature", "missing", F.round(F.col("missing_ratio") * 100, 2).alias("missing_pct"))
            .orderBy(F.desc("missing"), "feature").limit(top_k))


def null_counts(df: DataFrame, top_k: int = 30) -> DataFrame:
    return (missing_ratio(df, None).filter("missing > 0").select("feature", "missing")
            .orderBy(F.desc("missing"), "feature").limit(top_k))


def quality_health(df: DataFrame) -> DataFrame:
    """Row count, width and the number of columns with missing values, as one row."""
    flags = [(_nulls(df, c) > 0).cast("int") for c in df.columns]
    total = flags[0] if flags else F.lit(0)
    for f in flags[1:]:
        total = total + f
    return df.agg(F.count("*").alias("rows"), F.lit(len(df.columns)).alias("cols"),
                  total.alias("cols_with_missing"))


# --- distinct values -----------------------------------------------------------------------


def distinct_counts(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """(feature, n_rows, missing, n_distinct) with NULLs not counted as a value.

    Exact: (feature, value) pairs are deduplicated by a grouped aggregate, so map tasks drop
    repeats before the shuffle and no group is larger than one pair. ``approx`` uses a sketch.
    """
    cols = list(cols or df.columns)
    if approx:
        return aggregate_rows(df, cols, {
            "n_rows": lambda c: F.count(F.lit(1)), "missing": lambda c: _nulls(df, c),
            "n_distinct": lambda c: F.approx_count_distinct(present(df, c))})
    values = unpivot_typed(df, cols).groupBy("feature", "i", "d", "s").agg(F.count("*").alias("n"))
    some = F.coalesce(F.col("i").cast("string"), F.col("d").cast("string"), F.col("s")).isNotNull()
    return values.groupBy("feature").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(~some, F.col("n"))), F.lit(0)).alias("missing"),
        F.count_if(some).alias("n_distinct"))


def constant_columns(df: DataFrame, tol: float = CONSTANT_TOLERANCE,
                     max_cols: int | None = None) -> DataFrame:
    """Numeric: max - min <= tol. Other: one value, seen as min = max, so nothing is deduplicated."""
    cols = [c for c in _first(df.columns, max_cols) if not isinstance(
        df.schema[c].dataType, (T.ArrayType, T.MapType, T.StructType))]

    def is_constant(c: str) -> Column:
        lo, hi = F.min(present(df, c)), F.max(present(df, c))
        if is_numeric(df.schema[c].dataType):
            return F.coalesce((hi.cast("double") - lo.cast("double")) <= tol, F.lit(False))
        return F.coalesce(lo == hi, F.lit(False))

    return aggregate_rows(df, cols, {"constant": is_constant}).filter("constant").select("feature")


def high_cardinality(df: DataFrame, ratio: float = HIGH_CARDINALITY, approx: bool = False,
                     max_cols: int | None = None) -> DataFrame:
    out = distinct_counts(df, _first(df.columns, max_cols), approx)
    return (out.withColumn("distinct_ratio", F.col("n_distinct") / F.col("n_rows"))
            .filter(F.col("distinct_ratio") >= ratio).select("feature", "n_distinct", "distinct_ratio"))


def date_columns(df: DataFrame, max_cols: int | None = None) -> list[str]:
    return timestamp_columns(df)[:max_cols]


# --- target --------------------------------------------------------------------------------


def infer_target(df: DataFrame, target: str | None = None) -> str | None:
    """The given column, else the last one unless it is a time or looks like an identifier."""
    if target and target in df.columns:
        return target
    if not df.columns or df.columns[-1] in timestamp_columns(df):
        return None
    last = df.columns[-1]
    r = distinct_counts(df, [last]).first()
    if r is None:
        return last
    return None if r["n_distinct"] + (r["missing"] > 0) > 0.95 * r["n_rows"] else last


def problem_type(dtype: T.DataType, n_rows: int, n_distinct: int, rule: str = "insights") -> str:
    """``insights`` and ``baseline``: floats are regression. ``fusion``: few values win over floats."""
    if rule not in ("insights", "baseline", "fusion"):
        raise ValueError("rule must be 'insights', 'baseline' or 'fusion'")
    if rule == "insights" and n_rows == 0:
        return "unknown"
    few = n_distinct <= MAX_CLASSES
    if rule == "fusion":
        return "classification" if few else "regression"
    return "classification" if few and not is_floating(dtype) else "regression"


def infer_problem_type(df: DataFrame, target: str, rule: str = "insights") -> str:
    dtype = df.schema[target].dataType
    if rule != "fusion" and is_floating(dtype) and rule == "baseline":
        return "regression"
    r = distinct_counts(df, [target]).first()
    return problem_type(dtype, r["n_rows"] if r else 0, r["n_distinct"] if r else 0, rule)


def label_codes(df: DataFrame, target: str) -> DataFrame:
    """(label, code): sorted distinct non-NULL labels numbered from 0."""
    labels = df.select(quoted(target).alias("label")).filter("label IS NOT NULL").distinct()
    return dense_codes(labels, "label", "code")


def encode_target(df: DataFrame, target: str, out: str = "target_code") -> DataFrame:
    """Numeric targets are kept as doubles; others become sorted label codes, NULL becomes -1."""
    if is_numeric(df.schema[target].dataType):
        return df.withColumn(out, quoted(target).cast("double"))
    codes = label_codes(df, target).select(F.col("label").alias("_label"), F.col("code").cast("double").alias(out))
    joined = df.join(lookup_side(codes), quoted(target) == F.col("_label"), "left").drop("_label")
    return joined.withColumn(out, F.coalesce(F.col(out), F.lit(-1.0)))


def class_stats(df: DataFrame, target: str, top_k: int = 10) -> DataFrame:
    """Most frequent labels (NULL is one) with count, fraction and the number of distinct labels."""
    counts = df.groupBy(quoted(target).cast("string").alias("label")).agg(F.count("*").alias("n"))
    totals = counts.agg(F.sum("n").alias("t"), F.count("label").alias("k"))
    return (counts.orderBy(F.desc("n"), F.asc_nulls_last("label")).limit(top_k)
            .select("label", "n",
                    (F.col("n") / totals.select("t").scalar()).alias("fraction"),
                    totals.select("k").scalar().alias("n_classes")))


# --- signals -------------------------------------------------------------------------------


def top_k(scores: DataFrame, k: int = TOP_SIGNALS, score: str = "score", name: str = "feature") -> DataFrame:
    return scores.orderBy(F.desc(score), name).limit(k)


def numeric_signals(df: DataFrame, target: str) -> DataFrame:
    """|Pearson r| of every numeric column with the target (label codes when it is text).

    A column needs 3 finite pairs and a population variance above 1e-12 on both sides.
    """
    coded = encode_target(df, target, "_target")
    cols = [c for c in numeric_columns(df) if c != target]
    if not cols:
        return local_rows(df.sparkSession, [], "feature string, score double")
    y = _finite(F.col("_target"))

    def pair(c: str) -> tuple[Column, Column]:
        x = _finite(number(df, c))
        return F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)

    out = aggregate_rows(coded, cols, {
        "n": lambda c: F.count(pair(c)[0]),
        "vx": lambda c: F.var_pop(pair(c)[0]),
        "vy": lambda c: F.var_pop(pair(c)[1]),
        "cov": lambda c: F.covar_pop(*pair(c))})
    r = F.col("cov") / F.sqrt(F.nullif(F.col("vx") * F.col("vy"), F.lit(0.0)))
    return out.filter("n >= 3 AND vx > 1e-12 AND vy > 1e-12").select("feature", F.abs(r).alias("score"))


def variance_signals(df: DataFrame) -> DataFrame:
    """Population variance of every numeric column: the signal when there is no target."""
    cols = numeric_columns(df)
    if not cols:
        return local_rows(df.sparkSession, [], "feature string, score double")
    return aggregate_rows(df, cols, {"score": lambda c: F.var_pop(number(df, c))})


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


# --- describe ------------------------------------------------------------------------------


def describe_numeric(df: DataFrame, max_cols: int | None = None) -> DataFrame:
    """count, mean, std (n-1), min, quartiles (linear), max per numeric column."""
    cols = _first(numeric_columns(df), max_cols)
    quart = quantile_columns(df, cols, [0.25, 0.5, 0.75])
    out = aggregate_rows(df, cols, {
        "count": lambda c: F.count(number(df, c)),
        "mean": lambda c: F.avg(number(df, c)),
        "std": lambda c: F.stddev_samp(number(df, c)),
        "min": lambda c: F.min(number(df, c)),
        "_q": lambda c: quart[c],
        "max": lambda c: F.max(number(df, c))})
    return out.select("feature", "count", "mean", "std", "min", F.col("_q")[0].alias("q25"),
                      F.col("_q")[1].alias("q50"), F.col("_q")[2].alias("q75"), "max")


def top_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, count, unique, top, freq); ties go to the smallest text. No window: max_by merges map-side."""
    entries = [F.struct(F.lit(c).alias("feature"), present(df, c).cast("string").alias("value")) for c in cols]
    counts = (df.select(F.inline(F.array(*entries))).groupBy("feature", "value").agg(F.count("*").alias("n")))
    some = F.col("value").isNotNull()
    freq = counts.groupBy("feature").agg(
        F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0)).alias("count"),
        F.count_if(some).alias("unique"),
        F.min(F.when(some, F.struct((-F.col("n")).alias("m"), F.col("value").alias("v")))).alias("_t"))
    return freq.select("feature", "count", "unique", F.col("_t.v").alias("top"), (-F.col("_t.m")).alias("freq"))


def describe_all(df: DataFrame, max_cols: int | None = None) -> DataFrame:
    """``describe_numeric`` plus unique/top/freq rows for the other columns."""
    cols = _first(df.columns, max_cols)
    num = [c for c in cols if is_numeric(df.schema[c].dataType)]
    other = [c for c in cols if c not in num]
    nothing = {"unique": "bigint", "top": "string", "freq": "bigint"}
    stats = ["mean", "std", "min", "q25", "q50", "q75", "max"]
    order = ["feature", "count", "unique", "top", "freq", *stats]
    frames = []
    if num:
        frames.append(describe_numeric(df.select(*map(quoted, num)), None)
                      .withColumns({k: F.lit(None).cast(t) for k, t in nothing.items()}).select(*order))
    if other:
        frames.append(top_values(df, other)
                      .withColumns({k: F.lit(None).cast("double") for k in stats}).select(*order))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pairwise-complete Pearson r as (x, y, r) rows over every ordered pair.

    One ``corr`` per pair grows with the square of the width and soon leaves generated code (10x
    slower already at 8 columns). Here every task folds its Arrow batches into p x p sums with
    matrix products and emits p*p rows once; the sums are then added up by (x, y). Values are
    centred by the column mean first, so large offsets do not cost precision.
    """
    cols = list(cols or numeric_columns(df))
    if len(cols) < 2:
        return local_rows(df.sparkSession, [], "x string, y string, r double")
    means = df.agg(*[F.avg(_finite(number(df, c))).alias(f"m{i}") for i, c in enumerate(cols)]).first()
    centred = df.select(*[(number(df, c) - F.lit(float(means[i] or 0.0))).alias(f"c{i}") for i, c in enumerate(cols)])
    sums = centred.mapInArrow(pair_sums, "i int, j int, n double, sx double, sxx double, sxy double")
    total = sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sxx", "sxy")])
    back = total.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("sx").alias("sy"), F.col("sxx").alias("syy"))
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    vx, vy = F.col("sxx") - sx * sx / n, F.col("syy") - sy * sy / n
    tiny = F.lit(1e-14)
    flat = (vx <= tiny * F.col("sxx")) | (vy <= tiny * F.col("syy"))
    r = F.when((n > 1) & ~flat, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (
        F.col("sxy") - sx * sy / n) / F.sqrt(vx * vy))))
    names = F.array(*map(F.lit, cols))
    return total.join(back, ["i", "j"]).select(
        names[F.col("i")].alias("x"), names[F.col("j")].alias("y"), r.alias("r"))


def pair_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per ordered pair (i, j), over rows where both are present: n, sum x, sum x^2, sum x*y."""
    n = sx = sxx = sxy = None
    for batch in batches:
        v = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
        mask = np.isfinite(v)
        v, m = np.where(mask, v, 0.0), mask.astype(float)
        part = (m.T @ m, v.T @ m, (v * v).T @ m, v.T @ v)
        n, sx, sxx, sxy = part if n is None else (n + part[0], sx + part[1], sxx + part[2], sxy + part[3])
    if n is not None:
        i, j = np.indices(n.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel().astype("int32")), pa.array(j.ravel().astype("int32")),
             *[pa.array(a.ravel()) for a in (n, sx, sxx, sxy)]], names=["i", "j", "n", "sx", "sxx", "sxy"])


# --- rows ----------------------------------------------------------------------------------


def sample_rows(df: DataFrame, n: int, seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    """The n rows first in the hash order of ``key`` (all columns by default).

    The rows are first cut down by a hash threshold that leaves a little more
    than n of them, so that the final top-n does not merge n rows from every partition. If the
    threshold leaves fewer than n it is dropped: the result is the same either way.
    """
    digest = row_digest(list(key or df.columns), seed)
    tagged = df.withColumn("_digest", digest)
    share = (n + 6 * (n**0.5) + 100) / max(df.count(), 1)
    if share < 0.5:
        cut = F.lit(format(int(share * 16**8), "08x"))
        kept = tagged.filter(F.col("_digest") < cut)
        if kept.count() >= n:
            tagged = kept
    return tagged.orderBy("_digest", *(key or [])).limit(n).drop("_digest")


def bound_table(df: DataFrame, max_rows: int = 100_000, max_cols: int | None = None,
                seed: int = 42, key: Sequence[str] | None = None) -> DataFrame:
    """At most max_rows sampled rows and the first max_cols columns (all without it)."""
    return sample_rows(df, max_rows, seed, key).select(*map(quoted, df.columns[:max_cols]))


def head(df: DataFrame, n: int = 5, order: Sequence[str] | None = None) -> DataFrame:
    """First n rows along ``order`` (the hash of all columns when there is no order)."""
    if order:
        return df.orderBy(*order).limit(n)
    return sample_rows(df, n)


def table_preview(df: DataFrame, rows: int = 200, cols: int = 50, order: Sequence[str] | None = None) -> DataFrame:
    return head(df, rows, order).select(*map(quoted, df.columns[:cols]))


def table_size(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows")).withColumn("cols", F.lit(len(df.columns)))


def value_counts(df: DataFrame, col: str, top_k: int | None = 30) -> DataFrame:
    out = (df.groupBy(quoted(col).alias("value")).agg(F.count("*").alias("count"))
           .orderBy(F.desc("count"), F.asc_nulls_last("value")))
    return out if top_k is None else out.limit(top_k)


def histogram(df: DataFrame, cols: Sequence[str] | None = None, bins: int = 30, max_cols: int | None = None) -> DataFrame:
    """Equal-width bins over min..max of the finite values, empty ones included; the maximum falls in the last bin."""
    cols = list(cols) if cols else _first(numeric_columns(df), max_cols)
    limits = {r["feature"]: (r["lo"], r["hi"]) for r in aggregate_rows(df, cols, {
        "lo": lambda c: F.min(_finite(number(df, c))), "hi": lambda c: F.max(_finite(number(df, c)))}).collect()}
    live = [c for c in cols if limits[c][0] is not None]
    if not live:
        return local_rows(df.sparkSession, [], "feature string, bin int, bin_left double, bin_right double, n bigint")
    slots, places = [], []
    for c in live:
        lo, hi = limits[c]
        k = bins if hi > lo else 1
        width = (hi - lo) / k
        slots += [(c, i + 1, lo + i * width, hi if i == k - 1 else lo + (i + 1) * width) for i in range(k)]
        places.append(equal_width(lo, hi, k))
    values = df.select(*[_finite(number(df, c)).alias(f"c{i}") for i, c in enumerate(live)])
    counts = (values.mapInArrow(bin_counter(places), COUNT_SCHEMA).filter("bin >= 0")
              .groupBy(F.array(*map(F.lit, live))[F.col("col")].alias("feature"), "bin").agg(F.sum("n").alias("n")))
    return (local_rows(df.sparkSession, slots, "feature string, bin int, bin_left double, bin_right double")
            .join(counts, ["feature", "bin"], "left").na.fill(0, ["n"]))
