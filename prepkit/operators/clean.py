"""The cleaner: names, text, types decided by success ratio, imputation, clipping, duplicates.

Type decisions need data. They are taken for all text columns in one aggregate, the fill values for
all numeric columns in a second one; the cleaned table itself stays a lazy plan over the input.
The decisions are a small record that can be reused on new data and on streams.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepkit.functions import text as tx
from prepkit.functions.columns import (
    aggregate_rows,
    is_floating,
    number,
    numeric_columns,
    quoted,
    string_columns,
    unique_name,
)
from prepkit.functions.hashing import row_digest
from prepkit.operators.profile import distinct_counts
from prepkit.operators.quantiles import linear_quantiles, median_and_filled


@dataclass(frozen=True)
class CleanConfig:
    strip_unicode: bool = True
    normalize_whitespace: bool = True
    lowercase_categoricals: bool = False
    standardize_colnames: bool = True
    missing_tokens: tuple[str, ...] = tx.MISSING_TOKENS
    coerce_numeric_from_str: bool = True
    parse_dates: bool = True
    date_dayfirst: bool = False
    min_parse_success_ratio: float = 0.8
    thousands: bool = True
    replace_inf: bool = True
    impute_numeric: str = "median"
    impute_numeric_constant: float = 0.0
    clip_quantiles: tuple[float, float] | None = None
    impute_categorical_value: str = "missing"
    cast_low_card_to_category: bool = True
    max_unique_for_category: int = 1000
    unique_fraction_for_category: float = 0.5
    drop_duplicates: bool = True
    duplicates_subset: tuple[str, ...] | None = None
    duplicates_order: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        if self.impute_numeric not in ("median", "mean", "constant", "none"):
            raise ValueError("impute_numeric must be median, mean, constant or none")


@dataclass(frozen=True)
class CleanDecisions:
    """What was decided from data: a date layout or number parsing per text column, fills, limits."""

    dates: dict[str, tuple[str, str]] = field(default_factory=dict)
    numbers: tuple[str, ...] = ()
    fills: dict[str, float | None] = field(default_factory=dict)
    limits: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)


# --- names ---------------------------------------------------------------------------------


def normalize_colnames(df: DataFrame) -> DataFrame:
    """Trim names and turn runs of white space into '_'; clashes get '__1', '__2'."""
    return df.toDF(*dedupe_names([re.sub(r"\s+", "_", c.strip()) for c in df.columns]))


def dedupe_names(names: Sequence[str]) -> list[str]:
    """Repeated headers get a counter: a, a -> a, a__1."""
    out: list[str] = []
    for n in names:
        out.append(unique_name(n, out))
    return out


# --- text and types ------------------------------------------------------------------------


def clean_text(df: DataFrame, cols: Sequence[str] | None = None, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """Spaces, missing marks, case. Two projections, so the regular expressions run once per value."""
    cols = list(string_columns(df) if cols is None else cols)
    if not cols:
        return df
    out = df.withColumns({c: tx.normalize_spaces(quoted(c), cfg.strip_unicode, cfg.normalize_whitespace) for c in cols})
    out = out.withColumns({c: tx.drop_tokens(quoted(c), cfg.missing_tokens) for c in cols})
    return out.withColumns({c: F.lower(quoted(c)) for c in cols}) if cfg.lowercase_categoricals else out


def normalize_missing(df: DataFrame, tokens: Sequence[str] = tx.MISSING_TOKENS) -> DataFrame:
    cols = string_columns(df)
    return df.withColumns({c: tx.normalize_missing(quoted(c), tokens) for c in cols}) if cols else df


def parse_ratios(df: DataFrame, cols: Sequence[str], dayfirst: bool = False, dates: bool = True,
                 numbers: bool = True, thousands: bool = True) -> DataFrame:
    """(feature, n_rows, number_ok, layout, date_ok), the layout being the best single one.

    Columns are unpivoted first, so the parsing code is generated once whatever the table's width.
    """
    tried = tx.layouts(dayfirst)
    entries = [F.struct(F.lit(c).alias("feature"), quoted(c).alias("v")) for c in cols]
    values = df.select(F.inline(F.array(*entries)))
    v, layout = F.col("v"), F.col("layout")
    values = values.withColumn("layout", tx.layout_index(v, tried) if dates else F.lit(None).cast("int"))
    counts = values.groupBy("feature", "layout").agg(
        F.count("*").alias("n"),
        F.count(tx.parse_number(v, thousands) if numbers else F.lit(None)).alias("number_ok"),
        F.count(tx.parse_by_index(v, layout, tried) if dates else F.lit(None)).alias("date_ok"))
    best = F.max(F.when(layout.isNotNull() & (F.col("date_ok") > 0), F.struct("date_ok", (-layout).alias("rank"))))
    return (counts.groupBy("feature").agg(F.sum("n").alias("n_rows"), F.sum("number_ok").alias("number_ok"),
                                          best.alias("_b"))
            .select("feature", "n_rows", "number_ok", (-F.col("_b.rank")).alias("layout"),
                    F.coalesce("_b.date_ok", F.lit(0)).alias("date_ok")))


def decide_types(df: DataFrame, cols: Sequence[str] | None = None, cfg: CleanConfig = CleanConfig()) -> CleanDecisions:
    """Dates are tried before numbers; a column needs one single layout for the given share of ALL rows."""
    cols = list(string_columns(df) if cols is None else cols)
    if not cols or not (cfg.parse_dates or cfg.coerce_numeric_from_str):
        return CleanDecisions()
    tried = tx.layouts(cfg.date_dayfirst)
    dates, numbers = {}, []
    for r in parse_ratios(df, cols, cfg.date_dayfirst, cfg.parse_dates, cfg.coerce_numeric_from_str,
                          cfg.thousands).collect():
        need = cfg.min_parse_success_ratio * r["n_rows"]
        if r["layout"] is not None and r["date_ok"] >= need:
            dates[r["feature"]] = tried[r["layout"]]
        elif cfg.coerce_numeric_from_str and r["number_ok"] >= need:
            numbers.append(r["feature"])
    return CleanDecisions(dates={c: dates[c] for c in cols if c in dates},
                          numbers=tuple(c for c in cols if c in numbers))


def apply_types(df: DataFrame, d: CleanDecisions, thousands: bool = True) -> DataFrame:
    new = {c: tx.parse_layout(quoted(c), y) for c, y in d.dates.items()}
    new.update({c: tx.parse_number(quoted(c), thousands) for c in d.numbers})
    return df.withColumns(new) if new else df


def coerce_numeric(df: DataFrame, cols: Sequence[str] | None = None, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """Text columns whose values are numbers often enough become doubles."""
    return apply_types(df, decide_types(df, cols, replace(cfg, parse_dates=False)), cfg.thousands)


def coerce_dates(df: DataFrame, cols: Sequence[str] | None = None, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    return apply_types(df, decide_types(df, cols, replace(cfg, coerce_numeric_from_str=False)))


# --- numbers -------------------------------------------------------------------------------


def _finite(df: DataFrame, c: str) -> Column:
    if not is_floating(df.schema[c].dataType):
        return quoted(c)
    return F.when(~F.isnan(quoted(c)) & (F.abs(quoted(c)) != float("inf")), quoted(c))


def replace_inf(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN and both infinities become NULL."""
    cols = [c for c in (cols or numeric_columns(df)) if is_floating(df.schema[c].dataType)]
    return df.withColumns({c: _finite(df, c) for c in cols}) if cols else df


def fill_values(df: DataFrame, cols: Sequence[str], how: str, constant: float = 0.0) -> dict[str, float | None]:
    if how == "none" or not cols:
        return {}
    if how == "constant":
        return {c: constant for c in cols}
    if how == "median":
        fills = {c: v[0] for c, v in linear_quantiles(df, cols, [0.5]).items()}
    else:
        row = df.agg(*[F.avg(number(df, c)).alias(f"m{i}") for i, c in enumerate(cols)]).first()
        fills = {c: row[i] for i, c in enumerate(cols)}
    return _without_needless(df, fills)


def fills_and_limits(df: DataFrame, cols: Sequence[str], lo: float, hi: float) -> tuple[dict[str, float | None], dict[str, tuple[float | None, float | None]]]:
    """Medians as fills, and the clip limits of the filled columns, without a second set of passes."""
    found = median_and_filled(df, cols, [lo, hi])
    whole = {c for c, (v, missing, _) in found.items() if not missing and v is not None and not is_floating(df.schema[c].dataType)}
    fills = {c: v for c, (v, _, _) in found.items() if c not in whole or float(v).is_integer()}
    return fills, {c: (v[0], v[1]) for c, (_, _, v) in found.items()}


def _without_needless(df: DataFrame, fills: dict[str, float | None]) -> dict[str, float | None]:
    """A whole-number column with nothing missing needs no fractional fill and so keeps its type."""
    odd = [c for c, v in fills.items() if v is not None and not float(v).is_integer() and not is_floating(df.schema[c].dataType)]
    if not odd:
        return fills
    row = df.agg(*[F.count_if(quoted(c).isNull()).alias(f"n{i}") for i, c in enumerate(odd)]).first()
    full = {c for i, c in enumerate(odd) if not row[i]}
    return {c: v for c, v in fills.items() if c not in full}


def fill_numeric(df: DataFrame, fills: dict[str, float | None]) -> DataFrame:
    """NULL and NaN become the fill; a whole column turns DOUBLE only where it has to."""
    new = {}
    for c, v in fills.items():
        if v is None:
            continue
        dtype = df.schema[c].dataType
        whole = not is_floating(dtype) and float(v).is_integer()
        filled = F.coalesce(_not_nan(df, c), F.lit(v))
        new[c] = F.coalesce(quoted(c), F.lit(int(v)).cast(dtype)) if whole else filled
    return df.withColumns(new) if new else df


def _not_nan(df: DataFrame, c: str) -> Column:
    return F.when(~F.isnan(quoted(c)), quoted(c)) if is_floating(df.schema[c].dataType) else quoted(c).cast("double")


def impute_numeric(df: DataFrame, how: str = "median", constant: float = 0.0,
                   cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or numeric_columns(df))
    return fill_numeric(df, fill_values(df, cols, how, constant))


def clip_limits(df: DataFrame, lo: float, hi: float,
                cols: Sequence[str] | None = None) -> dict[str, tuple[float | None, float | None]]:
    found = linear_quantiles(df, list(cols or numeric_columns(df)), [lo, hi])
    return {c: (v[0], v[1]) for c, v in found.items()}


def clip_numeric(df: DataFrame, limits: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    new = {}
    for c, (lo, hi) in limits.items():
        if lo is None:
            continue
        x = quoted(c)
        new[c] = F.when(x < F.lit(lo), F.lit(lo)).when(x > F.lit(hi), F.lit(hi)).otherwise(x)
    return df.withColumns(new) if new else df


def clip_quantiles(df: DataFrame, lo: float, hi: float, cols: Sequence[str] | None = None) -> DataFrame:
    """Winsorise every column to its own linear quantiles."""
    return clip_numeric(df, clip_limits(df, lo, hi, cols))


# --- categories and duplicates -------------------------------------------------------------


def impute_categorical(df: DataFrame, value: str = "missing") -> DataFrame:
    cols = string_columns(df)
    return df.fillna(value, cols) if cols else df


def low_card_columns(df: DataFrame, max_unique: int = 1000, max_fraction: float = 0.5) -> DataFrame:
    """Text columns few-valued enough to be categories (NULL counts as a value)."""
    out = distinct_counts(df, string_columns(df))
    n = F.col("n_distinct") + (F.col("missing") > 0).cast("int")
    return out.select("feature", n.alias("n_distinct"),
                      ((n <= max_unique) & (n / F.greatest(F.col("n_rows"), F.lit(1)) <= max_fraction))
                      .alias("categorical"))


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None,
                    order: Sequence[str] | None = None) -> DataFrame:
    """Whole-row, or the first row per ``subset`` along ``order`` (row hash when not given).

    The first row is taken by ``min`` of a struct, which merges inside map tasks: a value that
    holds a large share of the rows reaches the shuffle as one row per task.
    """
    if not subset:
        return df.dropDuplicates()
    lead = [quoted(o) for o in order] if order else []
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(lead)],
                   row_digest([quoted(c) for c in df.columns]).alias("h"))
    best = df.groupBy(*[quoted(c).alias(f"k{i}") for i, c in enumerate(subset)]).agg(
        F.min_by(F.struct(*[quoted(c) for c in df.columns]), key).alias("r"))
    return best.select("r.*")


# --- pipeline ------------------------------------------------------------------------------


def prepare_text(df: DataFrame, cfg: CleanConfig) -> DataFrame:
    out = normalize_colnames(df) if cfg.standardize_colnames else df
    return clean_text(out, None, cfg)


def decide(df: DataFrame, cfg: CleanConfig = CleanConfig()) -> CleanDecisions:
    """Take all decisions: types in one aggregate, fills in one, clip limits in the same or (fills other than medians) one more."""
    staged = prepare_text(df, cfg)
    d = decide_types(staged, None, cfg)
    staged = apply_types(staged, d, cfg.thousands)
    if cfg.replace_inf:
        staged = replace_inf(staged)
    cols = numeric_columns(staged)
    if cfg.impute_numeric == "median" and cfg.clip_quantiles:
        fills, limits = fills_and_limits(staged, cols, *cfg.clip_quantiles)
        return replace(d, fills=fills, limits=limits)
    d = replace(d, fills=fill_values(staged, cols, cfg.impute_numeric, cfg.impute_numeric_constant))
    if cfg.clip_quantiles:
        filled = fill_numeric(staged, d.fills)
        d = replace(d, limits=clip_limits(filled, *cfg.clip_quantiles))
    return d


def apply(df: DataFrame, d: CleanDecisions, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    """Clean with decisions already taken. Row-wise until the duplicate removal, so it also runs on streams."""
    out = apply_types(prepare_text(df, cfg), d, cfg.thousands)
    if cfg.replace_inf:
        out = replace_inf(out)
    out = clip_numeric(fill_numeric(out, d.fills), d.limits)
    out = impute_categorical(out, cfg.impute_categorical_value)
    if cfg.drop_duplicates:
        out = drop_duplicates(out, cfg.duplicates_subset, cfg.duplicates_order)
    return out


def clean(df: DataFrame, cfg: CleanConfig = CleanConfig()) -> DataFrame:
    return apply(df, decide(df, cfg), cfg)


def category_columns(df: DataFrame, cfg: CleanConfig = CleanConfig()) -> list[str]:
    """Columns to be treated as categories; Spark keeps them as text (see ``StringIndexer``)."""
    if not cfg.cast_low_card_to_category or not string_columns(df):
        return []
    rows = low_card_columns(df, cfg.max_unique_for_category, cfg.unique_fraction_for_category)
    return [r["feature"] for r in rows.filter("categorical").collect()]


