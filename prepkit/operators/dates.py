"""Date features: calendar parts, flags, clock, cyclic encoding, holidays."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit.functions import text as tx
from prepkit.functions.columns import quoted, string_columns, timestamp_columns, unique_name
from prepkit.functions.sizing import lookup_side
from prepkit.operators.clean import parse_ratios


@dataclass(frozen=True)
class DateFeatureConfig:
    date_cols: tuple[str, ...] | None = None
    parse_dates: bool = False
    dayfirst: bool = False
    tz_convert_to: str | None = None
    add_calendar: bool = True
    add_flags: bool = True
    add_clock: bool = True
    add_cyclic: bool = True
    max_new_cols: int | None = None
    sep: str = "_"


MIN_SUCCESS = 0.8


def _layouts_of(df: DataFrame, cols: Sequence[str], dayfirst: bool) -> dict[str, tuple[str, str]]:
    """{column: the layout that parses the largest share, 0.8 or more, of its values}; one aggregate over all rows."""
    if not cols:
        return {}
    texts = df.select(*[quoted(c).cast("string").alias(c) for c in cols])
    filled = df.agg(*[F.count(quoted(c)).alias(f"n{i}") for i, c in enumerate(cols)]).first()
    size = {c: filled[f"n{i}"] for i, c in enumerate(cols)}
    found = {r["feature"]: r for r in parse_ratios(texts, cols, dayfirst, numbers=False).collect()}
    return {c: tx.layouts(dayfirst)[r["layout"]] for c, r in found.items()
            if r["layout"] is not None and r["date_ok"] >= MIN_SUCCESS * size[c]}


def detect_datetime_cols(df: DataFrame, limit: int | None = None) -> list[str]:
    """Time-typed columns, and text columns whose values are mostly dates."""
    times, dates = timestamp_columns(df), _layouts_of(df, string_columns(df), False)
    return [c for c in df.columns if c in times or c in dates][:limit]


def _to_ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def localize(c: Column, zone: str) -> Column:
    """A clock time stays as it is, but is NULL in the zone's spring gap and autumn overlap.

    u is the UTC reading of local time t. In a gap u does not read back as t; in an overlap a
    neighbour one hour away reads back as t too.
    """
    u = F.convert_timezone(F.lit(zone), F.lit("UTC"), c)

    def back(x: Column) -> Column:
        return F.convert_timezone(F.lit("UTC"), F.lit(zone), x)

    hour = F.expr("INTERVAL 1 HOUR")
    sound = (back(u) == c) & (back(u + hour) != c) & (back(u - hour) != c)
    return F.when(sound, c)


def ensure_datetime(df: DataFrame, col: str, cfg: DateFeatureConfig = DateFeatureConfig()) -> Column | None:
    """The column as a zone-free timestamp, or None when it is not a time and may not be parsed."""
    dtype = df.schema[col].dataType
    zoned = isinstance(dtype, T.TimestampType)
    if isinstance(dtype, T.StringType):
        layout = _layouts_of(df, [col], cfg.dayfirst).get(col) if cfg.parse_dates else None
        if layout is None:
            return None
        c = tx.parse_layout(quoted(col), layout)
    elif isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        c = quoted(col)
    else:
        return None
    if not cfg.tz_convert_to:
        return _to_ntz(c)
    if zoned:
        return F.convert_timezone(F.lit("UTC"), F.lit(cfg.tz_convert_to),
                                  F.convert_timezone(F.current_timezone(), F.lit("UTC"), _to_ntz(c)))
    return localize(_to_ntz(c), cfg.tz_convert_to)


def calendar_parts(c: Column) -> dict[str, Column]:
    return {"year": F.year(c), "quarter": F.quarter(c), "month": F.month(c), "day": F.day(c),
            "dow": F.weekday(c), "doy": F.dayofyear(c)}


def flags(c: Column) -> dict[str, Column]:
    """Period edges and weekend; a missing date gives false."""
    day = F.to_date(c)
    last = F.last_day(day)
    quarter_end = F.month(c).isin(3, 6, 9, 12)
    out = {
        "is_month_start": F.day(c) == 1,
        "is_month_end": day == last,
        "is_quarter_start": (F.day(c) == 1) & F.month(c).isin(1, 4, 7, 10),
        "is_quarter_end": (day == last) & quarter_end,
        "is_year_start": F.dayofyear(c) == 1,
        "is_year_end": (F.month(c) == 12) & (F.day(c) == 31),
        "is_weekend": F.weekday(c).isin(5, 6),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in out.items()}


def clock_parts(c: Column) -> dict[str, Column]:
    return {"hour": F.hour(c), "minute": F.minute(c), "second": F.second(c).cast("int")}


def cyclic(value: Column, period: int) -> dict[str, Column]:
    angle = value.cast("double") * F.lit(2 * math.pi / period)
    return {"sin": F.sin(angle), "cos": F.cos(angle)}


def has_clock(df: DataFrame, times: dict[str, Column]) -> set[str]:
    """Columns with any non-zero hour, minute or second: one aggregate for all of them."""
    if not times:
        return set()
    names = list(times)
    row = df.agg(*[F.bool_or((F.hour(c) != 0) | (F.minute(c) != 0) | (F.floor(F.second(c)) != 0)).alias(f"t{i}")
                   for i, c in enumerate(times.values())]).first()
    return {n for i, n in enumerate(names) if row[i]}


def holiday_flag(df: DataFrame, col: str, calendar: DataFrame, country: str = "PL",
                 out: str = "is_holiday") -> DataFrame:
    """Whether the date is in the (country, day) calendar table; a missing date gives false."""
    days = calendar.filter(F.col("country") == country).select(F.to_date("day").alias("_day")).distinct()
    days = lookup_side(days.withColumn("_hit", F.lit(True)))
    joined = df.withColumn("_on", F.to_date(quoted(col))).join(days, F.col("_on") == F.col("_day"), "left")
    return joined.withColumn(out, F.coalesce("_hit", F.lit(False))).drop("_on", "_day", "_hit")


def date_features(df: DataFrame, cfg: DateFeatureConfig = DateFeatureConfig(),
                  holidays: DataFrame | None = None, country: str = "PL") -> DataFrame:
    """All features in one projection. Clash names get '__1'; no further date column is expanded
    once max_new_cols new columns exist."""
    names = list(cfg.date_cols or detect_datetime_cols(df))[:cfg.max_new_cols]
    times = {c: t for c in names if (t := ensure_datetime(df, c, cfg)) is not None}
    clocks = has_clock(df, times) if cfg.add_clock else set()
    new: dict[str, Column] = {}
    marked: list[str] = []

    def add(base: str, parts: dict[str, Column]) -> None:
        for k, v in parts.items():
            new[unique_name(f"{base}{cfg.sep}{k}", [*df.columns, *new])] = v

    for c, t in times.items():
        if cfg.add_calendar:
            add(c, calendar_parts(t))
        if cfg.add_flags:
            add(c, flags(t))
        if c in clocks:
            add(c, clock_parts(t))
        if cfg.add_cyclic:
            for part, period, value, there in (("month", 12, F.month(t), cfg.add_calendar),
                                               ("dow", 7, F.weekday(t), cfg.add_calendar),
                                               ("hour", 24, F.hour(t), c in clocks)):
                if there:
                    add(c, {f"{part}_{k}": v for k, v in cyclic(value, period).items()})
        if holidays is not None:
            marked.append(c)
        if cfg.max_new_cols is not None and len(new) + len(marked) >= cfg.max_new_cols:
            break
    out = df.withColumns(new) if new else df
    for c in marked:
        out = holiday_flag(out, c, holidays, country, unique_name(f"{c}{cfg.sep}is_holiday", out.columns))
    return out


def feature_names(before: DataFrame, after: DataFrame) -> Sequence[str]:
    return [c for c in after.columns if c not in before.columns]
