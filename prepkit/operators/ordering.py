"""Order-dependent work without one giant window.

A plain ``Window.orderBy`` without (or with a hot) partition key runs in one task. Here the rows
are cut into ranges of the order column; windows run inside (keys, range) and small per-range
totals carry what is needed from one range to the next. The number of ranges follows the counted rows;
a single range is the plain window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit.functions.columns import quoted, unique_name
from prepkit.functions.hashing import digest_unit, row_digest
from prepkit.functions.sizing import bucket_count, ranges_for
from prepkit.operators.quantiles import ACCURACY, range_splitters

RANGE = "_range"
LABELS_PER_TASK = 1_000_000
#: Even cuts that are taken along with the count; more ranges take a pass of their own.
EVEN = 256
#: Values that the cuts of a text column are taken from.
CUT_SAMPLE = 10_000


def as_number(df: DataFrame, col: str) -> Column:
    """The order column on a numeric axis (microseconds for times)."""
    dtype = df.schema[col].dataType
    if isinstance(dtype, T.TimestampNTZType):
        return F.unix_micros(quoted(col).cast("timestamp")).cast("double")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(quoted(col)).cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(quoted(col)).cast("double")
    return quoted(col).cast("double")


def with_range(df: DataFrame, col: str, parts: int | None = None) -> tuple[DataFrame, int]:
    """Add ``_range``: rows with a smaller order value never sit in a later range."""
    text = isinstance(df.schema[col].dataType, (T.StringType, T.BinaryType, T.BooleanType))
    axis = None if text else df.select(as_number(df, col).alias("x"))
    cuts: list[float] | None = None
    if parts is None and text:
        parts = bucket_count(df)
    elif parts is None:  # rows and even cuts in one pass
        n, even = axis.agg(F.count(F.lit(1)), F.percentile_approx("x", F.array(*[F.lit(i / EVEN) for i in range(1, EVEN)]), F.lit(ACCURACY))).first()
        parts = ranges_for(df.sparkSession, n)
        if 1 < parts <= EVEN and even:
            cuts = sorted({even[EVEN * i // parts - 1] for i in range(1, parts)})
    if parts <= 1:
        return df.withColumn(RANGE, F.lit(0)), 1
    if text:
        return _with_text_range(df, col, parts)
    if cuts is None:
        cuts = range_splitters(axis, "x", parts)
    if not cuts:
        return df.withColumn(RANGE, F.lit(0)), 1
    spot = unique_name("_axis", df.columns)
    placed = df.withColumn(spot, F.coalesce(as_number(df, col), F.lit(-math.inf)))
    cutter = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol=spot, outputCol=RANGE, handleInvalid="keep")
    return cutter.transform(placed).withColumn(RANGE, F.col(RANGE).cast("int")).drop(spot), len(cuts) + 1


def _with_text_range(df: DataFrame, col: str, parts: int) -> tuple[DataFrame, int]:
    """Ranges of a column that has no numeric axis: cuts are even steps through a sample by hash order.

    The sample is bounded and repeatable; it decides how even the ranges are, never which rows they hold.
    """
    x = quoted(col)
    sample = df.select(x.alias("x")).filter("x IS NOT NULL").orderBy(F.xxhash64("x"), "x").limit(CUT_SAMPLE)
    values = sorted({r["x"] for r in sample.collect()})
    cuts = [values[len(values) * i // parts] for i in range(1, min(parts, len(values)))]
    if not cuts:
        return df.withColumn(RANGE, F.lit(0)), 1
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= x))
    return df.withColumn(RANGE, F.when(x.isNull(), F.lit(0)).otherwise(place)), len(cuts) + 1


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], sums: dict[str, Column], parts: int,
    descending: bool = False,
) -> DataFrame:
    """Add inclusive running sums per key; ``df`` carries ``_range`` agreeing with ``order[0]``."""
    keys = list(keys)
    local = Window.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumns({n: F.sum(c).over(local) for n, c in sums.items()})
    if parts == 1:
        return out
    totals = df.groupBy(*keys, RANGE).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    by = F.desc(RANGE) if descending else F.asc(RANGE)
    earlier = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*keys, RANGE, *[
        F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_c_{n}") for n in sums])
    joined = out.join(carried, [*keys, RANGE])
    return joined.withColumns({n: F.col(n) + F.col(f"_c_{n}") for n in sums}).drop(*[f"_c_{n}" for n in sums])


def row_numbers(df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str] = (),
                name: str = "_pos", parts: int | None = None) -> DataFrame:
    """1-based position of each row per key along ``order`` (then ``ties``)."""
    ranged, n = with_range(df, order, parts)
    out = running_sums(ranged, keys, [F.col(order), *map(F.col, ties)], {name: F.lit(1).cast("bigint")}, n)
    return out.drop(RANGE)


def hash_ranks(df: DataFrame, groups: Sequence[str], key: Sequence[str], seed: int | str,
               name: str = "_rank", parts: int | None = None) -> DataFrame:
    """1-based place of each row inside its group along the hash order of ``key``.

    The hash is uniform, so ranges need no sketch: a hot group is spread over all of them.
    """
    parts = bucket_count(df) if parts is None else parts
    digest = unique_name("_digest", df.columns)
    out = df.withColumn(digest, row_digest(list(key), seed))
    place = F.floor(digest_unit(F.col(digest)) * parts).cast("int") if parts > 1 else F.lit(0)
    out = out.withColumn(RANGE, place)
    ranked = running_sums(out, groups, [F.col(digest), *[F.col(k) for k in key]],
                          {name: F.lit(1).cast("bigint")}, parts)
    return ranked.drop(RANGE, digest)


def dense_codes(labels: DataFrame, label: str, code: str) -> DataFrame:
    """Codes 0.. for a frame of distinct text labels in sorted order, numbered range by range."""
    ranged, parts = _with_text_range(labels, label, -(-labels.count() // LABELS_PER_TASK) or 1)
    out = running_sums(ranged, [], [F.col(label)], {code: F.lit(1).cast("bigint")}, parts)
    return out.withColumn(code, F.col(code) - 1).drop(RANGE)
