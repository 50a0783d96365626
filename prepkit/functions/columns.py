"""Column pickers, missing-value rules and reshaping shared by every operator."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Timestamps = (T.TimestampType, T.TimestampNTZType, T.DateType)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_floating(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_numeric(f.dataType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def timestamp_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, Timestamps)]


def quoted(name: str) -> Column:
    """Reference a column whose name may hold dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL: one notion of missing."""
    c = quoted(name)
    return F.when(~F.isnan(c), c) if is_floating(df.schema[name].dataType) else c


def number(df: DataFrame, name: str) -> Column:
    return present(df, name).cast("double")


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}; available: {df.columns[:20]}")


def _typed_entry(df: DataFrame, name: str) -> Column:
    """(feature, i, d, s): the value sits in the slot of its own kind, so no text casts."""
    dtype = df.schema[name].dataType
    c = present(df, name)
    i, d, s = F.lit(None).cast("bigint"), F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(dtype, (T.IntegralType, T.BooleanType)):
        i = c.cast("bigint")
    elif is_floating(dtype):
        d = c.cast("double") + F.lit(0.0)
    elif isinstance(dtype, T.TimestampType):
        i = F.unix_micros(c)
    else:
        s = c.cast("string")
    return F.struct(F.lit(name).alias("feature"), i.alias("i"), d.alias("d"), s.alias("s"))


def unpivot_typed(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(F.inline(F.array(*[_typed_entry(df, c) for c in cols])))


def aggregate_rows(
    df: DataFrame,
    cols: Sequence[str],
    measures: dict[str, Callable[[str], Column]],
    extra: dict[str, Callable[[str], Column]] | None = None,
) -> DataFrame:
    """All measures of all columns in one aggregate, turned into one row per column."""
    entries = [
        F.struct(F.lit(c).alias("feature"), *[m(c).alias(n) for n, m in measures.items()],
                 *[m(c).alias(n) for n, m in (extra or {}).items()])
        for c in cols
    ]
    return df.agg(F.array(*entries).alias("_rows")).select(F.inline("_rows"))


def local_rows(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """A small driver-made table as a local relation, whose size the optimizer knows."""
    st = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    arrays = [pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(to_arrow_schema(st))]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=st.names), schema=st)


def unique_name(name: str, taken: Sequence[str]) -> str:
    if name not in taken:
        return name
    i = 1
    while f"{name}__{i}" in taken:
        i += 1
    return f"{name}__{i}"
