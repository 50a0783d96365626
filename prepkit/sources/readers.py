"""Readers that find the format themselves, and the load path used before cleaning."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepkit.functions import text as tx
from prepkit.functions.columns import aggregate_rows, local_rows, quoted, string_columns
from prepkit.operators.clean import dedupe_names, normalize_missing, parse_ratios
from prepkit.sources.elements import read_arrays
from prepkit.sources.files import Files
from prepkit.sources.records import spanning_records

# Format by file ending.
FORMATS = {".parquet": "parquet", ".orc": "orc", ".jsonl": "jsonl", ".ndjson": "jsonl", ".json": "json",
           ".csv": "csv", ".tsv": "tsv", ".txt": "csv"}
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")
SEPARATORS = (",", ";", "\t", "|")


def detect_format(spark: SparkSession, path: str) -> str:
    """By ending (a compression ending is looked through), then by the first bytes, else csv."""
    name = path.lower().rstrip("/")
    for ending in COMPRESSED:
        name = name.removesuffix(ending)
    for ending, fmt in FORMATS.items():
        if name.endswith(ending):
            return fmt
    first = Files(spark, path).head(path)
    if first.startswith(b"PAR1"):
        return "parquet"
    if first.startswith(b"ORC"):
        return "orc"
    return "csv"


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The candidate that most lines hold, then the most frequent one; decided over all lines in one aggregate."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    times = [F.length("value") - F.length(F.replace("value", F.lit(s), F.lit(""))) for s in SEPARATORS]
    found = lines.agg(*[m for t in times for m in (F.count(F.when(t > 0, 1)), F.sum(t))]).first()
    return SEPARATORS[max(range(len(SEPARATORS)), key=lambda i: (found[2 * i], found[2 * i + 1] or 0, -i))]


def read_csv(spark: SparkSession, path: str, sep: str | None = None, encoding: str = "UTF-8",
             schema: T.StructType | str | None = None, multi_line: bool = True) -> DataFrame:
    """Header row, sniffed separator. Types are inferred unless a schema is given, which saves a pass.

    Quoted values may hold line breaks: ranges of a file find out which of their lines begin inside quotes
    (``records``), so that a file is many tasks. Where no record spans lines, Spark's own reader splits it;
    ``multi_line=False`` says so without looking. Other encodings than UTF-8 are read by one task a file.

    Values are kept as written: text marks for "missing" are the business of ``normalize_missing``.
    """
    sep = sep or sniff_separator(spark, path)
    options = {"sep": sep, "quote": '"', "escape": '"'}
    records = spanning_records(spark, path, sep) if multi_line and encoding.upper().replace("-", "") == "UTF8" else None
    if multi_line and records is None and encoding.upper().replace("-", "") == "UTF8":
        multi_line = False
    reader = spark.read.options(**options, encoding=encoding, multiLine=multi_line)
    if records is None and schema is not None:
        return reader.schema(schema).option("header", True).csv(path)
    first = reader.option("header", False).csv(path).limit(1).collect()
    if records is None:
        df = reader.option("header", True).option("inferSchema", True).csv(path)
        if first and len(first[0]) == len(df.columns):  # Spark renames repeated headers by position; use our rule
            df = df.toDF(*dedupe_names([(h or "").strip() for h in first[0]]))
        return df
    names = dedupe_names([(h or "").strip() for h in first[0]])
    wanted = schema if schema is not None else T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    wanted = T.StructType.fromDDL(wanted) if isinstance(wanted, str) else wanted
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.fields)
    parsed = F.from_csv("text", ddl, {**options, "multiLine": "true"})
    df = records.where(~F.col("first")).select(parsed.alias("r")).select("r.*")
    return df if schema is not None else infer_types(df.toDF(*names))


def infer_types(df: DataFrame) -> DataFrame:
    """Text columns as int, bigint, decimal, double, date, timestamp or boolean where all their values are; one aggregate."""
    number = r"^\s*[+-]?(NaN|Infinity|(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)\s*$"

    def measures(c: str) -> list[Column]:
        x = quoted(c)
        whole = x.rlike(r"^[+-]?\d{1,38}$")
        tests = [whole & x.try_cast("int").isNotNull(), whole & x.try_cast("bigint").isNotNull(), whole, x.rlike(number),
                 x.rlike(r"^\d{4}-\d{2}-\d{2}$") & x.try_cast("date").isNotNull(), x.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$") & x.try_cast("timestamp").isNotNull(),
                 F.lower(x).isin("true", "false")]
        return [F.count(x), *(F.count(F.when(t, 1)) for t in tests), F.max(F.when(whole, F.length(x)))]

    kinds = ["int", "bigint", None, "double", "date", "timestamp", "boolean"]
    found = df.agg(F.array(*[F.array(*[m.cast("bigint") for m in measures(c)]) for c in df.columns]).alias("m")).first()["m"]
    out = []
    for c, (n, *fits, digits) in zip(df.columns, found, strict=True):
        kind = next((k or f"decimal({digits},0)" for k, m in zip(kinds, fits, strict=True) if n and m == n), "string")
        out.append(quoted(c).cast(kind).alias(c))
    return df.select(*out)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema is not None else spark.read).json(path)


def read_json_records(spark: SparkSession, path: str) -> DataFrame:
    """An array (or object) per file; nested objects become dotted columns. Arrays of objects are read by many tasks a file."""
    df = read_arrays(spark, path)
    return flatten(df if df is not None else spark.read.option("multiLine", True).json(path))


def flatten(df: DataFrame) -> DataFrame:
    def leaves(schema: T.StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for f in schema.fields:
            here = (*path, f.name)
            if isinstance(f.dataType, T.StructType):
                out += leaves(f.dataType, here)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in here)).alias(".".join(here)))
        return out

    return df.select(*leaves(df.schema, ()))


def read_parquet(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_any(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    fmt = fmt or detect_format(spark, path)
    if fmt == "parquet":
        return read_parquet(spark, path)
    if fmt == "orc":
        return spark.read.orc(path)
    if fmt == "jsonl":
        return flatten(read_json_lines(spark, path))
    if fmt == "json":
        return read_json_records(spark, path)
    if fmt in ("csv", "tsv"):
        return read_csv(spark, path, "\t" if fmt == "tsv" else None)
    raise ValueError(f"unsupported format: {fmt}")


# --- after reading -------------------------------------------------------------------------

# Whole-number types from narrow to wide.
WHOLE_TYPES = (("tinyint", 1 << 7), ("smallint", 1 << 15), ("int", 1 << 31), ("bigint", 1 << 63))


def downcast_plan(df: DataFrame) -> DataFrame:
    """(feature, old_type, new_type): the narrowest whole type that holds min and max; FLOAT where no
    value changes by more than float rounding and none overflows. One aggregate."""
    cols = [f.name for f in df.schema if isinstance(f.dataType, (T.IntegralType, T.FloatType, T.DoubleType))]
    if not cols:
        return local_rows(df.sparkSession, [], "feature string, old_type string, new_type string")

    def new_type(c: str) -> Column:
        dtype = df.schema[c].dataType
        x = quoted(c)
        if isinstance(dtype, T.IntegralType):
            lo, hi = F.min(x), F.max(x)
            out = F.lit(dtype.simpleString())
            for name, bound in reversed(WHOLE_TYPES[:-1]):
                out = F.when((lo >= -bound) & (hi < bound), F.lit(name)).otherwise(out)
            return F.when(lo.isNull(), F.lit(dtype.simpleString())).otherwise(out)
        if isinstance(dtype, T.FloatType):
            return F.lit("float")
        narrow = x.cast("float").cast("double")
        safe = F.bool_and(x.isNull() | F.isnan(x) | (narrow == x) | (F.abs(narrow - x) <= F.abs(x) * 1e-5 + 1e-8))
        return F.when(F.coalesce(safe, F.lit(True)), F.lit("float")).otherwise(F.lit("double"))

    return aggregate_rows(df, cols, {"old_type": lambda c: F.lit(df.schema[c].dataType.simpleString()), "new_type": new_type})


def downcast_numbers(df: DataFrame) -> DataFrame:
    new = {r["feature"]: r["new_type"] for r in downcast_plan(df).filter("old_type != new_type").collect()}
    return df.withColumns({c: quoted(c).cast(t) for c, t in new.items()}) if new else df


# Characters that dates are written with.
LOOKS_LIKE_DATE = r"[\d:/\-TZ ]"


def date_parse_plan(df: DataFrame, threshold: float = 0.8) -> dict[str, tuple[str, str]]:
    """Text columns to be read as dates: half of the values must look like dates at all, then month-first
    is tried before day-first (NULLs count as failures). All over all rows, one aggregate for all columns."""
    cols = string_columns(df)
    if not cols:
        return {}
    share = df.agg(*[F.avg(quoted(c).rlike(LOOKS_LIKE_DATE).cast("int")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    likely = [c for i, c in enumerate(cols) if (share[f"s{i}"] or 0.0) >= 0.5]
    found: dict[str, tuple[str, str]] = {}
    for dayfirst in (False, True):
        left = [c for c in likely if c not in found]
        if not left:
            break
        for r in parse_ratios(df, left, dayfirst, numbers=False).collect():
            if r["layout"] is not None and r["date_ok"] >= threshold * r["n_rows"]:
                found[r["feature"]] = tx.layouts(dayfirst)[r["layout"]]
    return {c: found[c] for c in cols if c in found}


def auto_parse_dates(df: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, list[str]]:
    plan = date_parse_plan(df, threshold)
    out = df.withColumns({c: tx.parse_layout(quoted(c), y) for c, y in plan.items()}) if plan else df
    return out, list(plan)


@dataclass(frozen=True)
class LoadMeta:
    source_name: str
    detected_format: str
    encoding: str | None
    rows: int | None
    cols: int
    parsed_dates: tuple[str, ...]
    dtypes_before: dict[str, str]
    dtypes_after: dict[str, str]
    read_time_ms: int

    def frame(self, spark: SparkSession) -> DataFrame:
        row = (self.source_name, self.detected_format, self.encoding, self.rows, self.cols, list(self.parsed_dates),
               self.read_time_ms)
        return local_rows(spark, [row], "source_name string, detected_format string, encoding string, rows bigint, "
                                        "cols int, parsed_dates array<string>, read_time_ms bigint")


def smart_read(spark: SparkSession, path: str, fmt: str | None = None) -> tuple[DataFrame, LoadMeta]:
    """Read, unify missing marks, narrow the numbers, parse dates."""
    start = time.time()
    fmt = fmt or detect_format(spark, path)
    df = read_any(spark, path, fmt)
    df = df.toDF(*dedupe_names(df.columns))
    before = dict(df.dtypes)
    df = downcast_numbers(normalize_missing(df))
    df, dates = auto_parse_dates(df)
    meta = LoadMeta(path.rstrip("/").rsplit("/", 1)[-1], fmt, "UTF-8" if fmt in ("csv", "tsv", "json", "jsonl") else None,
                    None, len(df.columns), tuple(dates), before, dict(df.dtypes), int((time.time() - start) * 1000))
    return df, meta


def load_meta(df: DataFrame, meta: LoadMeta) -> LoadMeta:
    """The record with its row count, which costs a pass and so is only taken when asked for."""
    return replace(meta, rows=df.count())


def load_table(spark: SparkSession, path: str | None, max_rows: int | None = None, coerce_tz_to: str | None = None,
               order: Sequence[str] | None = None) -> DataFrame | None:
    """``smart_read``, optionally the first rows only, with zoned times converted and made zone-free."""
    if path is None:
        return None
    df, _ = smart_read(spark, path)
    if max_rows:
        df = (df.orderBy(*order) if order else df).limit(max_rows)
    if coerce_tz_to:
        zoned = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)]
        df = df.withColumns({c: F.convert_timezone(F.current_timezone(), F.lit(coerce_tz_to), quoted(c).cast("timestamp_ntz"))
                             for c in zoned})
    return df
