"""Sinks: table downloads, prediction lines, the drift reference."""

from __future__ import annotations

from pyspark.sql import DataFrame

from prepkit.functions.columns import numeric_columns
from prepkit.functions.sketch import sketch_columns
from prepkit.operators.scoring import ndjson


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    if fmt == "csv":
        df.write.mode(mode).option("header", True).option("encoding", "UTF-8").csv(path)
    elif fmt in ("json", "jsonl"):
        df.write.mode(mode).json(path)
    elif fmt == "parquet":
        df.write.mode(mode).parquet(path)
    elif fmt == "orc":
        df.write.mode(mode).orc(path)
    else:
        raise ValueError(f"unsupported format: {fmt}")
    return path


def write_ndjson(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    ndjson(df).write.mode(mode).text(path)
    return path


def write_drift_reference(df: DataFrame, path: str) -> str | None:
    """Sketches of the numeric columns, a row of some 100 KB a column at most; nothing to write when there are none.

    ``operators.drift.sketch_psi_table`` checks a table against it without the rows it was made from.
    """
    cols = numeric_columns(df)
    return write_table(sketch_columns(df, cols), path) if cols else None
