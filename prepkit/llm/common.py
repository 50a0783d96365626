"""Helpers of the subpackage: tables in the shared folder, Arrow batches, keys of rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

WORD = r"[^\x20\x09-\x0D]+"
#: Rows a batch that goes to Python holds; texts are long, so that batches stay small.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tuned(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, adaptive joins: a batch of whole texts has to fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='spark-llm-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/llm-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder: survives lost executors, and is computed once.

    A table that is read has no partitioning, so that joins with it exchange both sides, and adaptive
    execution can split their hot keys.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_key(id_col: str, text_col: str) -> list[Column]:
    """Key of a row: its id and a hash of its text. Rows that repeat in both are the same to an operator."""
    return [F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit("\0"))).alias("_th")]


def shielded(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns named own_0, own_1, ..., which no helper column is named like, and the new name of each."""
    own = {c: f"own_{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*(f"own_{i}" for i in range(len(df.columns)))), own


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: StructType | str) -> DataFrame:
    """``work`` over each Arrow batch; a batch for which it returns None leaves nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := work(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column's texts; a null is an empty text."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]
