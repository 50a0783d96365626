"""Registered queries by family: each module has QUERIES (Spark) and ORACLES (the same result in SQL)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from prepkit.functions.sizing import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a stream of files."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the shared checkpoint folder of the session."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/run-{uuid.uuid4().hex}"
