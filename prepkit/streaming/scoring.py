"""Scoring of live input with a fitted pipeline."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def predict_stream(model: PipelineModel, stream: DataFrame, keep: list[str]) -> DataFrame:
    """Row-wise transform of a stream: (keep..., prediction)."""
    return model.transform(stream).select(*keep, "prediction")


def chunk_writer(scored: DataFrame, path: str, checkpoint: str, order: str, shown: int = 5):
    """One NDJSON line per micro-batch: {chunk, n, sample_pred}. Few predictions are ever gathered.

    Each micro-batch has a folder of its own, so that one that is retried replaces its line.
    """
    def each(batch: DataFrame, epoch: int) -> None:
        first = batch.orderBy(order).limit(shown).agg(F.sort_array(F.collect_list(F.struct(order, "prediction"))).alias("h"))
        line = batch.agg(F.count("*").alias("n")).withColumn("h", first.scalar()).select(
            F.lit(epoch).alias("chunk"), "n", F.col("h.prediction").alias("sample_pred"))
        line.select(F.to_json(F.struct("chunk", "n", "sample_pred")).alias("value")).write.mode("overwrite").text(f"{path}/epoch={epoch}")

    return scored.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
