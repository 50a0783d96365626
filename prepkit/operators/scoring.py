"""Scoring: feature checks, batch prediction, prediction chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepkit.operators.ordering import row_numbers


def validate_features(df: DataFrame, expected: Sequence[str]) -> None:
    """The table must hold every feature of the model, and no more columns than the model knows."""
    missing = [c for c in expected if c not in df.columns]
    if missing or len(df.columns) != len(expected):
        raise ValueError(f"feature mismatch: table has {len(df.columns)} columns, model has {len(expected)}; missing {missing}")


def predict_chunks(df: DataFrame, score: Column | str, order: Sequence[str], chunks: int = 10, shown: int = 5) -> DataFrame:
    """k ordered chunks, the first n mod k one row longer: (chunk, n, sample_pred).

    Rows are numbered range by range (no single sorted task); sizes come from the total, and only the
    first ``shown`` predictions of a chunk are ever gathered.
    """
    k = max(1, int(chunks))
    scored = df.select(*order, (F.col(score) if isinstance(score, str) else score).alias("pred"))
    numbered = row_numbers(scored, [], order[0], order[1:])
    n = scored.agg(F.count("*").alias("n"))
    total = F.col("_n")
    size, longer = F.floor(total / k), total % k
    i = F.col("_pos") - 1
    cut = longer * (size + 1)
    chunk = F.when(i < cut, F.floor(i / (size + 1))).otherwise(longer + F.floor((i - cut) / F.greatest(size, F.lit(1))))
    start = F.when(chunk < longer, chunk * (size + 1)).otherwise(cut + (chunk - longer) * size)
    placed = numbered.withColumn("_n", n.scalar()).select(
        chunk.cast("int").alias("chunk"), (i - start).alias("at"), "pred")
    head = F.when(F.col("at") < shown, F.struct("at", "pred"))
    rows = placed.groupBy("chunk").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(head)).alias("_h"))
    # chunks beyond the rows are empty but present, as in any split in k parts
    every = df.sparkSession.range(k).select(F.col("id").cast("int").alias("chunk"))
    out = every.join(rows, "chunk", "left")
    return out.select("chunk", F.coalesce("n", F.lit(0)).alias("n"),
                      F.coalesce(F.transform("_h", lambda x: x["pred"]), F.array().cast("array<double>")).alias("sample_pred"))


def ndjson(df: DataFrame) -> DataFrame:
    """One JSON object per row, as text."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
