"""The training job: read, check, train, store the model, write report tables and the drift reference."""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from prepkit.functions.columns import local_rows
from prepkit.plans.automl import train_fusion
from prepkit.plans.insights import eda_report
from prepkit.sources.readers import smart_read
from prepkit.sources.sinks import write_drift_reference, write_table
from prepkit.sources.store import ModelCatalogue


def train_job(spark: SparkSession, path: str, target: str, key: str, output: str, trials: int = 30,
              **search: Any) -> DataFrame:
    """One summary row: model path, problem type, metric, score, report and reference paths, seconds."""
    start = time.time()
    df, _ = smart_read(spark, path)
    if df.isEmpty():
        raise ValueError("empty input")
    if target not in df.columns:
        raise KeyError(f"no target column '{target}'; available: {df.columns[:20]}")
    result = train_fusion(df, target, key, trials=trials, **search)
    model_path = ModelCatalogue(spark, f"{output}/models").save_model(
        result.model, f"fusion_{result.problem_type}",
        extra={"weights": result.blend_weights, "labels": result.labels, "features": result.features})
    report = f"{output}/report"
    for name, table in eda_report(df, {result.metric_name: result.best_score}).items():
        write_table(table, f"{report}/{name}")
    reference = write_drift_reference(df, f"{output}/drift_reference")
    return local_rows(spark, [(model_path, result.problem_type, result.metric_name, result.best_score, report, reference,
                               time.time() - start)],
                      "model_path string, problem_type string, metric_name string, best_score double, report string, "
                      "drift_reference string, seconds double")
