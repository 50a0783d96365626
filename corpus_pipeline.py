"""The training-data pipeline: documents through the stages of STAGES, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepkit.llm.bpe import vocabulary_path
from prepkit.llm.common import fresh_path, table, tuned
from prepkit.llm.jaccard import one_of_each
from prepkit.llm.linededup import drop_repeated_chunks
from prepkit.llm.packing import best_fit_pack
from prepkit.llm.quality import quality_rules
from prepkit.llm.secretscan import redact


def _counted(left: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, with n_chars of the text as it is now."""
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.select(*(F.col(f"`{c}`") for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    kept = quality_rules(docs, table(tuned(spark), sf_dir, "labels")).where("kept")
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the runs of lines that another document or place has had before."""
    tuned(spark)
    return _counted(drop_repeated_chunks(docs), docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    tuned(spark)
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with live-looking credentials replaced by a mark; widely copied examples stay."""
    tuned(spark)
    return _counted(redact(docs), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens from all documents left."""
    tuned(spark)
    return best_fit_pack(docs, vocabulary_path())


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("secret scans", secrets), ("best-fit packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(tuned(spark), sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The tokenizer and the classifier can't be had in SQL.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
