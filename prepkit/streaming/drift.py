"""Drift over event-time windows against a fixed base."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepkit.functions.columns import local_rows, number
from prepkit.operators.drift import PsiPlan, bin_index, contributions, plan_psi, severity


def base_counts(base: DataFrame, column: str, plan: PsiPlan) -> DataFrame:
    """(bin, n_base) of the base, all bins present."""
    edges = plan.edges[column]
    slots = local_rows(base.sparkSession, [(i + 1,) for i in range(len(edges) - 1)], "bin int")
    counts = (base.select(bin_index(number(base, column), edges).alias("bin")).filter("bin > 0")
              .groupBy("bin").agg(F.count("*").alias("n_base")))
    return slots.join(counts, "bin", "left").na.fill(0, ["n_base"])


def window_counts(df: DataFrame, ts: str, column: str, plan: PsiPlan, width: str = "60 minutes",
                  watermark: str | None = None) -> DataFrame:
    """(window_start, bin, n_curr) per tumbling window; works on tables and on streams."""
    times = df.withColumn("_ts", F.col(ts).cast("timestamp"))
    if watermark:
        times = times.withWatermark("_ts", watermark)
    x = bin_index(number(df, column), plan.edges[column])
    return (times.withColumn("bin", x).filter("bin > 0").groupBy(F.window("_ts", width), "bin")
            .agg(F.count("*").alias("n_curr"))
            .select(F.col("window.start").alias("window_start"), "bin", "n_curr"))


def window_psi(counts: DataFrame, base: DataFrame, plan: PsiPlan) -> DataFrame:
    """(window_start, n_curr, psi, severity): every window is aligned with every base bin."""
    totals = counts.groupBy("window_start").agg(F.sum("n_curr").alias("t_curr"))
    slots = base.agg(F.collect_list(F.struct("bin", "n_base")).alias("s"), F.sum("n_base").alias("t_base"))  # a few bins
    frame = totals.withColumn("_b", slots.select(F.struct("s", "t_base")).scalar()).select(
        "window_start", "t_curr", "_b.t_base", F.inline("_b.s"))
    aligned = frame.join(counts, ["window_start", "bin"], "left").na.fill(0, ["n_curr"])
    return (contributions(aligned, plan.config).groupBy("window_start", "t_curr").agg(F.sum("psi_contrib").alias("psi"))
            .select("window_start", F.col("t_curr").alias("n_curr"), "psi", severity(F.col("psi")).alias("severity")))


def drift_windows(df: DataFrame, base: DataFrame, ts: str, column: str, plan: PsiPlan | None = None,
                  width: str = "60 minutes") -> DataFrame:
    plan = plan or plan_psi(base, [column])
    return window_psi(window_counts(df, ts, column, plan, width), base_counts(base, column, plan), plan)


def drift_stream(stream: DataFrame, base: DataFrame, ts: str, column: str, sink: Callable[[DataFrame, int], None],
                 plan: PsiPlan | None = None, width: str = "60 minutes", watermark: str = "60 minutes"):
    """A stream writer that hands the PSI of every closed window to ``sink``.

    A window's bins are packed into one row before it is emitted, so a window always arrives whole.
    """
    plan = plan or plan_psi(base, [column])
    edges = plan.edges[column]
    known = base_counts(base, column, plan).persist()
    times = stream.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", watermark)
    x = bin_index(number(stream, column), edges)
    packed = (times.withColumn("bin", x).filter("bin > 0").groupBy(F.window("_ts", width))
              .agg(*[F.count_if(F.col("bin") == i + 1).alias(f"b{i + 1}") for i in range(len(edges) - 1)]))

    def each(batch: DataFrame, epoch: int) -> None:
        counts = batch.select(F.col("window.start").alias("window_start"), F.inline(F.array(*[
            F.struct(F.lit(i + 1).alias("bin"), F.col(f"b{i + 1}").alias("n_curr")) for i in range(len(edges) - 1)])))
        sink(window_psi(counts, known, plan), epoch)

    return packed.writeStream.outputMode("append").foreachBatch(each)
