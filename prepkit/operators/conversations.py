"""Conversation operators over (conv_id, turn, role, text) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def approx_tokens(df: DataFrame, conv: str = "conv_id", role: str = "role", text: str = "text") -> DataFrame:
    """max(1, characters of text and role / 4) per conversation."""
    size = F.coalesce(F.length(text), F.lit(0)) + F.coalesce(F.length(role), F.lit(0))
    return df.groupBy(conv).agg(F.greatest(F.lit(1), F.floor(F.sum(size) / 4)).cast("bigint").alias("tokens"))


def context_window(df: DataFrame, max_tokens: int = 6000, last: int = 12, conv: str = "conv_id", turn: str = "turn",
                   role: str = "role", text: str = "text") -> DataFrame:
    """All system messages plus the longest run of at most ``last`` final other messages that fits,
    but at least the last one.

    The ranking with a small limit is cut down inside map tasks before the shuffle, so a very long
    conversation costs ``last`` rows per task; the running sum then sees at most ``last`` rows.
    """
    size = (F.coalesce(F.length(text), F.lit(0)) + F.coalesce(F.length(role), F.lit(0))).cast("bigint")
    is_system = F.coalesce(F.col(role) == "system", F.lit(False))
    newest = Window.partitionBy(conv).orderBy(F.desc(turn))
    rest = df.filter(~is_system).withColumn("_back", F.row_number().over(newest)).filter(F.col("_back") <= last)
    rest = rest.withColumn("_run", F.sum(size).over(newest.rowsBetween(Window.unboundedPreceding, 0)))
    system = df.filter(is_system)
    fixed = system.groupBy(conv).agg(F.sum(size).alias("_sys"))
    fits = F.floor((F.coalesce("_sys", F.lit(0)) + F.col("_run")) / 4) <= max_tokens
    kept = rest.join(fixed, conv, "left").filter((F.col("_back") == 1) | fits)
    return system.unionByName(kept.select(*df.columns))
