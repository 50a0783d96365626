"""Insights and the EDA report, as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepkit.functions.columns import local_rows, numeric_columns
from prepkit.operators import profile as pf

IMBALANCE = 0.8


def recommendations(constant: DataFrame, high_card: DataFrame, problem: str, classes: DataFrame | None) -> DataFrame:
    """(rule, message) rows from the findings. Only lists of column names are gathered."""
    def named(found: DataFrame, rule: str, text: str) -> DataFrame:
        names = F.array_sort(F.collect_list("feature"))
        return (found.agg(names.alias("n")).filter(F.size("n") > 0)
                .select(F.lit(rule).alias("rule"),
                        F.concat(F.lit(text), F.concat_ws(", ", "n")).alias("message")))

    out = named(constant, "constant", "Columns with one value, to be dropped: ").unionByName(
        named(high_card, "high_cardinality", "Columns of mostly distinct values, to be encoded by target or hash: "))
    fixed = []
    if problem == "classification" and classes is not None:
        out = out.unionByName(classes.agg(F.max("fraction").alias("m")).filter(F.col("m") > IMBALANCE).select(
            F.lit("imbalance").alias("rule"),
            F.format_string("The largest class has %.1f%% of the rows: split by class, weight classes, judge by precision and recall.",
                            F.col("m") * 100).alias("message")))
        fixed.append(("models", "Compare boosted trees with a linear model, and calibrate before a threshold is set."))
    if problem == "regression":
        fixed.append(("models", "Compare boosted trees with a regularised linear model to see whether effects are linear."))
    fixed.append(("drift", "Track PSI of the features against the training table."))
    return out.unionByName(local_rows(constant.sparkSession, fixed, "rule string, message string"))


@dataclass
class Insights:
    rows: int
    target: str | None
    problem_type: str
    schema: DataFrame
    missing: DataFrame
    constant: DataFrame
    high_cardinality: DataFrame
    dates: list[str]
    signals: DataFrame
    classes: DataFrame | None
    recommendations: DataFrame

    def table(self) -> DataFrame:
        """Everything as (section, item, value, text) rows."""
        spark = self.schema.sparkSession

        def rows(df: DataFrame, section: str, item: str, value: str | None = None, text: Column | None = None) -> DataFrame:
            return df.select(F.lit(section).alias("section"), F.col(item).cast("string").alias("item"),
                             (F.col(value).cast("double") if value else F.lit(None).cast("double")).alias("value"),
                             (text.cast("string") if text is not None else F.lit(None).cast("string")).alias("text"))

        out = local_rows(spark, [("summary", "rows", float(self.rows), None), ("summary", "target", None, self.target),
                                 ("summary", "problem_type", None, self.problem_type),
                                 *[("date", d, None, None) for d in self.dates]],
                         "section string, item string, value double, text string")
        parts = [rows(self.schema, "schema", "feature", None, F.col("dtype")), rows(self.missing, "missing", "feature", "missing_ratio"),
                 rows(self.constant, "constant", "feature"), rows(self.high_cardinality, "high_cardinality", "feature", "distinct_ratio"),
                 rows(self.signals, "signal", "feature", "score"), rows(self.recommendations, "recommendation", "rule", None, F.col("message"))]
        if self.classes is not None:
            parts.append(rows(self.classes, "class", "label", "fraction"))
        for p in parts:
            out = out.unionByName(p)
        return out


def insights(df: DataFrame, target: str | None = None, max_rows: int | None = None,
             max_cols: int | None = None) -> Insights | None:
    """Schema, missing values, constant and high-cardinality columns, target, signals, advice.

    All rows are used; ``max_rows`` samples first. None for an empty table.
    """
    df = pf.bound_table(df, max_rows, max_cols) if max_rows else df.select(*df.columns[:max_cols])
    n = df.count()
    if not n:
        return None
    chosen = pf.infer_target(df, target)
    problem = pf.infer_problem_type(df, chosen, "insights") if chosen else "unknown"
    scores = pf.numeric_signals(df, chosen) if chosen else pf.variance_signals(df)
    classes = pf.class_stats(df, chosen) if chosen and problem == "classification" else None
    constant, high = pf.constant_columns(df), pf.high_cardinality(df)
    return Insights(n, chosen, problem, pf.schema_profile(df), pf.missing_ratio(df), constant, high, pf.date_columns(df),
                    pf.top_k(scores), classes, recommendations(constant, high, problem, classes))


def eda_report(df: DataFrame, metrics: dict[str, float] | None = None, max_hist_cols: int | None = None,
               include_corr: bool = True, sample: int = 12, max_describe_cols: int | None = None) -> dict[str, DataFrame]:
    """The report's tables by name; all numeric columns, unless a number of them is asked for."""
    out = {
        "metrics": local_rows(df.sparkSession, [(k, float(v)) for k, v in (metrics or {}).items()], "name string, value double"),
        "shape": pf.table_size(df), "schema": pf.schema_profile(df, None), "missing": pf.missing_table(df),
        "sample": pf.head(df, sample)}
    if numeric_columns(df):
        out["describe"] = pf.describe_numeric(df, max_describe_cols)
        out["histograms"] = pf.histogram(df, max_cols=max_hist_cols)
        if include_corr and len(numeric_columns(df)) > 1:
            out["correlation"] = pf.correlation_matrix(df)
    return out
