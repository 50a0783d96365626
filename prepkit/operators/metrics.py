"""Evaluation metrics. Curves are built from score groups, so ties are exact and rows are merged first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepkit.functions.columns import local_rows
from prepkit.operators.ordering import RANGE, running_sums, with_range
from prepkit.operators.quantiles import linear_quantiles

# 37 quantiles from 0.05 to 0.95.
THRESHOLD_QUANTILES = tuple(0.05 + 0.025 * k for k in range(37))


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn), F.lit(0.0))


def threshold_scores(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, tp, fp, fn, tn, f1, accuracy, youden) for each distinct candidate.

    Rows are counted by the number of candidates they reach in one pass; the confusion counts are
    suffix sums over at most 38 rows.
    """
    found = linear_quantiles(df, [score], THRESHOLD_QUANTILES)[score]
    cuts = sorted({v for v in found if v is not None})
    if not cuts:
        return local_rows(df.sparkSession, [], "threshold double, tp bigint, fp bigint, fn bigint, tn bigint, f1 double, "
                                               "accuracy double, youden double")
    reached = F.lit(0)
    for t in cuts:
        reached = reached + (F.col(score) >= F.lit(t)).cast("int")
    per = (df.filter(F.col(score).isNotNull()).withColumn("reached", reached).groupBy("reached")
           .agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")))
    folded = per.agg(F.collect_list(F.struct("reached", "p", "n")).alias("g"))
    rows = F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(t).alias("threshold")) for i, t in enumerate(cuts)])

    def total(field: str, test) -> Column:
        return F.aggregate(F.filter("g", test), F.lit(0).cast("bigint"), lambda a, x: a + x[field])

    out = folded.select("g", F.inline(rows))
    out = out.withColumns({
        "tp": total("p", lambda x: x["reached"] >= F.col("i")), "fp": total("n", lambda x: x["reached"] >= F.col("i")),
        "fn": total("p", lambda x: x["reached"] < F.col("i")), "tn": total("n", lambda x: x["reached"] < F.col("i"))})
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    one = F.lit(1)
    return out.select("threshold", "tp", "fp", "fn", "tn", _f1(tp, fp, fn).alias("f1"),
                      ((tp + tn) / (tp + fp + fn + tn)).alias("accuracy"),
                      (tp / F.greatest(tp + fn, one) - fp / F.greatest(fp + tn, one)).alias("youden"))


def best_threshold(df: DataFrame, label: str, score: str, metric: str = "f1") -> DataFrame:
    """The first best candidate: highest score, lowest threshold on ties."""
    if metric not in ("f1", "accuracy", "youden"):
        raise ValueError("metric must be f1, accuracy or youden")
    return (threshold_scores(df, label, score).select("threshold", F.col(metric).alias("score"))
            .orderBy(F.desc("score"), "threshold").limit(1))


def ranking_metrics(df: DataFrame, label: Column, score: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, roc_auc, pr_auc): ROC area with half credit for ties, average precision over distinct scores."""
    keys = list(keys)
    groups = (df.withColumn("_y", label.cast("int")).filter(F.col(score).isNotNull())
              .groupBy(*keys, score).agg(F.sum("_y").cast("bigint").alias("p"), F.sum(1 - F.col("_y")).cast("bigint").alias("n")))
    ranged, parts = with_range(groups, score)
    run = running_sums(ranged, keys, [F.desc(score)], {"tp": F.col("p"), "fp": F.col("n")}, parts, descending=True).drop(RANGE)
    p, n, tp, fp = (F.col(c).cast("double") for c in ("p", "n", "tp", "fp"))
    g = run.groupBy(*keys) if keys else run
    # rank-sum form: each group's positives beat the negatives below it and half of its own
    sums = g.agg(F.sum(p).alias("P"), F.sum(n).alias("N"), F.sum(p * fp).alias("above"), F.sum(p * n).alias("own"),
                 F.sum(p * tp / (tp + fp)).alias("ap"))
    area = (F.col("P") * F.col("N") - F.col("above") + F.col("own") / 2) / F.nullif(F.col("P") * F.col("N"), F.lit(0.0))
    return sums.select(*keys, area.alias("roc_auc"), (F.col("ap") / F.nullif(F.col("P"), F.lit(0.0))).alias("pr_auc"))


def binary_metrics(df: DataFrame, label: str, score: str, threshold: float = 0.5, pred: str | None = None) -> DataFrame:
    """accuracy, f1, roc_auc, pr_auc as one row; predictions are score >= threshold unless given."""
    y = F.col(label) == 1
    hit = F.col(pred) == 1 if pred else F.col(score) >= F.lit(threshold)
    counts = df.agg(F.count_if(y & hit).alias("tp"), F.count_if(~y & hit).alias("fp"),
                    F.count_if(y & ~hit).alias("fn"), F.count_if(y == hit).alias("right"), F.count("*").alias("t"))
    base = counts.select(F.try_divide(F.col("right"), F.col("t")).alias("accuracy"),
                         _f1(F.col("tp"), F.col("fp"), F.col("fn")).alias("f1"), F.lit(1).alias("_one"))
    curve = ranking_metrics(df, y, score).withColumn("_one", F.lit(1))
    return base.join(curve, "_one").select("accuracy", "f1", "roc_auc", "pr_auc")


def multiclass_metrics(df: DataFrame, label: str, scores: str, pred: str | None = None) -> DataFrame:
    """accuracy, weighted f1, one-vs-rest macro ROC area and macro average precision.

    ``label`` holds class codes 0..k-1, ``scores`` an array of k class scores. Without ``pred`` the
    highest score (first on ties) is the prediction.
    """
    yhat = F.col(pred).cast("int") if pred else (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
    base = df.select(F.col(label).cast("int").alias("y"), yhat.alias("yhat"), F.col(scores).alias("s"))
    cells = base.groupBy("y", "yhat").agg(F.count("*").alias("n"))
    sides = cells.select(F.inline(F.array(
        F.struct(F.col("y").alias("c"), F.when(F.col("y") == F.col("yhat"), F.col("n")).otherwise(0).alias("tp"),
                 F.col("n").alias("real"), F.lit(0).cast("bigint").alias("said")),
        F.struct(F.col("yhat").alias("c"), F.lit(0).cast("bigint").alias("tp"),
                 F.lit(0).cast("bigint").alias("real"), F.col("n").alias("said")))))
    per = sides.groupBy("c").agg(F.sum("tp").alias("tp"), F.sum("real").alias("real"), F.sum("said").alias("said"))
    f1 = F.coalesce(F.try_divide(F.lit(2.0) * F.col("tp"), F.col("real") + F.col("said")), F.lit(0.0))
    flat = per.agg(F.try_divide(F.sum("tp"), F.sum("real")).alias("accuracy"),
                   F.try_divide(F.sum(f1 * F.col("real")), F.sum("real")).alias("f1_weighted"), F.lit(1).alias("_one"))
    each = base.select("y", F.posexplode("s").alias("c", "score"))
    curve = (ranking_metrics(each, F.col("y") == F.col("c"), "score", ["c"])
             .agg(F.avg("roc_auc").alias("roc_auc_ovr"), F.avg("pr_auc").alias("pr_auc_macro"), F.lit(1).alias("_one")))
    return flat.join(curve, "_one").select("accuracy", "f1_weighted", "roc_auc_ovr", "pr_auc_macro")


def regression_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """R2, MAE and RMSE in one aggregate."""
    y, e = F.col(label).cast("double"), F.col(label).cast("double") - F.col(pred).cast("double")
    s = df.agg(F.avg(e * e).alias("mse"), F.avg(F.abs(e)).alias("mae"), F.var_pop(y).alias("v"))
    return s.select((F.lit(1.0) - F.col("mse") / F.nullif(F.col("v"), F.lit(0.0))).alias("r2"), "mae",
                    F.sqrt("mse").alias("rmse"))
