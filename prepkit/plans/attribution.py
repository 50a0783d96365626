"""Sampled Shapley attributions of any fitted pipeline, as one scoring job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepkit.functions.columns import number, quoted
from prepkit.functions.hashing import row_digest
from prepkit.operators.profile import sample_rows

TREE_NAMES = ("RandomForest", "GBT", "DecisionTree", "OneVsRest")


def attribution_sample(df: DataFrame, key: Sequence[str], max_samples: int = 500, max_background: int = 200,
                       seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Rows to explain and background rows: the first of the same hash order."""
    return sample_rows(df, max_samples, seed, key), sample_rows(df, max_background, seed, key)


def pick_member(model: PipelineModel) -> PipelineModel:
    """Of several chained predictors keep the first tree one, else the first."""
    heads = [s for s in model.stages if s.hasParam("predictionCol") and s.hasParam("featuresCol")]
    if len(heads) < 2:
        return model
    best = next((s for s in heads if any(t in type(s).__name__ for t in TREE_NAMES)), heads[0])
    return PipelineModel([s for s in model.stages if s not in heads or s is best])


def output_value(model: PipelineModel, scored: DataFrame, class_index: int = 1) -> Column:
    """What is explained: the class probability where there is one, else the prediction."""
    head = next(s for s in reversed(model.stages) if s.hasParam("predictionCol"))
    if head.hasParam("probabilityCol") and head.getOrDefault("probabilityCol") in scored.columns:
        return vector_to_array(head.getOrDefault("probabilityCol"))[class_index]
    return F.col(head.getOrDefault("predictionCol"))


def shapley_values(model: PipelineModel, df: DataFrame, features: Sequence[str], key: str, max_samples: int = 500,
                   max_background: int = 200, seed: int = 42, class_index: int = 1) -> DataFrame:
    """(key, feature, contribution, base_value).

    Each explained row is paired once with each background row and walks from it to itself, one
    feature at a time in a hash-drawn order; steps are scored by the model and the changes averaged.
    A linear model gets its exact values. Size: samples x background x (features + 1) rows, all
    bounded by the arguments and spread over tasks.
    """
    member = pick_member(model)
    rows, background = attribution_sample(df, [key], max_samples, max_background, seed)
    d = len(features)
    n_back = background.count()
    numbered = background.select(
        F.row_number().over(_by_digest(key, seed)).alias("_j"), *[quoted(f).alias(f"_b_{i}") for i, f in enumerate(features)])
    asked = rows.select(F.col(key).alias("_id"), *[quoted(f).alias(f"_x_{i}") for i, f in enumerate(features)])
    pairs = asked.withColumn("_j", F.explode(F.sequence(F.lit(1), F.lit(n_back)))).join(numbered, "_j")
    drawn = F.array_sort(F.array(*[F.struct(row_digest(["_id", "_j", F.lit(i)], seed).alias("h"), F.lit(i).alias("i"))
                                   for i in range(d)]))
    walk = (pairs.repartition("_id", "_j").withColumn("_order", F.transform(drawn, lambda s: s["i"]))
            .withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(d)))))
    own = {f: F.when(F.array_position("_order", F.lit(i)) <= F.col("_step"), F.col(f"_x_{i}")).otherwise(F.col(f"_b_{i}"))
           for i, f in enumerate(features)}
    scored = member.transform(walk.select("_id", "_order", "_step", *[c.alias(f) for f, c in own.items()]))
    value = scored.select("_id", "_order", "_step", output_value(member, scored, class_index).alias("v"))
    changes = value.select("_id", F.inline(F.array(
        F.struct(F.when(F.col("_step") > 0, F.get("_order", F.col("_step") - 1)).alias("i"), F.col("v").alias("c")),
        F.struct(F.when(F.col("_step") < d, F.get("_order", F.col("_step"))).alias("i"), (-F.col("v")).alias("c")))))
    names = F.array(*map(F.lit, features))
    base = value.filter("_step = 0").groupBy("_id").agg(F.avg("v").alias("base_value"))
    return (changes.filter("i IS NOT NULL").groupBy("_id", "i").agg((F.sum("c") / n_back).alias("contribution"))
            .join(base, "_id")
            .select(F.col("_id").alias(key), names[F.col("i")].alias("feature"), "contribution", "base_value"))


def _by_digest(key: str, seed: int):
    from pyspark.sql import Window

    return Window.orderBy(row_digest([key], seed), key)  # over at most max_background rows


def linear_attribution(df: DataFrame, key: str, weights: dict[str, float], background: DataFrame | None = None) -> DataFrame:
    """Exact values of a linear score: w * (x - background mean)."""
    source = background if background is not None else df
    means = source.agg(*[F.avg(number(source, f)).alias(f"m{i}") for i, f in enumerate(weights)]).first()
    entries = [F.struct(F.lit(f).alias("feature"), ((number(df, f) - F.lit(means[i])) * F.lit(w)).alias("contribution"))
               for i, (f, w) in enumerate(weights.items())]
    return df.select(quoted(key), F.inline(F.array(*entries)))
