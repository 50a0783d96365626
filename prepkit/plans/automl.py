"""Model training: preprocessing, candidates, calibration, baseline choice, cross-validated search, blending.

Model families are the ones Spark ML has: random forest, boosted trees (one-vs-rest for more than
two classes) and (logistic) regression. Splits, folds and draws come from hashes and seeds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool
from typing import Any

import numpy as np
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import (
    ElementwiseProduct,
    OneHotEncoder,
    SQLTransformer,
    StringIndexer,
    VectorAssembler,
    VectorSlicer,
)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import (
    GBTRegressor,
    IsotonicRegression,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepkit.functions.columns import is_numeric, local_rows, number, quoted, require
from prepkit.functions.sizing import ensure_checkpoint_dir, spread
from prepkit.operators import metrics as mt
from prepkit.operators.profile import infer_problem_type, label_codes
from prepkit.operators.splits import fold_assign, oversample_minority, stratified_split
from prepkit.plans.parzen import Estimator as Parzen
from prepkit.plans.parzen import Range, Trial, optimise


# --- preprocessing -------------------------------------------------------------------------


def build_preprocessor(df: DataFrame, features: Sequence[str], output: str = "features") -> Pipeline:
    """Numbers divided by their population std (not centred), other columns one-hot.

    The spare last slot of the encoder stands for unknown values, which so become all zeros. Vectors
    are sparse, so that columns of many values cost no more than others.
    """
    num = [c for c in features if is_numeric(df.schema[c].dataType)]
    cat = [c for c in features if c not in num]
    facts = df.agg(*[F.stddev_pop(number(df, c)).alias(f"s{i}") for i, c in enumerate(num)], F.count("*")).first()
    stages: list[Any] = []
    if cat:
        casts = ", ".join(f"COALESCE(CAST(`{c}` AS STRING), 'nan') AS `{c}__t`" for c in cat)
        stages.append(SQLTransformer(statement=f"SELECT *, {casts} FROM __THIS__"))
    parts = []
    if num:
        scale = [1.0 / facts[f"s{i}"] if facts[f"s{i}"] else 1.0 for i in range(len(num))]
        stages += [VectorAssembler(inputCols=num, outputCol="_num", handleInvalid="error"),
                   ElementwiseProduct(scalingVec=Vectors.dense(scale), inputCol="_num", outputCol="_scaled")]
        parts.append("_scaled")
    if cat:
        stages += [StringIndexer(inputCols=[f"{c}__t" for c in cat], outputCols=[f"{c}__i" for c in cat],
                                 handleInvalid="keep", stringOrderType="alphabetAsc"),
                   OneHotEncoder(inputCols=[f"{c}__i" for c in cat], outputCols=[f"{c}__o" for c in cat], dropLast=True)]
        parts += [f"{c}__o" for c in cat]
    stages.append(VectorAssembler(inputCols=parts, outputCol=output))
    return Pipeline(stages=stages)


def feature_names(pre: PipelineModel, num: Sequence[str]) -> list[str]:
    names = list(num)
    for stage in pre.stages:
        if hasattr(stage, "labelsArray"):
            for col, labels in zip(stage.getInputCols(), stage.labelsArray):
                names += [f"{col.removesuffix('__t')}_{v}" for v in labels]
    return names


# --- candidates ----------------------------------------------------------------------------


def candidates(classes: int, seed: int = 42, trees: int = 300, weight: str | None = None) -> dict[str, Estimator]:
    """Estimators by family; ``classes`` is 0 for regression."""
    if classes == 0:
        return {
            "RandomForest": RandomForestRegressor(numTrees=trees, seed=seed),
            "BoostedTrees": GBTRegressor(maxIter=trees, stepSize=0.05, maxDepth=6, subsamplingRate=0.9, seed=seed),
            "Linear": LinearRegression(),
        }
    forest = RandomForestClassifier(numTrees=trees, seed=seed)
    if weight and classes == 2:
        forest = forest.setWeightCol(weight)
    boosted = GBTClassifier(maxIter=trees, stepSize=0.05, maxDepth=6, subsamplingRate=0.9, seed=seed)
    return {
        "RandomForest": forest,
        "BoostedTrees": boosted if classes == 2 else OneVsRest(classifier=boosted),
        "Linear": LogisticRegression(maxIter=50),
    }


def draw_candidates(classes: int, rng: np.random.RandomState, rounds: tuple[int, int] = (300, 900)) -> dict[str, Estimator]:
    """One random draw of each family over the search ranges."""
    def log(lo: float, hi: float) -> float:
        return float(math.exp(rng.uniform(math.log(lo), math.log(hi))))

    n, depth = [int(rng.randint(rounds[0], rounds[1] + 1)) for _ in range(2)], [int(rng.randint(3, 11)) for _ in range(2)]
    rate, sub, col = log(0.01, 0.3), [float(rng.uniform(0.6, 1.0)) for _ in range(2)], f"{rng.uniform(0.6, 1.0):.3f}"
    l2 = log(1e-3, 10.0)
    if classes == 0:
        return {
            "RandomForest": RandomForestRegressor(numTrees=n[0], maxDepth=depth[0], subsamplingRate=sub[0], featureSubsetStrategy=col, seed=42),
            "BoostedTrees": GBTRegressor(maxIter=n[1], maxDepth=depth[1], stepSize=rate, subsamplingRate=sub[1], featureSubsetStrategy=col, seed=42),
            "Linear": LinearRegression(regParam=l2 / 10),
        }
    boosted = GBTClassifier(maxIter=n[1], maxDepth=depth[1], stepSize=rate, subsamplingRate=sub[1], featureSubsetStrategy=col, seed=42)
    return {
        "RandomForest": RandomForestClassifier(numTrees=n[0], maxDepth=depth[0], subsamplingRate=sub[0], featureSubsetStrategy=col, seed=42),
        "BoostedTrees": boosted if classes == 2 else OneVsRest(classifier=boosted),
        "Linear": LogisticRegression(regParam=l2 / 10, maxIter=50),
    }


def probabilities(scored: DataFrame, out: str = "proba") -> DataFrame:
    """Class probabilities as ARRAY<DOUBLE>; one-vs-rest margins go through a sigmoid and are normalised."""
    if "probability" in scored.columns:
        return scored.withColumn(out, vector_to_array("probability"))
    odds = F.transform(vector_to_array("rawPrediction"), lambda m: F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * m)))
    return (scored.withColumn("_odds", odds)
            .withColumn(out, F.transform("_odds", lambda p: p / F.aggregate("_odds", F.lit(1e-12), lambda a, x: a + x)))
            .drop("_odds"))


# --- calibration ---------------------------------------------------------------------------


CALIBRATION_FOLDS = 3


def calibrate(estimator: Estimator, train: DataFrame, key: Sequence[str], classes: int, seed: int = 42,
              folds: int = CALIBRATION_FOLDS) -> list[Transformer]:
    """Stages that turn the model's scores into calibrated ones, fitted on out-of-fold scores.

    Two classes: isotonic on P(1), giving column ``calibrated``. More: a logistic (sigmoid) model on
    the score vector, giving ``calibrated_vector``.
    """
    split = fold_assign(train, key, "label", folds, seed, "_cal").persist()
    try:
        held = None
        for f in range(folds):
            scored = estimator.fit(split.filter(F.col("_cal") != f)).transform(split.filter(F.col("_cal") == f))
            source = "probability" if "probability" in scored.columns else "rawPrediction"
            part = scored.select("label", F.col(source).alias("_score"))
            held = part if held is None else held.unionByName(part)
        if classes == 2:
            slicer = VectorSlicer(inputCol=source, outputCol="_p1", indices=[1])
            iso = IsotonicRegression(featuresCol="_p1", labelCol="label", predictionCol="calibrated")
            pick = VectorSlicer(inputCol="_score", outputCol="_p1", indices=[1])
            return [slicer, iso.fit(pick.transform(held))]
        fitted = LogisticRegression(featuresCol="_score", labelCol="label", predictionCol="calibrated_prediction",
                                    probabilityCol="calibrated_vector", rawPredictionCol="calibrated_raw").fit(held)
        return [fitted.copy().setFeaturesCol(source)]
    finally:
        split.unpersist()


# --- baseline ------------------------------------------------------------------------------


@dataclass
class AutoMLResult:
    problem_type: str
    best_model_name: str
    metrics: dict[str, float]
    feature_names: list[str]
    model: PipelineModel
    predictions: DataFrame
    best_threshold: float | None
    labels: list[str] | None
    scores: dict[str, dict[str, float]] = field(default_factory=dict)


def _labelled(df: DataFrame, target: str, is_cls: bool) -> tuple[DataFrame, list[str] | None]:
    if not is_cls:
        return df.filter(quoted(target).isNotNull()).withColumn("label", quoted(target).cast("double")), None
    text = df.withColumn("_text", F.coalesce(quoted(target).cast("string"), F.lit("nan")))
    names = [r["label"] for r in label_codes(text, "_text").orderBy("code").collect()]  # at most 50 classes
    code = F.array_position(F.array(*map(F.lit, names)), F.col("_text")) - 1
    return text.withColumn("label", code.cast("double")).drop("_text"), names


def train_baseline(df: DataFrame, target: str, key: Sequence[str], seed: int = 42, test_size: float = 0.2,
                   calibrated: bool = True, optimize_threshold_by: str = "f1", trees: int = 300,
                   families: Sequence[str] | None = None) -> AutoMLResult:
    """Fit every candidate on a hash split, score on the rest, keep the best by f1 / weighted f1 / R2."""
    require(df, target, *key)
    features = [c for c in df.columns if c != target and c not in key]
    problem = infer_problem_type(df, target, "baseline")
    is_cls = problem == "classification"
    data, labels = _labelled(df, target, is_cls)
    classes = len(labels) if labels else 0
    parted = spread(stratified_split(data, key, "label" if is_cls else None, test_size, seed), data.count(), *key).persist()
    seen = parted.filter("NOT is_test")
    pre = build_preprocessor(seen, features).fit(seen)  # statistics and categories of the training rows alone
    split = pre.transform(parted).select(*key, "label", "features", "is_test")
    if classes == 2:
        share = {r["label"]: r["n"] for r in data.groupBy("label").agg(F.count("*").alias("n")).collect()}
        total = sum(share.values())
        split = split.withColumn("weight", F.when(F.col("label") == 1, total / (2.0 * share[1.0])).otherwise(total / (2.0 * share[0.0])))
    split = split.persist()
    train, test = split.filter("NOT is_test"), split.filter("is_test")
    best: dict[str, Any] = {"score": -math.inf}
    every: dict[str, dict[str, float]] = {}
    try:
        skipped = None
        if is_cls and calibrated and train.groupBy("label").count().agg(F.min("count")).first()[0] < CALIBRATION_FOLDS:
            skipped = "a class has fewer rows than folds"  # the plain scores are used
        for name, est in candidates(classes, seed, trees, "weight").items():
            if families and name not in families:
                continue
            stages: list[Transformer] = [est.fit(train)]
            if is_cls and calibrated and not skipped:
                stages += calibrate(est, train, key, classes, seed)
            model = PipelineModel([*pre.stages, *stages])
            out, threshold = PipelineModel(stages).transform(test), None
            if not is_cls:
                out = out.withColumn("y_pred", F.col("prediction"))
                found = mt.regression_metrics(out, "label", "y_pred").first().asDict()
                score = found["r2"]
            else:
                out = probabilities(out)
                if "calibrated" in out.columns:
                    out = out.withColumn("proba", F.array(1 - F.col("calibrated"), F.col("calibrated")))
                elif "calibrated_vector" in out.columns:
                    out = out.withColumn("proba", vector_to_array("calibrated_vector"))
                if classes == 2:
                    out = out.withColumn("p1", F.col("proba")[1])
                    threshold = mt.best_threshold(out, "label", "p1", optimize_threshold_by).first()["threshold"]
                    out = out.withColumn("y_pred", (F.col("p1") >= threshold).cast("double"))
                    found = mt.binary_metrics(out, "label", "p1", pred="y_pred").first().asDict()
                    score = found["f1"]
                else:
                    out = out.withColumn("y_pred", (F.array_position("proba", F.array_max("proba")) - 1).cast("double"))
                    found = mt.multiclass_metrics(out, "label", "proba", "y_pred").first().asDict()
                    score = found["f1_weighted"]
            every[name] = {**found, **({"calibration_skipped": skipped} if skipped else {})}
            if score is not None and score > best["score"]:
                best = {"score": score, "name": name, "model": model, "metrics": found, "threshold": threshold, "out": out}
    finally:
        split.unpersist()
        parted.unpersist()
    cols = [*key, "label", "y_pred", *(["proba"] if is_cls else [])]
    shown = best["out"].select(*cols)
    if labels:
        names = F.array(*map(F.lit, labels))
        shown = shown.withColumns({"label": names[F.col("label").cast("int")], "y_pred": names[F.col("y_pred").cast("int")]})
    num = [c for c in features if is_numeric(df.schema[c].dataType)]
    return AutoMLResult(problem, best["name"], best["metrics"], feature_names(pre, num), best["model"], shown,
                        best["threshold"], labels, every)


# --- search and blend ----------------------------------------------------------------------


def search(data: DataFrame, key: str, classes: int, trials: int = 30, seed: int = 42, folds: int = 5,
           rounds: tuple[int, int] = (300, 900), parallelism: int = 8, oversample: bool = True,
           raw: Sequence[str] | None = None) -> DataFrame:
    """(trial, family, score, error): mean cross-validated weighted f1 / R2 of each draw.

    ``data`` has (key, label, features), or with ``raw`` the raw feature columns: then the preprocessor is
    fitted on each fold's training rows alone. Folds and their oversampled training sets do not depend on
    the draw, so they are made once and kept; the fits of all folds then run side by side. Spark hands a fit's many
    small jobs out one by one: eight fits at once keep it busy, more gain nothing (README).
    """
    spark = data.sparkSession
    ensure_checkpoint_dir(spark)  # boosted trees cut their lineage there every ten rounds
    is_cls = classes > 0
    n = data.count()
    folded = spread(fold_assign(data, [key], "label" if is_cls else None, folds, seed), n, key).persist()
    rng = np.random.RandomState(seed)
    drawn = [(t, name, est) for t in range(trials) for name, est in draw_candidates(classes, rng, rounds).items()]
    judge = MulticlassClassificationEvaluator(metricName="f1") if is_cls else RegressionEvaluator(metricName="r2")
    found: dict[tuple[int, str], list[float]] = {}
    errors: dict[tuple[int, str], str] = {}
    parts: list[tuple[DataFrame, DataFrame]] = []
    try:
        for f in range(folds):
            train, held = folded.filter(F.col("fold") != f), folded.filter(F.col("fold") == f)
            if raw is not None:
                pre = build_preprocessor(train, raw).fit(train)
                train, held = pre.transform(train), pre.transform(held)
            train = train.select(key, "label", "features")
            if is_cls and oversample:
                train = spread(with_oversampling(train, key), 2 * n)
            parts.append((train.persist(), held))

        def run(job: tuple[int, str, Estimator, int]) -> tuple[int, str, float | None, str | None]:
            trial, name, est, f = job
            train, held = parts[f]
            try:
                return trial, name, judge.evaluate(est.fit(train).transform(held)), None
            except Exception as e:  # a failed draw is reported and skipped
                return trial, name, None, str(e)

        jobs = [(*d, f) for d in sorted(drawn, key=lambda d: d[1] != "BoostedTrees") for f in range(folds)]  # the longest begin first
        with ThreadPool(parallelism) as pool:
            for trial, name, score, err in pool.map(run, jobs, chunksize=1):
                if score is None:
                    errors[trial, name] = err or ""
                else:
                    found.setdefault((trial, name), []).append(score)
    finally:
        for train, _ in parts:
            train.unpersist()
        folded.unpersist()
    rows = [(t, n, float(np.mean(found[t, n])) if (t, n) in found and (t, n) not in errors else None, errors.get((t, n)))
            for t, n, _ in drawn]
    return local_rows(spark, rows, "trial int, family string, score double, error string")


def search_ranges(classes: int, rounds: tuple[int, int] = (300, 900)) -> dict[str, dict[str, Range]]:
    """The parameters of each family and their ranges (fixed values, those of ``draw_candidates``)."""
    trees = {"n": Range(*rounds, "int"), "depth": Range(3, 10, "int"), "sub": Range(0.6, 1.0), "col": Range(0.6, 1.0)}
    return {"RandomForest": trees, "BoostedTrees": {**trees, "rate": Range(0.01, 0.3, "log")}, "Linear": {"l2": Range(1e-3, 10.0, "log")}}


def built(family: str, classes: int, p: dict[str, float | int]) -> Estimator:
    """The estimator of a family with these parameters."""
    if family == "Linear":
        return LogisticRegression(regParam=p["l2"] / 10, maxIter=50) if classes else LinearRegression(regParam=p["l2"] / 10)
    shared = dict(maxDepth=p["depth"], subsamplingRate=p["sub"], featureSubsetStrategy=f"{p['col']:.3f}", seed=42)
    if family == "RandomForest":
        return (RandomForestClassifier if classes else RandomForestRegressor)(numTrees=p["n"], **shared)
    boosted = (GBTClassifier if classes else GBTRegressor)(maxIter=p["n"], stepSize=p["rate"], **shared)
    return OneVsRest(classifier=boosted) if classes > 2 else boosted


def learned_search(data: DataFrame, key: str, classes: int, trials: int = 30, seed: int = 42, folds: int = 5,
                   rounds: tuple[int, int] = (300, 900), oversample: bool = True, raw: Sequence[str] | None = None,
                   families: Sequence[str] | None = None, startup: int = 8) -> DataFrame:
    """(trial, family, score, error, state, folds, running, params) of draws that learn from those before (``parzen``).

    Each family is searched by itself, the families side by side; a draw's folds are fitted one after the other, so
    that bad draws stop early (state ``stopped``, ``running`` is their mean so far, no score). The first ``startup``
    draws of a family are random. Other arguments are those of ``search``; the training sets of all folds are made once and kept on the executors' disks.
    """
    is_cls = classes > 0
    data = data.persist(StorageLevel.DISK_ONLY)  # ranks read it several times; what it is joined from is so gathered once
    n = data.count()
    folded = spread(fold_assign(data, [key], "label" if is_cls else None, folds, seed), n, key).persist(StorageLevel.DISK_ONLY)
    judge = MulticlassClassificationEvaluator(metricName="f1") if is_cls else RegressionEvaluator(metricName="r2")
    parts: list[tuple[DataFrame, DataFrame]] = []
    try:
        for f in range(folds):
            train, held = folded.filter(F.col("fold") != f), folded.filter(F.col("fold") == f)
            if raw is not None:
                pre = build_preprocessor(train, raw).fit(train)
                train, held = pre.transform(train), pre.transform(held)
            train = train.select(key, "label", "features")
            if is_cls and oversample:
                train = spread(with_oversampling(train, key), 2 * n)
            parts.append((train.persist(StorageLevel.DISK_ONLY), held))

        def run(family: str) -> list[Trial]:
            def score(values: dict[str, float | int], fold: int) -> float:
                train, held = parts[fold]
                return judge.evaluate(built(family, classes, values).fit(train).transform(held))

            return optimise(Parzen(ranges[family], seed, startup), score, trials, folds)

        ranges = {n: r for n, r in search_ranges(classes, rounds).items() if not families or n in families}
        with ThreadPool(max(1, len(ranges))) as pool:
            found = dict(zip(ranges, pool.map(run, ranges), strict=True))
    finally:
        for train, _ in parts:
            train.unpersist()
        folded.unpersist()
        data.unpersist()
    rows = [(t.trial, n, t.score, t.error, t.state, t.folds, t.running, {k: float(v) for k, v in t.values.items()})
            for n, tried in found.items() for t in tried]
    return local_rows(data.sparkSession, rows, "trial int, family string, score double, error string, state string, folds int, "
                                               "running double, params map<string,double>")


def with_oversampling(train: DataFrame, key: str) -> DataFrame:
    """(key, label, features) with synthetic minority rows; vectors in, vectors out."""
    arrays = train.withColumn("features", vector_to_array("features"))
    return oversample_minority(arrays, key, "label", "features").withColumn("features", array_to_vector("features"))


def leaderboard(trials: DataFrame, family: str = "family", score: str = "score") -> DataFrame:
    """Mean score per family over its successful trials, best first."""
    return (trials.filter(F.col(score).isNotNull()).groupBy(family)
            .agg(F.avg(score).alias("mean_score"), F.count("*").alias("trials")).orderBy(F.desc("mean_score"), family))


def blend_weights(board: DataFrame, top_k: int = 3, family: str = "family", score: str = "mean_score") -> DataFrame:
    """mean / (sum of means + 1e-9) over the best families."""
    best = board.orderBy(F.desc(score), family).limit(top_k)
    total = best.agg(F.sum(score) + 1e-9).scalar()
    return best.select(family, score, (F.col(score) / total).alias("weight"))


def member_weights(top: Sequence[tuple[str, float]]) -> dict[str, float]:
    """score / (sum of scores + 1e-9) of the families that beat the mean (score above 0); if none does, the best one alone.

    ``top`` is best first. R2 falls below 0 where the target can't be told from the features.
    """
    useful = [(n, m) for n, m in top if m > 0]
    if not useful:
        return {top[0][0]: 1.0}
    total = sum(m for _, m in useful) + 1e-9
    return {n: m / total for n, m in useful}


def soft_vote(scored: DataFrame, key: Sequence[str], member: str, proba: str, weights: DataFrame) -> DataFrame:
    """Weighted mean of member probabilities per row and the winning class (lowest index on ties).

    ``scored`` is long: one row per (key, member) with an ARRAY of class probabilities. Weighted
    sums merge in map tasks; the number of members per row is small by nature.
    """
    weighted = scored.join(weights.select(F.col("family").alias(member), "weight"), member)
    cells = weighted.select(*key, "weight", F.posexplode(proba).alias("class", "p"))
    mixed = cells.groupBy(*key, "class").agg((F.sum(F.col("weight") * F.col("p")) / F.sum("weight")).alias("p"))
    best = mixed.groupBy(*key).agg(F.max(F.struct("p", (-F.col("class")).alias("c"))).alias("_b"))
    return best.select(*key, F.col("_b.p").alias("p"), (-F.col("_b.c")).alias("prediction"))


def weighted_mean(columns: dict[str, Column], weights: dict[str, float]) -> Column:
    total = sum(weights.values())
    out = F.lit(0.0)
    for name, w in weights.items():
        out = out + columns[name] * F.lit(w / total)
    return out


def _scaled(array: str, factor: float) -> Column:
    return F.transform(array, lambda x: x * F.lit(factor))


@dataclass
class FusionResult:
    problem_type: str
    metric_name: str
    best_score: float
    leaderboard: list[tuple[str, float]]
    blend_weights: dict[str, float]
    model: PipelineModel
    features: list[str]
    labels: list[str] | None

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` (and ``proba`` for classes): members are chained, so nothing is joined."""
        out = self.model.transform(df)
        members = {n: n.lower() for n in self.blend_weights}
        if self.labels is None:
            return out.withColumn("prediction", weighted_mean({n: F.col(f"{p}_prediction") for n, p in members.items()}, self.blend_weights))
        total = sum(self.blend_weights.values())
        mixed = None
        for n, p in members.items():
            raw = f"{p}_rawPrediction"
            renamed = out.select("*", *([F.col(f"{p}_probability").alias("probability")] if f"{p}_probability" in out.columns
                                        else [F.col(raw).alias("rawPrediction")]))
            out = probabilities(renamed, f"{p}_proba").drop("probability", "rawPrediction")
            share = _scaled(f"{p}_proba", self.blend_weights[n] / total)
            mixed = share if mixed is None else F.zip_with(mixed, share, lambda a, b: a + b)
        out = out.withColumn("proba", mixed)
        names = F.array(*map(F.lit, self.labels))
        return out.withColumn("prediction", names[(F.array_position("proba", F.array_max("proba")) - 1).cast("int")])


def _named_outputs(model: Model, prefix: str) -> Model:
    for setter in ("Prediction", "RawPrediction", "Probability"):
        if model.hasParam(setter[0].lower() + setter[1:] + "Col"):
            model.set(model.getParam(setter[0].lower() + setter[1:] + "Col"), f"{prefix}_{setter[0].lower() + setter[1:]}")
    return model


def train_fusion(df: DataFrame, target: str, key: str, seed: int = 42, trials: int = 30, folds: int = 5,
                 rounds: tuple[int, int] = (300, 900), final_trees: int = 600, parallelism: int = 8,
                 learned: bool = False) -> FusionResult:
    """Search, leaderboard, blend of the best three families refitted on all rows.

    With ``learned`` the draws of the search learn from those before (``learned_search``); without, they are random.
    """
    require(df, target, key)
    features = [c for c in df.columns if c not in (target, key)]
    is_cls = infer_problem_type(df, target, "fusion") == "classification"
    data, labels = _labelled(df, target, is_cls)
    classes = len(labels) if labels else 0
    pre = build_preprocessor(df, features).fit(df)  # for the members, which learn from all rows
    n = data.count()
    ready = spread(pre.transform(data).select(key, "label", "features"), n, key).persist()
    try:
        rows = data.select(key, "label", *features)
        tried = (learned_search(rows, key, classes, trials, seed, folds, rounds, raw=features) if learned
                 else search(rows, key, classes, trials, seed, folds, rounds, parallelism, raw=features))
        board = [(r["family"], r["mean_score"]) for r in leaderboard(tried).collect()]
        if not board:
            raise RuntimeError("no candidate could be evaluated")
        top = board[:3]
        weights = member_weights(top)
        full = spread(with_oversampling(ready, key), 2 * n).persist() if is_cls else ready
        pool = candidates(classes, seed, final_trees)
        members = [_named_outputs(pool[n].fit(full), n.lower()) for n in weights]
        if full is not ready:
            full.unpersist()
    finally:
        ready.unpersist()
    return FusionResult("classification" if is_cls else "regression", "f1" if is_cls else "r2", top[0][1], board,
                        weights, PipelineModel([*pre.stages, *members]), features, labels)
