"""Exact interventional Shapley values of tree models, against every background row.

For a leaf, a row x and a background row z, a feature is one of four: both pass all its conditions on the leaf's path
(it plays no part), only x does (it opens the leaf), only z does (it closes it), or neither (no mixture of the two
reaches the leaf). With u features that open and v that close, each opener's share of the leaf's value is
(u-1)! v! / (u+v)! and each closer's is -u! (v-1)! / (u+v)!. Counts for all pairs of rows are matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import factorial
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from prepkit.functions.columns import quoted
from prepkit.functions.sizing import spread
from prepkit.operators.profile import sample_rows
from prepkit.plans.attribution import pick_member

#: Pairs of rows whose counts are held at a time (some 30 bytes each).
PAIRS = 1 << 20


class Forest(NamedTuple):
    """Trees as paths: of each leaf its value and conditions (node, whether the path goes left there)."""

    slot: np.ndarray  # of each inner node: the slot it looks at
    cut: np.ndarray  # up to which it goes left; NaN where categories decide
    categories: dict[int, np.ndarray]  # of such nodes: what goes left
    leaves: list[tuple[float, list[tuple[int, bool]]]]

    def goes_left(self, x: np.ndarray) -> np.ndarray:
        left = x[:, self.slot] <= self.cut
        for node, values in self.categories.items():
            left[:, node] = np.isin(x[:, self.slot[node]], values)
        return left

    def predict(self, x: np.ndarray) -> np.ndarray:
        left, out = self.goes_left(x), np.zeros(len(x))
        for value, path in self.leaves:
            out += value * np.all([left[:, n] == side for n, side in path], axis=0) if path else value
        return out


def forest_of(head: Any, class_index: int = 1) -> Forest:
    """The fitted tree model as paths. Values: the prediction; of class probabilities that of ``class_index``;
    of boosted classes the margin, in which the trees add up."""
    trees, weights = (head.trees, head.treeWeights) if hasattr(head, "trees") else ([head], [1.0])
    share = "Classif" in type(head).__name__ and "GBT" not in type(head).__name__
    whole = sum(weights) if "RandomForest" in type(head).__name__ else 1.0
    slot, cut, categories, leaves = [], [], {}, []
    for tree, weight in zip(trees, weights, strict=True):
        open_nodes = [(tree._java_obj.rootNode(), [])]
        while open_nodes:
            node, path = open_nodes.pop()
            if node.getClass().getSimpleName() == "LeafNode":
                counts = list(node.impurityStats().stats()) if share else []
                value = counts[class_index] / sum(counts) if share else node.prediction()
                leaves.append((value * weight / whole, path))
                continue
            split, n = node.split(), len(slot)
            slot.append(split.featureIndex())
            by_category = split.getClass().getSimpleName() == "CategoricalSplit"
            cut.append(np.nan if by_category else split.threshold())
            if by_category:
                categories[n] = np.array(list(split.leftCategories()))
            open_nodes += [(node.leftChild(), [*path, (n, True)]), (node.rightChild(), [*path, (n, False)])]
    return Forest(np.array(slot, int), np.array(cut, float), categories, leaves)


def _shares(most: int) -> tuple[np.ndarray, np.ndarray]:
    opens, closes = np.zeros((most + 1, most + 1)), np.zeros((most + 1, most + 1))
    for u in range(most + 1):
        for v in range(most + 1 - u):
            if u:
                opens[u, v] = factorial(u - 1) * factorial(v) / factorial(u + v)
            if v:
                closes[u, v] = factorial(u) * factorial(v - 1) / factorial(u + v)
    return opens, closes


def forest_shapley(forest: Forest, player: np.ndarray, x: np.ndarray, z: np.ndarray, players: int) -> np.ndarray:
    """Contributions (row of x, player) to forest(x) minus the mean of forest(z); ``player``: of each slot."""
    out = np.zeros((len(x), players))
    opens, closes = _shares(max((len({player[forest.slot[n]] for n, _ in path}) for _, path in forest.leaves), default=0))
    z_left = forest.goes_left(z)
    step = max(1, PAIRS // max(1, len(z)))
    for start in range(0, len(x), step):
        x_left = forest.goes_left(x[start : start + step])
        for value, path in forest.leaves:
            of = [player[forest.slot[n]] for n, _ in path]
            who = sorted(set(of))
            if not who or value == 0:
                continue
            passes = lambda left: np.column_stack([
                np.all([left[:, n] == side for (n, side), p in zip(path, of, strict=True) if p == w], axis=0) for w in who]).astype(float)  # noqa: B023
            px, pz = passes(x_left), passes(z_left)
            u, v = (px @ (1 - pz).T).astype(int), ((1 - px) @ pz.T).astype(int)
            alive = ((1 - px) @ (1 - pz).T) == 0
            gain = px * ((alive * opens[u * alive, v * alive]) @ (1 - pz)) - (1 - px) * ((alive * closes[u * alive, v * alive]) @ pz)
            out[start : start + step, who] += value * gain / len(z)
    return out


def slot_features(model: PipelineModel) -> list[str]:
    """Of each slot of the assembled vector the column it comes from; the slots of a column are one player."""
    assemblers = [s for s in model.stages if isinstance(s, VectorAssembler)]
    labels = {c.removesuffix("__t"): len(v) for s in model.stages if hasattr(s, "labelsArray") for c, v in zip(s.getInputCols(), s.labelsArray, strict=True)}
    names: list[str] = []
    for part in assemblers[-1].getInputCols():
        if part == "_scaled":
            names += assemblers[0].getInputCols()
        elif part.endswith("__o") and part.removesuffix("__o") in labels:
            names += [part.removesuffix("__o")] * labels[part.removesuffix("__o")]
        else:
            names.append(part)
    return names


def tree_shapley_values(model: PipelineModel, df: DataFrame, features: Sequence[str], key: str, max_samples: int | None = None,
                        max_background: int = 200, seed: int = 42, class_index: int = 1) -> DataFrame:
    """(key, feature, contribution, base_value), exact; the contributions of a row add up to its value minus the base.

    Explains all rows of df, or the first ``max_samples`` in hash order, spread over tasks by their number. The background (at most
    ``max_background`` rows, those that ``shapley_values`` takes) and the trees go to the tasks. Columns that no
    tree looks at contribute 0. Rows that repeat are explained each; an empty table has no rows.
    """
    member = pick_member(model)
    head = next(s for s in reversed(member.stages) if s.hasParam("predictionCol"))
    before = PipelineModel([s for s in member.stages if s is not head])
    forest, owners = forest_of(head, class_index), slot_features(member)
    player = np.array([list(features).index(o) for o in owners])
    inputs = lambda rows: before.transform(rows).select(quoted(key).alias("k"), vector_to_array(head.getOrDefault("featuresCol")).alias("x"))

    def matrix(column: pa.Array) -> np.ndarray:
        return np.asarray(column.flatten()).reshape(-1, len(player))

    background = matrix(inputs(sample_rows(df, max_background, seed, [key])).select("x").toArrow()["x"].combine_chunks())
    base = float(forest.predict(background).mean()) if len(background) else 0.0
    names = list(features)

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = forest_shapley(forest, player, matrix(batch.column("x")), background, len(names))
            rows = np.repeat(np.arange(batch.num_rows), len(names))
            yield pa.RecordBatch.from_arrays([
                batch.column("k").take(pa.array(rows)), pa.array(names * batch.num_rows, pa.string()),
                pa.array(got.ravel()), pa.array(np.full(got.size, base))], names=[key, "feature", "contribution", "base_value"])

    rows = df if max_samples is None else sample_rows(df, max_samples, seed, [key])
    rows = spread(rows, rows.count(), key)  # however few files or row groups they come from
    schema = StructType([StructField(key, df.schema[key].dataType), StructField("feature", StringType()),
                         StructField("contribution", DoubleType()), StructField("base_value", DoubleType())])
    return inputs(rows).mapInArrow(explain, schema)
