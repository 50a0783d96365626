"""Second-order boosting over histograms: softmax over all classes at once, logistic or squared loss.

Columns are cut into bins by quantile sketches, a missing value has a bin of its own, and the binned rows are written
once. A level of a round's trees (one tree a class) is one pass: tasks fold sums of gradients and Hessians by
node, column and bin, and tasks gather them. Of two siblings the one with fewer rows is folded, the other one is its
parent less that. A split sends missing values to the side that gains more. Rows keep their margins; every few
rounds the table is written anew with them, so that a pass has only the trees since to go through.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from prepkit.functions.columns import number, quoted
from prepkit.functions.folds import columns_of
from prepkit.functions.sizing import ensure_checkpoint_dir
from prepkit.functions.sketch import sketches

#: Cells of a pass's histograms at most (three numbers each); more nodes take more passes.
CELLS = 1 << 21
#: Tasks that gather the tasks' histograms before one does.
GATHERED = 16
BINNED = "bins binary, label double, margins array<double>"


@dataclass(frozen=True)
class BoostConfig:
    rounds: int = 20
    depth: int = 4
    rate: float = 0.3
    ridge: float = 1.0
    least_gain: float = 0.0
    least_hessian: float = 1.0
    bins: int = 64
    refresh: int = 8

    def __post_init__(self) -> None:
        if not 2 <= self.bins <= 254:
            raise ValueError("bins must lie in 2..254")


class Tree(NamedTuple):
    """Nodes as arrays; a leaf has column -1. A row goes left at bins up to ``cut``, a missing value as ``missing_left`` says."""

    column: np.ndarray
    cut: np.ndarray
    missing_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node that each binned row ends in."""
        at = np.zeros(len(bins), np.int64)
        while True:
            inner = np.flatnonzero(self.column[at] >= 0)
            if not len(inner):
                return at
            node = at[inner]
            b = bins[inner, self.column[node]]
            goes_left = np.where(b == 0, self.missing_left[node], b <= self.cut[node])
            at[inner] = np.where(goes_left, self.left[node], self.right[node])


class BoostModel(NamedTuple):
    columns: list[str]
    cuts: list[list[float]]  # of each column: right ends of its bins but the last
    task: str  # "regression", "binary" or "classes"
    classes: int
    base: list[float]
    rounds: list[list[Tree]]

    def binned(self, values: Sequence[np.ndarray]) -> np.ndarray:
        """Bins of each column's values: 0 is missing, then 1 to the number of cuts and one."""
        out = np.empty((len(values[0]), len(values)), np.uint8)
        for i, (v, cuts) in enumerate(zip(values, self.cuts, strict=True)):
            out[:, i] = np.where(np.isnan(v), 0, np.searchsorted(cuts, v, "left") + 1)
        return out

    def margins(self, bins: np.ndarray, start: np.ndarray | None = None, first: int = 0) -> np.ndarray:
        out = np.tile(np.array(self.base), (len(bins), 1)) if start is None else start.copy()
        for trees in self.rounds[first:]:
            for k, tree in enumerate(trees):
                out[:, k] += tree.value[tree.nodes(bins)]
        return out

    def probabilities(self, margins: np.ndarray) -> np.ndarray:
        """Probabilities of the classes; the margins themselves for a regression."""
        if self.task == "regression":
            return margins
        if self.task == "binary":
            p = 1 / (1 + np.exp(-np.clip(margins[:, 0], -500, 500)))
            return np.column_stack([1 - p, p])
        e = np.exp(margins - margins.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def slopes(self, margins: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and second derivatives of the loss by each margin."""
        if self.task == "regression":
            return margins - label[:, None], np.ones_like(margins)
        p = self.probabilities(margins)
        if self.task == "binary":
            p = p[:, 1:]
            return p - label[:, None], p * (1 - p)
        return p - (label[:, None] == np.arange(self.classes)), p * (1 - p)

    def split_text(self, tree: Tree, node: int) -> str:
        """``column <= value`` of a node."""
        c = int(tree.column[node])
        return f"{self.columns[c]} <= {self.cuts[c][int(tree.cut[node]) - 1]!r}"


class Split(NamedTuple):
    gain: float
    column: int
    cut: int
    missing_left: bool


def best_split(sums: np.ndarray, cfg: BoostConfig) -> Split | None:
    """The best split of a node from its (columns, bins, [gradient, Hessian, rows]) sums; ties to the first column, cut, and left."""
    total = sums[0].sum(axis=0)

    def score(g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return g * g / (h + cfg.ridge)

    best = None
    for c, own in enumerate(sums):
        missing, seen = own[0], np.cumsum(own[1:], axis=0)[:-1]
        for left_too in (True, False):
            if not left_too and missing[2] == 0:
                continue
            left = seen + missing if left_too else seen
            right = total - left
            fit = (left[:, 1] >= cfg.least_hessian) & (right[:, 1] >= cfg.least_hessian) & (left[:, 2] > 0) & (right[:, 2] > 0)
            if not fit.any():
                continue
            gain = np.where(fit, 0.5 * (score(left[:, 0], left[:, 1]) + score(right[:, 0], right[:, 1]) - score(total[0], total[1])), -np.inf)
            k = int(gain.argmax())
            if gain[k] > cfg.least_gain and (best is None or gain[k] > best.gain * (1 + 1e-12)):
                best = Split(float(gain[k]), c, k + 1, left_too)
    return best


class _Growing:
    """A tree that grows level by level."""

    def __init__(self, cfg: BoostConfig) -> None:
        self.cfg = cfg
        self.rows: list[list] = [[-1, 0, True, -1, -1, 0.0, 0.0]]

    def tree(self) -> Tree:
        column, cut, missing_left, left, right, value, gain = zip(*self.rows, strict=True)
        return Tree(np.array(column), np.array(cut), np.array(missing_left), np.array(left), np.array(right), np.array(value), np.array(gain))

    def settle(self, node: int, sums: np.ndarray, may_split: bool) -> Split | None:
        """Give the node its value; and its split with two new nodes, if one gains."""
        g, h, _ = sums[0].sum(axis=0)
        self.rows[node][5] = -self.cfg.rate * float(g) / (float(h) + self.cfg.ridge)
        split = best_split(sums, self.cfg) if may_split else None
        if split:
            left = len(self.rows)
            self.rows[node][:5] = [split.column, split.cut, split.missing_left, left, left + 1]
            self.rows[node][6] = split.gain
            self.rows += [[-1, 0, True, -1, -1, 0.0, 0.0], [-1, 0, True, -1, -1, 0.0, 0.0]]
        return split


def _matrix(batch: pa.RecordBatch, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    column = batch.column("bins")
    start = np.frombuffer(column.buffers()[1], np.int32, 1, 4 * column.offset)[0]  # rows of one length lie one after the other
    bins = np.frombuffer(column.buffers()[2], np.uint8, batch.num_rows * columns, start).reshape(-1, columns)
    margins = np.asarray(batch.column("margins").flatten()).reshape(batch.num_rows, -1)
    return bins, batch.column("label").to_numpy(), margins


def _binaries(x: np.ndarray) -> pa.Array:
    """The rows of a byte matrix."""
    x = np.ascontiguousarray(x)
    ends = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])


def _lists(x: np.ndarray) -> pa.Array:
    """The rows of a matrix of doubles."""
    ends = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(x, float).ravel()))


def histograms(table: DataFrame, model: BoostModel, done: int, trees: Sequence[Tree], wanted: Sequence[tuple[int, int]], bins: int) -> dict[tuple[int, int], np.ndarray]:
    """{(class, node): (columns, bins, [gradient, Hessian, rows])} over the whole table; ``done`` rounds are in its margins."""
    columns = len(model.columns)
    shape = (columns, bins, 3)
    out: dict[tuple[int, int], np.ndarray] = {}
    chunk = max(1, CELLS // (columns * bins))
    for first in range(0, len(wanted), chunk):
        own = list(wanted[first : first + chunk])

        def fold(batches: Iterator[pa.RecordBatch], own: list[tuple[int, int]] = own) -> Iterator[pa.RecordBatch]:
            total = np.zeros((len(own), *shape))
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, label, margins = _matrix(batch, columns)
                g, h = model.slopes(model.margins(x, margins, done), label)
                at = {k: trees[k].nodes(x) for k in {k for k, _ in own}}
                for i, (k, node) in enumerate(own):
                    rows = np.flatnonzero(at[k] == node)
                    gradient, hessian = g[rows, k], h[rows, k]
                    for c in range(columns):
                        b = x[rows, c]
                        for j, weights in enumerate((gradient, hessian, None)):
                            total[i, c, :, j] += np.bincount(b, weights, bins)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        def gather(batches: Iterator[pa.RecordBatch], size: int = len(own)) -> Iterator[pa.RecordBatch]:
            total = np.zeros((size, *shape))
            for batch in batches:
                for sums in batch.column("sums").to_pylist():
                    total += np.frombuffer(sums).reshape(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

        sums = table.mapInArrow(fold, "sums binary").repartition(GATHERED).mapInArrow(gather, "sums binary").repartition(1).mapInArrow(gather, "sums binary")
        total = np.frombuffer(sums.first()["sums"]).reshape((len(own), *shape))
        out |= {key: total[i] for i, key in enumerate(own)}
    return out


def bin_cuts(df: DataFrame, columns: Sequence[str], bins: int) -> list[list[float]]:
    """Right ends of each column's bins but the last: every held value where there are few, else even quantiles."""
    found = sketches(df, list(columns))
    cuts = []
    for c in columns:
        values = np.unique(found[c].steps()[0]) if found[c].n else np.zeros(0)
        if len(values) > bins:
            values = np.unique(np.array([q for q in found[c].quantiles([i / bins for i in range(1, bins + 1)])], float))
        cuts.append(values[:-1].tolist())
    return cuts


def _binned(df: DataFrame, model: BoostModel, label: str) -> DataFrame:
    values = df.select(*[number(df, c).alias(f"c{i}") for i, c in enumerate(model.columns)], quoted(label).cast("double").alias("label"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, y = columns_of(batch)
            kept = ~np.isnan(y)
            x = model.binned(columns)[kept]
            base = np.tile(np.array(model.base), (len(x), 1))
            yield pa.RecordBatch.from_arrays([_binaries(x), pa.array(y[kept]), _lists(base)], names=["bins", "label", "margins"])

    return values.mapInArrow(work, BINNED)


def _stored(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/boost-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def _with_margins(table: DataFrame, model: BoostModel, done: int) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, _, margins = _matrix(batch, len(model.columns))
                now = model.margins(x, margins, done)
                yield pa.RecordBatch.from_arrays([batch.column("bins"), batch.column("label"), _lists(now)], names=["bins", "label", "margins"])

    return table.mapInArrow(work, BINNED)


def fit_boosting(df: DataFrame, columns: Sequence[str], label: str, task: str, cfg: BoostConfig = BoostConfig()) -> BoostModel:
    """Boosted trees of the numeric ``columns``; labels are numbers, 0 .. classes - 1 for "binary" and "classes".

    NULL and NaN are missing values, rows without a label are left out; an empty table is an error.
    """
    columns = list(columns)
    known = df.filter(quoted(label).isNotNull())
    if task == "regression":
        n, mean = known.agg(F.count(F.lit(1)), F.avg(quoted(label))).first()
        classes, base = 1, [float(mean or 0.0)]
    else:
        counts = {int(r[0]): r[1] for r in known.groupBy(quoted(label).cast("int")).count().collect()}
        n, classes = sum(counts.values()), max(counts, default=0) + 1
        if task == "binary":
            one = min(max(counts.get(1, 0) / max(1, n), 1e-6), 1 - 1e-6)
            base = [math.log(one / (1 - one))]
        else:
            base = [math.log(max(counts.get(k, 0), 1e-6) / max(1, n)) for k in range(classes)]
    if not n:
        raise ValueError("no labelled rows")
    model = BoostModel(columns, bin_cuts(known, columns, cfg.bins), task, classes, base, [])
    bins = 2 + max((len(c) for c in model.cuts), default=0)
    table, done = _stored(_binned(known, model, label)), 0
    for number_ in range(cfg.rounds):
        if number_ and number_ % cfg.refresh == 0:
            table, done = _stored(_with_margins(table, model, done)), number_
        growing = [_Growing(cfg) for _ in base]
        sums = histograms(table, model, done, [g.tree() for g in growing], [(k, 0) for k in range(len(base))], bins)
        for level in range(cfg.depth + 1):
            folded, taken = [], {}
            for (k, node), own in sorted(sums.items()):
                split = growing[k].settle(node, own, level < cfg.depth)
                if split:
                    left, right = growing[k].rows[node][3:5]
                    side = own[split.column, 1 : split.cut + 1, 2].sum() + (own[split.column, 0, 2] if split.missing_left else 0)
                    few, many = (left, right) if 2 * side <= own[0, :, 2].sum() else (right, left)
                    folded.append((k, few))
                    taken[k, many] = (own, (k, few))
            if not folded:
                break
            sums = histograms(table, model, done, [g.tree() for g in growing], folded, bins)
            sums |= {key: parent - sums[sibling] for key, (parent, sibling) in taken.items()}
        model = model._replace(rounds=[*model.rounds, [g.tree() for g in growing]])
    return model


def boost_predict(model: BoostModel, df: DataFrame, name: str = "probability", prediction: str = "prediction") -> DataFrame:
    """df with the probabilities of the classes and the likeliest class (a regression: with the prediction alone)."""
    kept = [f for f in df.schema.fields if f.name not in (name, prediction)]
    regression = model.task == "regression"
    extra = [StructField(prediction, DoubleType())] if regression else [StructField(name, ArrayType(DoubleType())), StructField(prediction, IntegerType())]
    inputs = [f"_boost_{i}" for i in range(len(model.columns))]
    own = df.select(*[quoted(f.name) for f in kept], *[number(df, c).alias(i) for c, i in zip(model.columns, inputs, strict=True)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [batch.column(len(kept) + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(inputs))]
            p = model.probabilities(model.margins(model.binned(values)))
            found = [pa.array(p[:, 0])] if regression else [_lists(p), pa.array(p.argmax(axis=1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), *found], names=[*(f.name for f in kept), *(e.name for e in extra)])

    return own.mapInArrow(work, StructType([*kept, *extra]))


def split_table(model: BoostModel, spark) -> DataFrame:
    """(round, class, node, column, cut, missing_left, gain, value) of all nodes; leaves have no column."""
    from prepkit.functions.columns import local_rows

    rows = []
    for i, trees in enumerate(model.rounds):
        for k, t in enumerate(trees):
            for node in range(len(t.column)):
                c = int(t.column[node])
                rows.append((i, k, node, *((model.columns[c], float(model.cuts[c][int(t.cut[node]) - 1]), bool(t.missing_left[node]), float(t.gain[node])) if c >= 0 else (None,) * 4), float(t.value[node])))
    return local_rows(spark, rows, "round int, class int, node int, column string, cut double, missing_left boolean, gain double, value double")
