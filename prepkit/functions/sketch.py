"""A mergeable quantile sketch: levels of values, a value of level h standing for 2^h of the column.

A level that is full is sorted and every other value goes up a level, the even or the odd ones by a fair bit. Any such step
moves an estimated rank by 2^h at most, and by 0 on average; the sketch adds up both 2^h and 4^h. The first sum is a
bound that always holds; from the second, Hoeffding's inequality gives the error that is passed with a chance of
``DELTA`` at most. A column that never filled a level is held exactly. Sizes of lower levels fall by two thirds,
so that a sketch holds about 3 k values however many it has seen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepkit.functions.columns import number
from prepkit.functions.folds import columns_of

#: Size of the top level; least size of a level; how often an error may pass the stated one.
TOP, LEAST, DELTA = 4096, 8, 1e-9
#: Values that are held as they came before they are put into levels.
BUFFER = 1 << 16
#: Tasks that gather the sketches of one column, before one does.
GATHERED = 32
SKETCH_SCHEMA = "feature string, top int, n bigint, missing bigint, low double, high double, spread double, most double, levels array<array<double>>, salt int"


class Sketch:
    """Estimated ranks and quantiles of the doubles added so far; NaN counts as missing."""

    def __init__(self, top: int = TOP, seed: Sequence[int] = (0,)) -> None:
        self.top, self.levels = top, [np.zeros(0)]
        self.n = self.missing = 0
        self.low, self.high = math.inf, -math.inf
        self.spread = self.most = 0.0
        self._bits = np.random.default_rng(list(seed))

    def add(self, values: np.ndarray) -> Sketch:
        present = values[~np.isnan(values)] + 0.0  # one zero
        self.missing += len(values) - len(present)
        if len(present):
            self.n += len(present)
            self.low, self.high = min(self.low, float(present.min())), max(self.high, float(present.max()))
            self.levels[0] = np.concatenate([self.levels[0], present])
            if len(self.levels[0]) > max(BUFFER, self.top):
                self._compress()
        return self

    def merge(self, other: Sketch) -> Sketch:
        self.n, self.missing = self.n + other.n, self.missing + other.missing
        self.low, self.high = min(self.low, other.low), max(self.high, other.high)
        self.spread, self.most = self.spread + other.spread, self.most + other.most
        for h, values in enumerate(other.levels):
            if h == len(self.levels):
                self.levels.append(np.zeros(0))
            self.levels[h] = np.concatenate([self.levels[h], values])
        self._compress()
        return self

    def _room(self, level: int) -> int:
        return max(LEAST, math.ceil(self.top * (2 / 3) ** (len(self.levels) - 1 - level)))

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            values = self.levels[h]
            if len(values) > self._room(h):
                values = np.sort(values)
                even = len(values) - len(values) % 2
                if h + 1 == len(self.levels):
                    self.levels.append(np.zeros(0))
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], values[int(self._bits.integers(2)) : even : 2]])
                self.levels[h] = values[even:]
                self.spread, self.most = self.spread + 4.0**h, self.most + 2.0**h
            h += 1

    def error(self, delta: float = DELTA) -> float:
        """How far an estimated rank may be from the true one, in rows."""
        return min(self.most, math.sqrt(2 * self.spread * math.log(2 / delta)))

    def steps(self) -> tuple[np.ndarray, np.ndarray]:
        """Held values in order, and the estimated number of rows up to each."""
        values = np.concatenate(self.levels)
        weights = np.repeat(2 ** np.arange(len(self.levels), dtype=np.int64), [len(v) for v in self.levels])
        order = np.argsort(values, kind="stable")
        return values[order], np.cumsum(weights[order])

    def ranks(self, at: Sequence[float]) -> np.ndarray:
        """Estimated number of rows with values up to each of ``at``; exact below the least and from the largest value on."""
        values, up_to = self.steps()
        found = np.concatenate([[0], up_to])[np.searchsorted(values, np.asarray(at, float), "right")]
        return np.where(np.asarray(at) >= self.high, self.n, np.where(np.asarray(at) < self.low, 0, found))

    def quantiles(self, probs: Sequence[float]) -> list[float | None]:
        """Linear quantiles of the held values, each as often as it stands for; the least and the largest value are exact."""
        if not self.n:
            return [None] * len(probs)
        values, up_to = self.steps()

        def at(rank: int) -> float:
            return self.low if rank <= 0 else self.high if rank >= self.n - 1 else float(values[np.searchsorted(up_to, rank + 1, "left")])

        out = []
        for spot in ((self.n - 1) * p for p in probs):
            lo, hi = at(math.floor(spot)), at(math.ceil(spot))
            out.append(lo if lo == hi else lo + (hi - lo) * (spot - math.floor(spot)))
        return out

    def bracket(self, rank: int) -> tuple[float, float]:
        """Values between which the value of a rank (from 0) lies, but for a chance of DELTA."""
        values, up_to = self.steps()
        error = self.error()
        below = int(np.searchsorted(up_to, rank - error, "right")) - 1
        above = int(np.searchsorted(up_to, rank + 1 + error, "left"))
        return float(values[below]) if below >= 0 else self.low, float(values[above]) if above < len(values) else self.high

    def row(self, feature: str, salt: int = 0) -> tuple:
        low, high = (self.low, self.high) if self.n else (None, None)
        return feature, self.top, self.n, self.missing, low, high, self.spread, self.most, [v.tolist() for v in self.levels], salt

    @classmethod
    def of(cls, row: dict) -> Sketch:
        out = cls(row["top"], (row["n"], row["missing"], len(row["levels"])))
        out.n, out.missing, out.spread, out.most = row["n"], row["missing"], row["spread"], row["most"]
        if out.n:
            out.low, out.high = row["low"], row["high"]
        out.levels = [np.array(v, float) for v in row["levels"]]
        return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doubles = pa.list_(pa.list_(pa.float64()))
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), *[pa.float64()] * 4, doubles, pa.int32()]
    names = [f.split()[0] for f in SKETCH_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def sketch_columns(df: DataFrame, cols: Sequence[str], top: int = TOP) -> DataFrame:
    """A sketch of each column as one small row (``SKETCH_SCHEMA``, without salt); NULL and NaN are missing.

    A task holds a sketch a column. Rows of a table without rows have n = 0.
    """
    cols = list(cols)
    values = df.select(*[number(df, c).alias(f"c{i}") for i, c in enumerate(cols)])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        held = [Sketch(top, (task, i)) for i in range(len(cols))]
        for batch in batches:
            for sketch, v in zip(held, columns_of(batch), strict=True):
                sketch.add(v)
        for sketch in held:
            sketch._compress()
        yield _batch([s.row(c, task % GATHERED) for c, s in zip(cols, held, strict=True)])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Sketch] = {}
        for batch in batches:
            for row in batch.to_pylist():
                one = Sketch.of(row)
                held[row["feature"]] = held[row["feature"]].merge(one) if row["feature"] in held else one
        if held:
            yield _batch([s.row(c) for c, s in held.items()])

    parts = values.mapInArrow(fold, SKETCH_SCHEMA).sortWithinPartitions("feature")
    some = parts.repartition("feature", "salt").sortWithinPartitions("n").mapInArrow(gather, SKETCH_SCHEMA)
    return some.repartition("feature").sortWithinPartitions("n").mapInArrow(gather, SKETCH_SCHEMA).drop("salt")


def sketches(df: DataFrame, cols: Sequence[str], top: int = TOP) -> dict[str, Sketch]:
    """The columns' sketches on the driver: about 3 ``top`` numbers each."""
    found = {r["feature"]: Sketch.of(r.asDict()) for r in sketch_columns(df, cols, top).collect()} if len(cols) else {}
    return {c: found.get(c, Sketch(top)) for c in cols}


def read_sketches(df: DataFrame) -> dict[str, Sketch]:
    """Sketches of a table that ``sketch_columns`` made."""
    return {r["feature"]: Sketch.of(r.asDict()) for r in df.select(*[F.col(f.split()[0]) for f in SKETCH_SCHEMA.split(", ")[:-1]]).collect()}
