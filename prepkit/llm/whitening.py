"""Embedding whitening: centred rows reduced by blockwise QR, singular values by dqds, directions by twisted factorisations.

Vectors become whole numbers (floor(64 x) + 1,000,000). The fit is over the distinct ones: tasks add up their sums
exactly, then reduce the rows centred by them to one triangle R each, block by block, and triangles to one triangle, by
QR again. The driver sees d x d numbers alone; ``singular`` finds the directions from R.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from prepkit.llm.common import written
from prepkit.llm.singular import right_singular

# How a component becomes a whole number.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Rows that one QR step stacks under the triangle.
BLOCK = 4096
#: Tasks that the tasks' results are gathered by, before one task gathers theirs.
GATHERED = 32
_LONG = 2**63 - 1


class Whitening(NamedTuple):
    n: int  # distinct vectors
    sums: list[int]  # of each dimension
    values: np.ndarray  # eigenvalues of the covariance, falling
    directions: np.ndarray  # columns: the unit eigenvectors of the leading ones
    sound: np.ndarray  # whether an eigenvalue is above zero by more than rounding
    total: float  # trace of the covariance


def whole_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, x): whole numbers. Rows whose vector is null, or has a component that is null, not finite or beyond long, go."""
    fits = ~F.exists(vector_col, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) >= float(2**56)))
    own = df.where(F.col(f"`{vector_col}`").isNotNull()).where(fits)
    x = F.transform(vector_col, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")) + F.lit(SHIFT))
    return own.select(F.col(f"`{id_col}`").alias("id"), x.cast("array<long>").alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column; shorter ones are padded as if with components 0."""
    offsets, values = np.asarray(column.offsets), np.asarray(column.values)
    sizes, first = np.diff(offsets), offsets[0]
    out = np.full((len(sizes), width), SHIFT, np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(offsets[-1] - first) - np.repeat(offsets[:-1] - first, sizes)] = values[first : offsets[-1]]
    return out


def _folded(df: DataFrame, one: Callable[[np.ndarray], Any], merge: Callable[[Any, Any], Any], width: int) -> Any:
    """``merge`` of ``one`` of all blocks of rows; every task and every gathering task holds one value at a time."""
    schema = "value binary"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows = None, []
        for batch in batches:
            rows.append(_matrix(batch.column("x"), width))
            if sum(map(len, rows)) >= BLOCK:
                value, rows = one(np.concatenate(rows)), []
                kept = value if kept is None else merge(kept, value)
        if rows:
            value = one(np.concatenate(rows))
            kept = value if kept is None else merge(kept, value)
        if kept is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(kept)], pa.binary())], names=["value"])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            for value in batch.column("value"):
                got = pickle.loads(value.as_py())
                kept = got if kept is None else merge(kept, got)
        if kept is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(kept)], pa.binary())], names=["value"])

    parts = df.select("x").mapInArrow(each, schema).repartition(GATHERED).mapInArrow(gathered, schema)
    got = parts.repartition(1).mapInArrow(gathered, schema).collect()
    return pickle.loads(got[0]["value"]) if got else None


def _scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: as long where that fits, else as Python's whole numbers."""
    if not x.size or n * max(int(x.max()), -int(x.min())) + max(map(abs, sums)) <= _LONG // 2:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _sums(x: np.ndarray) -> tuple[int, list[int]]:
    exact = x if int(max(x.max(), -x.min())) <= _LONG // len(x) else x.astype(object)
    return len(x), [int(s) for s in exact.sum(axis=0)]


def fit(distinct: DataFrame, width: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of distinct vectors (column x); None for an empty table or vectors without components."""
    got = _folded(distinct, _sums, lambda a, b: (a[0] + b[0], [s + t for s, t in zip(a[1], b[1], strict=True)]), width) if width else None
    if got is None:
        return None
    n, sums = got

    def triangle(rows: np.ndarray) -> np.ndarray:
        return np.linalg.qr(rows, mode="r")

    r = _folded(distinct, lambda x: triangle((_scaled(x, n, sums) / n).astype(float)), lambda a, b: triangle(np.vstack([a, b])), width)
    square = np.zeros((width, width))
    square[: len(r)] = r  # fewer rows than dimensions
    values, directions, sound = right_singular(square, components)
    return Whitening(n, sums, values / n, directions, sound, float((square * square).sum()) / n)


def apply(x: np.ndarray, w: Whitening) -> np.ndarray:
    """Whitened coordinates: (x - S/n) on each direction, over the root of its eigenvalue; NaN where that is zero."""
    root = np.where(w.sound, np.sqrt(np.where(w.sound, w.values[: len(w.sound)], 1.0)), np.nan)
    return (_scaled(x, w.n, w.sums) / w.n).astype(float) @ w.directions / root


def identity_error(distinct: DataFrame, w: Whitening, width: int) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over components that are sound."""
    if not w.sound.any():
        return None

    def moments(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        y = apply(x, w)[:, w.sound]
        mean = y.mean(axis=0)
        return len(y), mean, (y - mean).T @ (y - mean)

    def merged(a: tuple, b: tuple) -> tuple[int, np.ndarray, np.ndarray]:
        n, gap = a[0] + b[0], b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)

    n, _, squares = _folded(distinct, moments, merged, width)
    return float(np.abs(squares / n - np.eye(len(squares))).max())


def _deviations(x: np.ndarray, w: Whitening) -> list[int | None]:
    """Sum of squares of n x - S, exact; None where long can't hold it."""
    y = _scaled(x, w.n, w.sums)
    top = float(np.abs(y.astype(float)).max(initial=0.0))
    if y.dtype != object and top * top * x.shape[1] < 2.0**62:
        return (y * y).sum(axis=1).tolist()
    return [s if s <= _LONG else None for s in (sum(int(v) ** 2 for v in row) for row in y)]


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error), a row for each row and component.

    Components are numbered from 1 by falling eigenvalue, min(components, d) of them. Rows whose vector is null or
    holds nulls, numbers that aren't finite or are 2^56 and more take no part; a null id is kept. Vectors that
    repeat count once in the fit, and each row has its results. Shorter vectors count as padded with zeros; vectors
    without components, and an empty table, have no rows. Where an eigenvalue is zero (a constant dimension, fewer vectors
    than dimensions) whitened is null; explained is null where all are, as identity_error. deviation is null where it
    passes a long. Other columns of df aren't read.
    """
    schema = StructType([StructField(id_col, df.schema[id_col].dataType), StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()),
                         *(StructField(c, DoubleType()) for c in ("whitened", "explained", "identity_error"))])
    vectors = whole_vectors(df, id_col, vector_col)
    width = vectors.agg(F.max(F.size("x"))).first()[0] or 0
    padded = F.concat("x", F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(width) - F.size("x")))
    distinct = written(vectors.select(padded.alias("x")).distinct(), "vectors")
    w = fit(distinct, width, components)
    if w is None:
        return df.sparkSession.createDataFrame([], schema)
    error, count = identity_error(distinct, w, width), len(w.sound)
    explained = [float(v / w.total) if w.total else None for v in w.values[:count]]
    shared = df.sparkSession.sparkContext.broadcast(w)  # d x components numbers

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, m = _matrix(batch.column("x"), width), batch.num_rows
            if not m:
                continue
            y = apply(x, shared.value).ravel()
            each = np.repeat(np.arange(m), count)
            yield pa.RecordBatch.from_arrays([
                batch.column("id").take(pa.array(each)), pa.array(np.tile(np.arange(1, count + 1), m), pa.int32()), pa.array(np.full(m * count, w.n), pa.int64()),
                pa.array(_deviations(x, shared.value), pa.int64()).take(pa.array(each)), pa.array(y, pa.float64(), mask=np.isnan(y)),
                pa.array(explained * m, pa.float64()), pa.array([error] * (m * count), pa.float64())], names=schema.fieldNames())

    return vectors.mapInArrow(rows, schema)
