"""Per-task folds over Arrow batches for work that touches many numeric columns at once.

Row-wise expressions for (columns x bins) make generated methods too large to be compiled, so these
counts are folded with NumPy inside each task. A task emits one small block of sums, whatever the
number of its rows; the blocks are then added up by an ordinary grouped aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa


def columns_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    """Float arrays with NaN for missing."""
    return [c.to_numpy(zero_copy_only=False).astype("float64") for c in batch.columns]


def bin_counter(place: Sequence[Callable[[np.ndarray], np.ndarray]]):
    """Fold: ``place[k]`` maps the values of column k to bins 0.. ; missing values count as bin -1."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(1, dtype="int64") for _ in place]
        for batch in batches:
            for k, v in enumerate(columns_of(batch)):
                missing = np.isnan(v)
                found = np.bincount(np.where(missing, 0, place[k](np.where(missing, 0.0, v)) + 1))
                if len(found) > len(totals[k]):
                    totals[k] = np.pad(totals[k], (0, len(found) - len(totals[k])))
                totals[k][: len(found)] += found
        rows = [(k, b - 1, int(n)) for k, t in enumerate(totals) for b, n in enumerate(t) if n]
        if rows:
            cols, bins, counts = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols, pa.int32()), pa.array(bins, pa.int32()), pa.array(counts, pa.int64())],
                names=["col", "bin", "n"])

    return fold


COUNT_SCHEMA = "col int, bin int, n bigint"


def right_closed(edges: Sequence[float]) -> Callable[[np.ndarray], np.ndarray]:
    """1-based (a, b] bins, the first one holding its left edge; 0 = outside."""
    e = np.asarray(edges, dtype="float64")

    def place(v: np.ndarray) -> np.ndarray:
        if len(e) < 2:
            return np.zeros(len(v), dtype="int64")
        spot = np.maximum(np.searchsorted(e, v, side="left"), 1)
        return np.where((v < e[0]) | (v > e[-1]), 0, spot)

    return place


def equal_width(lo: float, hi: float, bins: int) -> Callable[[np.ndarray], np.ndarray]:
    """1-based bins; the maximum falls in the last one."""
    width = (hi - lo) / bins

    def place(v: np.ndarray) -> np.ndarray:
        if not width:
            return np.ones(len(v), dtype="int64")
        return np.minimum(np.floor((v - lo) / width).astype("int64") + 1, bins)

    return place
