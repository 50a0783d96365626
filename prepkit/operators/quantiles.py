"""Exact linear quantiles by narrowing brackets, one plan for every size of table.

Doubles are mapped to whole numbers in the same order. A bracket is a range of them that holds a wanted
rank. The first pass makes a sketch of each column, whose rank error gives brackets of about a hundredth of the rows; the
second counts the values of every bracket and of the gaps between them, which tells the exact rank of each. A bracket of
few values is counted value by value and is done; others are counted in a few thousand even steps, and later passes
go on with the step that holds the rank, cut down to the least and largest value in it. A rank that the sketch has
missed is in a gap, which is gone on with alike. Tasks fold their Arrow batches to counts, so no task or group
ever holds a column.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepkit.functions.columns import number, quoted
from prepkit.functions.folds import columns_of
from prepkit.functions.sketch import Sketch, sketches

ACCURACY = 10_000
#: Steps that the brackets of a column share in a pass, values that they may hold when they are gathered, and in the first count.
STEPS = 1 << 13
GATHERED = 10_000
COUNTED = 1 << 15
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


class Bracket(NamedTuple):
    """Keys low..high hold ranks ``before``..``before + inside - 1``."""

    low: int
    high: int
    before: int
    inside: int


def keys_of(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles (0.0 and -0.0 are one)."""
    bits = (values + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(_HIGH))


def value_of(key: int) -> float:
    k = np.array([key], np.int64)
    return float((k ^ ((k >> 63) & np.int64(_HIGH))).view(np.float64)[0])


def _steps(values: np.ndarray, brackets: list[tuple[int, int, int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bracket, steps, counts, least keys, largest keys) of the values; a bracket is (low, high, width of a step)."""
    key, count = np.unique(keys_of(values), return_counts=True)
    for b, (low, high, width) in enumerate(brackets):
        own = slice(int(np.searchsorted(key, low, "left")), int(np.searchsorted(key, high, "right")))
        k = key[own]
        if len(k):
            step = (k.view(np.uint64) - np.uint64(low & (2**64 - 1))) // np.uint64(width)
            first = np.flatnonzero(np.diff(step, prepend=step[:1] - np.uint64(1)))
            yield b, step[first].astype(np.int64), np.add.reduceat(count[own], first), k[first], k[np.append(first[1:], len(k)) - 1]


def _fold(brackets: dict[int, list[tuple[int, int, int]]]):
    """Counts of all columns' brackets, merged inside the task."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for c, v in enumerate(columns_of(batch)):
                if c in brackets:
                    for b, *parts in _steps(v[~np.isnan(v)], brackets[c]):
                        held.setdefault((c, b), []).append(np.vstack(parts))
                        if len(held[c, b]) == 64:
                            held[c, b] = [_merged(held[c, b])]
        for (c, b), parts in held.items():
            step, n, low, high = _merged(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(step), c, np.int32)), pa.array(np.full(len(step), b, np.int32)), *map(pa.array, (step, n, low, high))],
                names=["col", "bracket", "step", "n", "low", "high"])

    return fold


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    step, n, low, high = np.hstack(parts)
    order = np.argsort(step, kind="stable")
    step, n, low, high = step[order], n[order], low[order], high[order]
    first = np.flatnonzero(np.diff(step, prepend=step[:1] - 1))
    return np.vstack([step[first], np.add.reduceat(n, first), np.minimum.reduceat(low, first), np.maximum.reduceat(high, first)])


def _pass(values: DataFrame, brackets: dict[int, list[tuple[int, int, int]]]) -> dict[tuple[int, int], list[tuple[int, int, int]]]:
    """{(column, bracket): [(count, least key, largest key) of each step that has values, in order]}."""
    counts = values.mapInArrow(_fold(brackets), "col int, bracket int, step bigint, n bigint, low bigint, high bigint")
    total = counts.groupBy("col", "bracket", "step").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    col, bracket, step, *parts = (c.to_numpy() for c in total.toArrow().columns)  # at most COUNTED or STEPS a column
    order = np.lexsort((step, bracket, col))
    col, bracket, parts = col[order], bracket[order], [p[order].tolist() for p in parts]
    first = np.flatnonzero(np.diff(col, prepend=-1) | np.diff(bracket, prepend=-1)).tolist()
    return {(int(col[a]), int(bracket[a])): list(zip(*(p[a:b] for p in parts), strict=True)) for a, b in zip(first, [*first[1:], len(col)])}


def _spans(sketch: Sketch, ranks: list[int]) -> list[tuple[int, int, int]]:
    """(low, high, width of a step) that cover all keys: brackets of the ranks and the gaps between them."""
    found: list[list[int]] = []
    for low, high in sorted(tuple(keys_of(np.array(sketch.bracket(r))).tolist()) for r in ranks):
        if found and low <= found[-1][1]:
            found[-1][1] = max(found[-1][1], high)
        else:
            found.append([low, high])
    out, at = [], _LOW
    for low, high in found:
        if low > at:
            out.append((at, low - 1, low - at))
        up_to = sketch.ranks([np.nextafter(value_of(low), -math.inf), value_of(high)])
        few = up_to[1] - up_to[0] + 2 * sketch.error() <= COUNTED // len(found)
        out.append((low, high, 1 if few else (high - low) // max(2, STEPS // len(found)) + 1))
        at = high + 1
    return out + ([(at, _HIGH, _HIGH - at + 1)] if at <= _HIGH else [])


def linear_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float | None]]:
    """{column: quantiles}; NULL and NaN are left out, an empty column gives None values."""
    cols, probs = list(cols), [float(p) for p in probs]
    out: dict[str, list[float | None]] = {c: [None] * len(probs) for c in cols}
    if not cols or not probs:
        return out
    for c, (sketch, at) in _at_ranks(df, cols, lambda s: _ranks(s.n, probs)).items():
        out[c] = [_between(at, (sketch.n - 1) * p) for p in probs]
    return out


def median_and_filled(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, tuple[float | None, int, list[float | None]]]:
    """{column: (median, number of missing values, quantiles once the median fills them)}, all from the same passes.

    Of the present values x in order and k missing ones, rank r of the filled column is min(x[r], max(median, x[r - k])).
    An infinite x may give no median (NaN); then nothing is filled, as NaN is missing.
    """
    cols, probs = list(cols), [float(p) for p in probs]
    out: dict[str, tuple[float | None, int, list[float | None]]] = {c: (None, 0, [None] * len(probs)) for c in cols}
    if not cols:
        return out

    def wanted(s: Sketch) -> list[int]:
        ranks = {x for r in _ranks(s.n + s.missing, probs) for x in (r, r - s.missing) if 0 <= x < s.n}
        return sorted(ranks.union(_ranks(s.n, [0.5, *probs])))

    for c, (s, at) in _at_ranks(df, cols, wanted).items():
        median = _between(at, (s.n - 1) * 0.5)
        n, k = (s.n, 0) if math.isnan(median) else (s.n + s.missing, s.missing)
        filled = {r: min(at[r] if r < s.n else math.inf, max(median, at[r - k]) if r >= k else median) for r in _ranks(n, probs)}
        out[c] = median, s.missing, [_between(filled, (n - 1) * p) for p in probs]
    return out


def _at_ranks(df: DataFrame, cols: list[str], wanted: Callable[[Sketch], list[int]]) -> dict[str, tuple[Sketch, dict[int, float]]]:
    """{column: (sketch, {rank: value})} for the ranks wanted of each column that has values."""
    values = df.select(*[number(df, c).alias(f"c{i}") for i, c in enumerate(cols)])
    found = sketches(df, cols)
    live = {i: wanted(found[c]) for i, c in enumerate(cols) if found[c].n}
    at: dict[int, dict[int, Bracket]] = {}
    parts = {}
    for i, ranks in live.items():
        own = found[cols[i]]
        if own.error() == 0:  # every value is held
            keys = {r: int(keys_of(np.array([own.bracket(r)[1]]))[0]) for r in ranks}
            at[i] = {r: Bracket(k, k, r, 1) for r, k in keys.items()}
        else:
            parts[i] = _spans(own, ranks)
    if parts:
        counted = _pass(values, parts)
        for i, spans in parts.items():
            at[i], before = {}, 0
            for k, (low, high, _) in enumerate(spans):
                steps = counted.get((i, k), [])
                inside = sum(s[0] for s in steps)
                at[i] |= _narrowed(Bracket(low, high, before, inside), steps, [r for r in live[i] if before <= r < before + inside])
                before += inside
    while True:
        most = {i: max(100, GATHERED // len(set(own.values()))) for i, own in at.items()}
        asked = {i: sorted({b for b in own.values() if b.low < b.high and b.inside > most[i]}) for i, own in at.items()}
        asked = {i: b for i, b in asked.items() if b}
        if not asked:
            break
        counted = _pass(values, {i: [(b.low, b.high, (b.high - b.low) // max(2, STEPS // len(own)) + 1) for b in own] for i, own in asked.items()})
        for i, own in asked.items():
            for k, b in enumerate(own):
                at[i] |= _narrowed(b, counted[i, k], [r for r, x in at[i].items() if x == b])
    few = {i: sorted({b for b in own.values() if b.low < b.high}) for i, own in at.items()}
    few = {i: b for i, b in few.items() if b}
    spans = {i: {r: value_of(b.low) for r, b in own.items() if b.low == b.high} for i, own in at.items()}
    if few:
        # steps of width 1 hold one value each; a bracket has at most GATHERED values
        counted = _pass(values, {i: [(b.low, b.high, 1) for b in own] for i, own in few.items()})
        for i, own in few.items():
            for k, b in enumerate(own):
                exact = _narrowed(b, counted[i, k], [r for r, x in at[i].items() if x == b])
                spans[i] |= {r: value_of(x.low) for r, x in exact.items()}
    return {cols[i]: (found[cols[i]], spans[i]) for i in live}


def _narrowed(bracket: Bracket, steps: list[tuple[int, int, int]], ranks: list[int]) -> dict[int, Bracket]:
    """The bracket of each rank after a pass."""
    ends = np.cumsum([s[0] for s in steps]) + bracket.before
    out = {}
    for r in ranks:
        n, low, high = steps[int(np.searchsorted(ends, r, "right"))]
        out[r] = Bracket(low, high, int(ends[int(np.searchsorted(ends, r, "right"))]) - n, n)
    return out


def _ranks(n: int, probs: list[float]) -> list[int]:
    spots = [(n - 1) * p for p in probs]
    return sorted({f(s) for s in spots for f in (math.floor, math.ceil)})


def _between(values: dict[int, float], spot: float) -> float:
    lo, hi = values[math.floor(spot)], values[math.ceil(spot)]
    return lo if lo == hi else lo + (hi - lo) * (spot - math.floor(spot))


def quantile_columns(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, Column]:
    """{column: ARRAY<DOUBLE> of quantiles} to be used inside ``df.agg`` next to other aggregates."""
    found = linear_quantiles(df, cols, probs)
    return {c: F.array(*[F.lit(v).cast("double") for v in found[c]]) for c in cols}


def range_splitters(df: DataFrame, col: str, parts: int) -> list[float]:
    """Up to parts-1 ascending approximate quantiles that cut the column into even ranges."""
    if parts <= 1:
        return []
    probs = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(quoted(col).cast("double"), F.array(*map(F.lit, probs)),
                                     F.lit(max(ACCURACY, 10 * parts)))).first()
    return sorted(set(row[0] or []))
