"""Quality rules: fixed rules over words and lines, then a calibrated classifier of hashed n-grams.

Features are rates of hashed words, word pairs and character trigrams. A logistic regression is fitted on a
bounded sample of labelled rows, a second one (Platt) calibrates it on a part of the sample it hasn't
seen, and all rows are scored in Arrow batches against a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, StructField, StructType

from prepkit.llm.codepoints import Words, mixed, windows, words
from prepkit.llm.common import arrow_map, texts_of

BITS = 16
#: Labelled rows that the classifier is fitted on, at most: those whose ids hash lowest.
SAMPLE_ROWS = 4_000
KEEP_AT = 0.5
#: Rows of a block of the fit: what a step holds beside the sample itself.
FIT_ROWS = 256
# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, WINDOW, REPEATED_PERCENT = 10, 5, 20

_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SYMBOL = np.zeros(128, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def base_counts(text: str, w: Words) -> tuple[int, int, int, int, int]:
    """The counts of BASE for a text and its words."""
    h = windows(w.hashes, WINDOW)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(h) + 1, np.int64)
    again[order[1:][same]] = 1
    again[order[:-1][same]] = 1
    at = np.flatnonzero(again)
    cover = np.zeros(len(w.hashes) + WINDOW + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    symbols = _SYMBOL[np.minimum(w.codes, 127)] & (w.codes < 127)
    return len(w.hashes), int(w.inside.sum()), int(symbols.sum()), len(lines) - len(set(lines)), int((np.cumsum(cover) > 0).sum())


def features(w: Words) -> list[np.ndarray]:
    """Hash buckets of the words, the word pairs and the character trigrams."""
    mask, c = np.uint64((1 << BITS) - 1), w.codes
    trigrams = (c[:-2] * _A + c[1:-1] * _B + c[2:] * _C) >> np.uint32(32 - BITS)  # high bits of a product are mixed best
    return [(w.hashes & mask).astype(np.int64), (windows(w.hashes, 2) & mask).astype(np.int64) + (1 << BITS), trigrams.astype(np.int32) + (2 << BITS)]


class Model(NamedTuple):
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, w: Words) -> float:
        logit = self.bias + sum(float(self.weights[x].mean()) for x in features(w) if len(x))
        return 1 / (1 + float(np.exp(-np.clip(self.slope * logit + self.shift, -60, 60))))


class Rates(NamedTuple):
    """Rows of hashed features: columns and rates of all rows one after another, and where each row begins."""

    column: np.ndarray
    value: np.ndarray
    start: np.ndarray

    def blocks(self, first: int, last: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows ``first`` to ``last`` in blocks: their places, columns, rates and each entry's row."""
        for a in range(first, last, FIT_ROWS):
            b = min(last, a + FIT_ROWS)
            own = slice(self.start[a], self.start[b])
            yield slice(a - first, b - first), self.column[own], self.value[own], np.repeat(np.arange(b - a), np.diff(self.start[a : b + 1]))

    def logits(self, first: int, last: int, w: np.ndarray) -> np.ndarray:
        out = np.zeros(last - first)
        for rows, column, value, row in self.blocks(first, last):
            out[rows] = np.bincount(row, value * w[column], rows.stop - rows.start)
        return out


def _logistic(x: Rates, y: np.ndarray, size: int, steps: int, rate: float, ridge: float) -> tuple[np.ndarray, float]:
    """Logistic regression of the first rows of x, as many as y, by Adam steps; a block of rows at a time."""
    w, m, v, b = np.zeros(size), np.zeros(size), np.zeros(size), 0.0
    mb = vb = 0.0
    for t in range(1, steps + 1):
        g, gb = ridge * w, 0.0
        for rows, column, value, row in x.blocks(0, len(y)):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * w[column], rows.stop - rows.start) + b, -60, 60)))
            error = (p - y[rows]) / len(y)
            g += np.bincount(column, value * error[row], size)
            gb += float(error.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        c1, c2 = 1 - 0.9**t, 1 - 0.99**t
        w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-9)
        b -= rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    return w, b


def platt(logit: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """Slope and shift that turn logits into probabilities (targets smoothed, Newton steps)."""
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a = np.array([1.0, 0.0])
    x = np.column_stack([logit, np.ones(len(logit))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -60, 60)))
        g = x.T @ (p - target) + 1e-3 * a
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        a = a - step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(a[0]), float(a[1])


def labelled_sample(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """(id, text, _label) of at most ``rows`` labelled ids, those whose hash is lowest; of an id's texts the least."""
    ids = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("_label")).where(F.col(label_col).isNotNull())
    ids = ids.groupBy(id_col).agg(F.max("_label").alias("_label")).orderBy(F.xxhash64(id_col), id_col).limit(rows)
    own = df.select(id_col, text_col).join(F.broadcast(ids), id_col)  # broadcast: at most `rows` ids
    return own.groupBy(id_col).agg(F.min(text_col).alias(text_col), F.max("_label").alias("_label"))


def fit(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = SAMPLE_ROWS) -> Model | None:
    """The classifier, or None where the sample lacks one of the classes. Rows are put in order, so that it repeats."""
    schema = StructType([StructField("id", df.schema[id_col].dataType), StructField("label", LongType())])
    schema = schema.add("columns", ArrayType(IntegerType())).add("rates", ArrayType(FloatType()))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns, rates = [], []
        for text in texts_of(batch, text_col):
            parts = [np.unique(f, return_counts=True) for f in features(words(text))]
            columns.append(np.concatenate([p[0] for p in parts]).astype(np.int32))
            rates.append(np.concatenate([p[1] / max(1, p[1].sum()) for p in parts]).astype(np.float32))
        return pa.RecordBatch.from_arrays(
            [batch.column(id_col), batch.column("_label").cast(pa.int64()), pa.array(columns, pa.list_(pa.int32())), pa.array(rates, pa.list_(pa.float32()))],
            names=["id", "label", "columns", "rates"])

    got = arrow_map(labelled_sample(df, labels, id_col, text_col, label_col, rows), work, schema).toArrow()
    order = np.asarray(pa.compute.sort_indices(got["id"]))
    y = np.minimum(got["label"].to_numpy(), 1).astype(float)[order]
    if len(y) < 8 or y.min() == y.max():
        return None
    held = mixed(np.arange(len(y)).astype(np.uint64)) % np.uint64(4) == 0
    if any(len(set(y[x])) < 2 for x in (held, ~held)):
        held = np.zeros(len(y), bool)
    by = np.argsort(held, kind="stable")  # rows to fit on, then those to calibrate on
    order, y, fitted = order[by], y[by], int((~held).sum())
    sizes = pa.compute.list_value_length(got["columns"]).to_numpy()
    start = np.concatenate([[0], np.cumsum(sizes[order])]).astype(np.int64)
    x = Rates(np.empty(start[-1], np.int32), np.empty(start[-1], np.float32), start)
    place = np.empty(len(order), np.int64)
    place[order] = start[:-1]
    done = 0
    for batch in got.to_batches():
        for k in range(batch.num_rows):
            own = slice(place[done + k], place[done + k] + sizes[done + k])
            x.column[own], x.value[own] = (np.asarray(batch.column(c)[k].values) for c in ("columns", "rates"))
        done += batch.num_rows
    del got
    w, b = _logistic(x, y[:fitted], 3 << BITS, steps=120, rate=0.3, ridge=1e-6)
    first = fitted if fitted < len(y) else 0
    return Model(w.astype(np.float32), b, *platt(x.logits(first, len(y), w) + b, y[first:]))


def quality_rules(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep_at: float = KEEP_AT,
) -> DataFrame:
    """df with BASE, base_failed, quality (the probability) and kept.

    kept: the base rules hold and quality >= keep_at; without a classifier (no labels of both classes) quality
    is null and the base rules alone decide. A null or empty text has no words, fails the base rules and has
    quality null. Rows that repeat have the same results; columns of df named like a result are replaced.
    """
    model = fit(df, labels, id_col, text_col, label_col)
    shared = df.sparkSession.sparkContext.broadcast(model)  # 3 x 2^16 numbers
    results = [*(StructField(n, LongType()) for n in BASE), StructField("base_failed", BooleanType()), StructField("quality", DoubleType()), StructField("kept", BooleanType())]
    others = [f for f in df.schema.fields if f.name not in {r.name for r in results}]
    schema = StructType([*others, *results])

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in texts_of(batch, text_col):
            w = words(text)
            counts = base_counts(text, w)
            failed = counts[0] < LEAST_WORDS or 100 * counts[4] > REPEATED_PERCENT * counts[0]
            quality = shared.value.probability(w) if shared.value and counts[0] else None
            rows.append((*counts, failed, quality, not failed and (quality is None or quality >= keep_at)))
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(f.name) for f in others), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))],
            names=schema.fieldNames())

    return arrow_map(df.select(*(F.col(f"`{f.name}`") for f in others)), work, schema)
