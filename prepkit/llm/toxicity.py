"""Toxic passages as maximum-scoring segments of token log-odds, calibrated as extreme values.

Tokens are hashed into a fixed number of slots. On the labelled training rows each slot's log-odds between
toxic and clean texts (a text counts a slot once, so that no text's favourite word stands out) are taken with an informative Dirichlet prior (the slot's share of all tokens), and
count as toxic where they are ``Z_LEAST`` standard deviations or more above 0. A token scores the log of how
much likelier it is in a passage of which a share ``DENSITY`` are toxic tokens. One pass over a text's scores
finds all maximal segments. A segment of score S in a text of n tokens has E = K n exp(-lambda S) equals by
chance (Karlin and Altschul); those with E below ``E_MOST`` are significant, a text's evidence is the sum of
-log E over them, and a logistic curve fitted on the training rows turns evidence into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from prepkit.llm.codepoints import Words, words
from prepkit.llm.common import arrow_map, texts_of
from prepkit.llm.quality import labelled_sample, platt

BITS = 18
#: Labelled training rows that log-odds are learned from, at most: those whose ids hash lowest.
SAMPLE_ROWS = 20_000
PRIOR_TOKENS = 10_000.0
Z_LEAST, DENSITY, E_MOST = 3.0, 0.1, 0.05
TOXIC_AT = 0.7


def _slots(text: str) -> tuple[Words, np.ndarray]:
    w = words(text, lower=True, punctuation=False)
    return w, (w.hashes & np.uint64((1 << BITS) - 1)).astype(np.int64)


def segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (from, to, score) of a sequence: Ruzzo and Tompa's linear scan.

    Only tokens with a positive score start or lengthen a segment, so the loop runs over those alone.
    """
    up = np.flatnonzero(score > 0)
    total = np.concatenate([[0.0], np.cumsum(score)])
    kept: list[tuple[int, int, float, float]] = []  # from, to, sum before, sum at the end
    for i in up:
        begin, end, left, right = int(i), int(i) + 1, float(total[i]), float(total[i + 1])
        while kept:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j -= 1
            if j < 0 or kept[j][3] >= right:
                break
            begin, left = kept[j][0], kept[j][2]
            del kept[j:]
        kept.append((begin, end, left, right))
    return [(a, b, r - x) for a, b, x, r in kept]


class Model(NamedTuple):
    score: np.ndarray
    rate: float  # lambda
    log_k: float
    slope: float
    shift: float

    def passages(self, slots: np.ndarray) -> list[tuple[int, int, float]]:
        """Significant segments as (from token, to token, -log E)."""
        base = self.log_k + np.log(max(1, len(slots)))
        found = ((a, b, self.rate * s - base) for a, b, s in segments(self.score[slots]))
        return [(a, b, e) for a, b, e in found if e > -np.log(E_MOST)]

    def probability(self, evidence: float) -> float:
        return 1 / (1 + float(np.exp(-np.clip(self.slope * np.log1p(evidence) + self.shift, -60, 60))))


def log_odds(toxic: np.ndarray, clean: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each slot between toxic and clean counts under a Dirichlet prior, and its standard score."""
    both = toxic + clean
    prior = PRIOR_TOKENS * (both + 0.01) / (both + 0.01).sum()
    a, b = toxic + prior, clean + prior
    delta = np.log(a / (a.sum() - a)) - np.log(b / (b.sum() - b))
    return delta, delta / np.sqrt(1 / a + 1 / b)


def _rate(score: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum(share * exp(rate * score)) = 1."""
    low, high = 0.0, 1.0
    value = lambda x: float((share * np.exp(np.clip(x * score, -50, 50))).sum()) - 1
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def fit(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = SAMPLE_ROWS) -> Model | None:
    """The model from the labelled rows given (None without rows of both classes)."""
    spark = df.sparkSession
    sample = labelled_sample(df, labels, id_col, text_col, label_col, rows).select(text_col, "_label").persist()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, texts = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for text, label in zip(texts_of(batch, text_col), batch.column("_label").to_pylist(), strict=True):
                sums[min(1, label)] += np.bincount(np.unique(_slots(text)[1]), minlength=1 << BITS)
                texts[min(1, label)] += 1
        used = np.flatnonzero(sums.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.append(used, -1), np.append(sums[0, used], texts[0]), np.append(sums[1, used], texts[1]))], names=["slot", "clean", "toxic"])

    per = sample.mapInArrow(count, "slot long, clean long, toxic long").groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    got = per.toArrow()  # at most 2^18 slots
    slot, c, t = (got[n].to_numpy() for n in ("slot", "clean", "toxic"))
    if not len(slot) or min(c[slot == -1].sum(), t[slot == -1].sum()) == 0:
        sample.unpersist()
        return None
    clean, toxic = np.zeros(1 << BITS), np.zeros(1 << BITS)
    clean[slot[slot >= 0]], toxic[slot[slot >= 0]] = c[slot >= 0], t[slot >= 0]
    delta, z = log_odds(toxic, clean)
    excess = np.where(z >= Z_LEAST, np.exp(np.clip(delta, 0, 12)), 0.0)
    score = np.log(1 - DENSITY + DENSITY * excess)
    share = (clean + PRIOR_TOKENS * (clean + toxic) / max(1.0, (clean + toxic).sum()) * 1e-3 + 1e-9)
    share /= share.sum()
    rate = _rate(score, share)
    first = spark.sparkContext.broadcast(Model(score, rate, 0.0, 1.0, 0.0))

    def best(batch: pa.RecordBatch) -> pa.RecordBatch:
        tops, sizes = [], []
        for text in texts_of(batch, text_col):
            slots = _slots(text)[1]
            tops.append([first.value.rate * s for _, _, s in segments(first.value.score[slots])])
            sizes.append(len(slots))
        return pa.RecordBatch.from_arrays([batch.column("_label").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(tops, pa.list_(pa.float64()))], names=["label", "n", "tops"])

    schema = StructType([StructField("label", LongType()), StructField("n", LongType()), StructField("tops", ArrayType(DoubleType()))])
    seen = arrow_map(sample, best, schema).toArrow()  # a few numbers for each sampled row
    sample.unpersist()
    ordered = sorted(zip(*(seen[c].to_pylist() for c in ("label", "n", "tops")), strict=True))  # so that sums repeat
    y, n, tops = np.array([min(r[0], 1) for r in ordered]), np.array([max(1, r[1]) for r in ordered]), [r[2] for r in ordered]
    # maximum likelihood of K from the clean texts' best scores
    log_k = float(np.log((y == 0).sum()) - np.log(sum(m * np.exp(-max(x, default=0.0)) for m, x, own in zip(n, tops, y == 0, strict=True) if own)))
    least = -np.log(E_MOST)
    evidence = np.array([sum(e for s in x if (e := s - log_k - np.log(m)) > least) for m, x in zip(n, tops, strict=True)])
    slope, shift = platt(np.log1p(evidence), y.astype(float))
    return Model(score, rate, log_k, max(slope, 0.0), shift)


def toxicity(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic_at: float = TOXIC_AT,
) -> DataFrame:
    """df with held_out, score, predicted and passages (from and to code point, -log E of each significant one).

    Labels of rows with crc32(id as text) mod 3 = 1 are held out: nothing is learned from them. A null or empty
    text, and every text where the labels lack a class, has no evidence: passages is empty and the score is that
    of no evidence (0 without a model). Rows that repeat have the same results; a null id isn't held out; columns
    of df named like a result are replaced.
    """
    held = lambda c: F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = fit(df, labels.where(~held(id_col)), id_col, text_col, label_col)
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2^18 numbers
    passage = StructType([StructField("begin", IntegerType()), StructField("end", IntegerType()), StructField("evidence", DoubleType())])
    results = [StructField("held_out", BooleanType()), StructField("score", DoubleType()), StructField("predicted", IntegerType()), StructField("passages", ArrayType(passage))]
    others = [f for f in df.schema.fields if f.name not in {r.name for r in results}]
    schema = StructType([*others, *results])
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("evidence", pa.float64())]))

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores, passages = [], []
        for text in texts_of(batch, text_col):
            w, slots = _slots(text)
            found = shared.value.passages(slots) if shared.value else []
            passages.append([(int(w.begin[a]), int(w.end[b - 1]), float(e)) for a, b, e in found])
            scores.append(shared.value.probability(sum(e for _, _, e in found)) if shared.value else 0.0)
        return pa.RecordBatch.from_arrays(
            [*(batch.column(f.name) for f in others), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= toxic_at) for s in scores], pa.int32()),
             pa.array([[dict(zip(("begin", "end", "evidence"), p, strict=True)) for p in x] for x in passages], kind)], names=schema.fieldNames())

    return arrow_map(df.select(*(F.col(f"`{f.name}`") for f in others), held(id_col).alias("held_out")), work, schema)
