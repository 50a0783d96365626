"""Hierarchical Pitman-Yor model of word pairs: restaurants of contexts share one parent, seated by Gibbs sampling.

A token's restaurant is its context, the 32-bit hash class of the token before; the parent restaurant of all contexts holds
a customer for each table below it, and falls back to a uniform choice. Texts are read once: tasks put some millions of
tokens into a block and send each shard the distinct (token, context) pairs of its tokens, with the documents of
the block that hold them. A shard has all pairs of a token; tokens that a bounded sample of documents shows to be
frequent are dealt by pair, and their totals, for a bounded list, go over the driver. The shards' table is bucketed,
so that a round of sampling reads it in place; a round sends up the tables of each context and gets back their totals.

A round draws the number of tables of every pair from its full conditional given the parent and the context's other tables
as of the round before (generalised Stirling numbers weigh the seatings), then the parent's tables. The last round keeps
some draws; a token's probability is the mean of the draws' predictive probabilities, each of which adds up to one.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from prepkit.llm.codepoints import SPACES, mixed
from prepkit.llm.common import fresh_path, written

# The base score's added count, and how documents are held out.
ADDED, FOLDS = 0.1, 10
#: Tokens of a block, bytes of text a shard has (about), buckets of the shards' table at most.
BLOCK_TOKENS, SHARD_BYTES, BUCKETS = 2_000_000, 16 << 20, 2_000
#: Bytes of text (about, and a token at least) whose hashes are taken at once: each needs some 50 bytes meanwhile.
HASHED_BYTES = 1 << 18
#: Documents (about) that frequent tokens are looked for in, and how many of these there can be.
SAMPLE_DOCS, FREQUENT = 4_000, 16_384
#: Rounds, and in each round sweeps; draws that the last round keeps; strengths of contexts and parent.
ROUNDS, SWEEPS, DRAWS, STRENGTH, PARENT_STRENGTH = 2, 2, 2, 1.0, 1.0
#: Customers of a dish up to which Stirling numbers are tabulated; for more they are continued from the last ones.
TABULATED = 1024
BOS, END = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC6A4A7935BD1E995)

_POWER_BITS = 12
_CODES = mixed(np.arange(256, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
_POWERS = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full((1 << _POWER_BITS) - 1, np.uint64(0x9E3779B97F4A7C15))]))
_WORD = np.ones(256, bool)
_WORD[list(SPACES)] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def small(x: np.ndarray) -> np.ndarray:
    """Whole numbers from 0 in the least unsigned type that holds them."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def pack(*parts: Any) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(parts, 5))


def unpack(data: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens (lower-cased words, then the end), and the number of tokens of each text."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    codes = _LOWER[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    inside = _WORD[codes]
    fresh = np.ones(len(codes) + 1, bool)
    fresh[1:-1] = ~inside[:-1]
    fresh[offsets[:-1]] = True
    begin = np.flatnonzero(inside & fresh[:-1])
    words = np.diff(np.searchsorted(begin, offsets))
    hashes = np.empty(len(begin), np.uint64)
    ends = np.append(begin, len(codes))
    cuts = np.unique(np.append(np.searchsorted(begin, np.arange(0, len(codes), HASHED_BYTES)), len(begin)))
    for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        part, word, at = codes[ends[i] : ends[j]], inside[ends[i] : ends[j]], begin[i:j] - begin[i]
        place = np.arange(len(part), dtype=np.int64) - np.repeat(at, np.diff(at, append=len(part)))
        parts = _CODES[part] * _POWERS[place & ((1 << _POWER_BITS) - 1)]
        if place.max() >> _POWER_BITS:
            parts *= mixed((place >> _POWER_BITS).astype(np.uint64)) | np.uint64(1)
        parts[~word] = 0
        hashes[i:j] = mixed(np.add.reduceat(parts, at) + np.add.reduceat(word, at, dtype=np.uint64))
    tokens = np.full(len(hashes) + len(words), END)
    tokens[np.arange(len(hashes)) + np.repeat(np.arange(len(words)), words)] = hashes
    return tokens, words + 1


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where a new value of sorted columns begins."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def _sums(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)


def _ranked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values, and the place of each among them; np.unique needs twice the memory."""
    order = np.argsort(x)
    x = x[order]
    starts = _runs(x)
    place = np.empty(len(x), np.int32)
    place[order] = np.repeat(np.arange(len(starts), dtype=np.int32), np.diff(starts, append=len(x)))
    return x[starts], place


def messages(tokens: np.ndarray, sizes: np.ndarray, learn: np.ndarray, frequent: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    """(shard, data) of a block: its pairs sorted by token and context, with counts and documents."""
    context = np.empty(len(tokens), np.uint32)
    context[1:] = tokens[:-1] >> np.uint64(32)
    context[np.cumsum(sizes) - sizes] = BOS >> np.uint64(32)
    words, place = _ranked(tokens)
    del tokens  # a block's arrays are let go as soon as they are used: two workers share an executor
    keys = place.astype(np.uint64)
    del place
    keys <<= np.uint64(32)
    keys |= context
    del context
    order = np.argsort(keys)
    keys = keys[order]
    pair = _runs(keys)
    keys = keys[pair]
    docs = small(np.repeat(np.arange(len(sizes), dtype=np.uint32), sizes)[order])
    del order
    counts, learned_counts = np.diff(pair, append=len(docs)), _sums(learn[docs], pair)
    place, u = (keys >> np.uint64(32)).astype(np.int32), keys.astype(np.uint32)
    del keys
    shard = (mixed(words) % np.uint64(shards)).astype(np.min_scalar_type(shards))[place]
    known = np.flatnonzero(np.isin(words, frequent)[place])
    shard[known] = mixed(words[place[known]] + mixed(u[known].astype(np.uint64))) % np.uint64(shards)
    by = np.argsort(shard, kind="stable")
    for a, b in _slices(_runs(shard[by]), len(by)):
        own = by[a:b]
        n, word = counts[own], _runs(place[own])
        ends = np.cumsum(n)
        at = np.repeat(pair[own] - ends + n, n) + np.arange(ends[-1])
        yield int(shard[own[0]]), pack(words[place[own][word]], small(np.diff(word, append=b - a)), u[own], small(n), small(learned_counts[own]), small(docs[at]))


def _slices(starts: np.ndarray, end: int) -> Iterator[tuple[int, int]]:
    return zip(starts.tolist(), [*starts[1:].tolist(), end] if len(starts) else [], strict=True)


def merged(table: pa.Table) -> pa.Table:
    """One row of a shard: its pairs with counts of learning (pairs), and each block's tokens as places among them."""
    shard = table["shard"][0].as_py()
    if shard < 0:
        return pa.table({"shard": [shard], "pairs": pa.array([None], pa.binary()), "tokens": table["data"].combine_chunks()[:1]})
    blocks, data = table["block"].to_pylist(), [unpack(d.as_py()) for d in table["data"]]
    words = np.unique(np.concatenate([d[0] for d in data]))
    keys = np.concatenate([(np.repeat(np.searchsorted(words, d[0]), d[1]).astype(np.uint64) << np.uint64(32)) | d[2] for d in data])
    keys, at = _ranked(keys)
    counts = np.bincount(at, np.concatenate([d[4] for d in data]), len(keys)).astype(np.int64)
    per_word = np.bincount((keys >> np.uint64(32)).astype(np.int64), minlength=len(words))
    pairs = pack(words, small(per_word), keys.astype(np.uint32), small(counts))
    del keys, counts
    cuts = np.cumsum([len(d[2]) for d in data])[:-1]
    tokens = [(b, small(np.diff(own, prepend=0)), d[3], d[5]) for b, own, d in zip(blocks, np.split(at, cuts), data, strict=True)]
    return pa.table({"shard": [shard], "pairs": pa.array([pairs], pa.binary()), "tokens": pa.array([pack(tokens)], pa.binary())})


@lru_cache(maxsize=4)
def log_stirling(discount: float, most: int = TABULATED) -> np.ndarray:
    """Logarithms of generalised Stirling numbers: [n, t] weighs all seatings of n customers at t tables."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(most + 1)
    for n in range(most):
        with np.errstate(divide="ignore"):
            stay = out[n] + np.log(np.maximum(n - discount * t, 0))
        out[n + 1] = np.logaddexp(stay, np.concatenate([[-np.inf], out[n, :-1]]))
    return out


def sample_tables(customers: np.ndarray, base: np.ndarray, others: np.ndarray, discount: float, strength: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish from the full conditional: customers, the parent's probability, tables of other dishes."""
    tables = np.minimum(customers, 1).astype(np.int64)
    many = np.flatnonzero((customers > 1) & (customers <= TABULATED))
    many = many[np.argsort(customers[many], kind="stable")]
    weights = log_stirling(discount)
    for a, b in _slices(_runs(customers[many]), len(many)):
        n = int(customers[many[a]])
        t = np.arange(1, n + 1)
        for rows in np.array_split(many[a:b], 1 + (b - a) * n // 500_000):
            new = np.log(strength + discount * (others[rows, None] + t - 1.0)) + np.log(base[rows, None])
            score = np.cumsum(new, axis=1) + weights[n, 1 : n + 1] - np.log(-np.log(rng.random((len(rows), n)) + 1e-300) + 1e-300)
            tables[rows] = 1 + score.argmax(axis=1)
    for i in np.flatnonzero(customers > TABULATED):
        score = _long_scores(int(customers[i]), float(base[i]), float(others[i]), discount, strength)
        tables[i] = 1 + (score - np.log(-np.log(rng.random(len(score)) + 1e-300) + 1e-300)).argmax()
    return tables


@lru_cache(maxsize=4)
def _curve(discount: float) -> np.ndarray:
    """Logarithms of R(TABULATED, t), and their first and second differences, for t from 1; see ``_long_scores``."""
    t = np.arange(1, TABULATED + 1)
    weights = log_stirling(discount)[TABULATED, 1:]
    h = weights - weights[0] + np.cumsum(np.log(np.maximum(t - 1, 1))) + (t - 1) * np.log(discount)
    return np.array([h, np.gradient(h), np.gradient(np.gradient(h))])


def _long_scores(n: int, base: float, others: float, discount: float, strength: float) -> np.ndarray:
    """Log weights of 1, 2, .. tables of n customers beyond TABULATED, to where they are negligible.

    R(n, t) = S(n, t) (t - 1)! a^(t - 1) / S(n, 1) is a mean of R(n - 1, t) and R(n - 1, t - 1): one of t - 1 is left out
    at a rate of a / (n - 1 - a) each. Hence R(n, t) is the mean of R(TABULATED, 1 + X) for the number X that stays, of which
    all factorial moments are known. X is taken as the binomial law of its mean and variance, the mean by a saddle point.
    """

    def staying(k: int) -> float:
        """The k-th factorial moment of X over that of t - 1: a quotient of gamma functions, by their series."""
        c = -k * discount
        to, since = (c * np.log(x) + c * (c - 1) / (2 * x) - c * (c - 1) * (2 * c - 1) / (12 * x * x) for x in (n - discount, TABULATED - discount))
        return float(np.exp(to - since))

    one, two = staying(1), staying(2)
    most = (strength + discount * others) * base / (discount * max(1 - base, 1e-6)) + 1
    top = int(min(n, most + 12 * most**0.5 + 60, 1 + (TABULATED - 2) / one))
    t = np.arange(1, top + 1)
    mean = (t - 1) * one
    variance = mean + (t - 1.0) * (t - 2) * two - mean * mean
    stay = np.clip(1 - variance / np.maximum(mean, one), 1e-9, 1 - 1e-9)
    trials, x = mean / stay, mean
    h, h1, h2 = ((lambda x, c=c: np.interp(x, np.arange(TABULATED), c)) for c in _curve(discount))
    for _ in range(30):
        odds = stay * np.exp(h1(x))
        x = (x + trials * odds / (1 - stay + odds)) / 2
    tilt = h1(x)
    odds = stay * np.exp(tilt)
    spread = trials * odds * (1 - stay) / (1 - stay + odds) ** 2
    body = h(x) - tilt * x + trials * np.log1p(stay * np.expm1(tilt)) - np.log1p(np.maximum(-h2(x) * spread, -0.9)) / 2
    new = np.log(strength + discount * (others + t - 1)) + np.log(base) - np.log(np.where(t > 1, discount * (t - 1), 1))
    return np.cumsum(new) + body


class Model(NamedTuple):
    """What all shards share in a round: bounded by the list of frequent tokens."""

    tokens: int  # learned tokens, and distinct ones
    distinct: int
    discount: float
    parent_discount: float
    customers: list[int]  # of the parent restaurant, its tables, of each draw
    tables: list[int]
    frequent: np.ndarray  # sorted hashes of the frequent tokens, with learned counts
    counts: np.ndarray
    frequent_customers: np.ndarray  # and of each draw: in the parent restaurant, customers and tables
    frequent_tables: np.ndarray

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ADDED) / (self.tokens + ADDED * (self.distinct + 1)))

    def parent(self, customers: np.ndarray, tables: np.ndarray, draw: int) -> np.ndarray:
        """The parent's predictive probability of dishes with these customers and tables."""
        n, t = self.customers[draw], self.tables[draw]
        return (np.maximum(customers - self.parent_discount * tables, 0) + (PARENT_STRENGTH + self.parent_discount * t) / (self.distinct + 1)) / (n + PARENT_STRENGTH)


class Shard:
    """A shard's pairs: their words, contexts and learned counts."""

    def __init__(self, pairs: bytes, frequent: np.ndarray) -> None:
        self.words, per_word, self.u, counts = unpack(pairs)
        self.counts = counts.astype(np.int64)
        self.word = np.repeat(np.arange(len(self.words), dtype=np.int32), per_word)
        spot = np.minimum(np.searchsorted(frequent, self.words), max(0, len(frequent) - 1))
        self.frequent = frequent[spot] == self.words if len(frequent) else np.zeros(len(self.words), bool)
        self.spot = spot
        self.contexts, self.context = _ranked(self.u)

    def per_word(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, x, len(self.words)).astype(np.int64)

    def per_context(self, x: np.ndarray) -> np.ndarray:
        return np.bincount(self.context, x, len(self.contexts)).astype(np.int64)

    def of_word(self, own: np.ndarray, frequent: np.ndarray) -> np.ndarray:
        """Numbers of words: the shard's own, but the given ones for frequent words."""
        out = own.copy()
        out[self.frequent] = frequent[self.spot[self.frequent]]
        return out

    def parts(self, shards: int) -> tuple[np.ndarray, list[tuple[int, int]], np.ndarray]:
        """Contexts in the order of the shards that add them up, and where each one's begin and end."""
        to = (mixed(self.contexts.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        return order, list(_slices(_runs(to[order]), len(order))), to[order]


MESSAGE = "kind int, dest long, origin long, data binary, w long, v array<long>"
_UP, _STATE, _FREQUENT, _SCALARS = range(4)


def _message_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["kind", "dest", "origin", "data", "w", "v"])


def _up(shard: Shard, origin: int, shards: int, sums: list[np.ndarray]) -> Iterator[tuple]:
    order, cuts, to = shard.parts(shards)
    for a, b in cuts:
        own = order[a:b]
        yield _UP, int(to[a]), origin, pack(small(np.diff(shard.contexts[own].astype(np.int64), prepend=0)), *(small(s[own]) for s in sums)), None, None


def _frequent(shard: Shard, sums: list[np.ndarray]) -> Iterator[tuple]:
    for i in np.flatnonzero(shard.frequent):
        if any(s[i] for s in sums):
            yield _FREQUENT, None, None, None, int(shard.words[i].view(np.int64)), [int(s[i]) for s in sums]


def answered(table: pa.Table) -> pa.Table:
    """Totals of contexts over all shards, to each shard in the order in which it sent them."""
    data = [unpack(d.as_py()) for d in table["data"]]
    contexts = np.concatenate([np.cumsum(d[0].astype(np.int64)) for d in data])
    _, at = np.unique(contexts, return_inverse=True)
    totals = [np.bincount(at, np.concatenate([d[i] for d in data])).astype(np.int64)[at] for i in range(1, len(data[0]))]
    cuts = np.cumsum([len(d[0]) for d in data])[:-1]
    back = [pack(*(small(x) for x in own)) for own in zip(*(np.split(t, cuts) for t in totals), strict=True)]
    return pa.table([table["origin"].combine_chunks(), table["dest"].combine_chunks(), pa.array(back, pa.binary())], names=["shard", "origin", "data"])


ANSWER = "shard long, origin long, data binary"


def _with_answers(shard: Shard, answers: pa.Table, shards: int) -> tuple[list[np.ndarray], tuple]:
    """Totals of the shard's contexts and its own state (origin -1)."""
    got = {o: unpack(d) for o, d in zip(answers["origin"].to_pylist(), answers["data"].to_pylist(), strict=True)}
    order, cuts, to = shard.parts(shards)
    state = got.pop(-1, ())
    totals: list[np.ndarray] = []
    for a, b in cuts:
        for i, own in enumerate(got[int(to[a])]):
            if len(totals) <= i:
                totals.append(np.zeros(len(order), np.int64))
            totals[i][order[a:b]] = own
    return totals, state


def _round(shard: Shard, origin: int, answers: pa.Table, shards: int, model: Model, number: int, draws: int) -> pa.Table:
    """A round of a shard: sweeps over its pairs and words, then the draws that go up."""
    (_, tables_of_context), state = _with_answers(shard, answers, shards)
    learned = np.flatnonzero(shard.counts)
    several = learned[shard.counts[learned] > 1]
    tables = np.minimum(shard.counts, 1)
    below = np.minimum(shard.per_word(tables), 1)
    if state:
        tables[several], below = state[0].astype(np.int64), state[1].astype(np.int64)
    others = tables_of_context[shard.context[several]] - tables[several]
    rng = np.random.default_rng([origin, number])
    kept_sums, kept_state, kept_words, scalars = [], [], [], []
    for sweep in range(SWEEPS - 1 + draws):
        customers = shard.of_word(shard.per_word(tables), model.frequent_customers[:, 0])
        root = shard.of_word(below, model.frequent_tables[:, 0])
        base = model.parent(customers, root, 0)
        tables[several] = sample_tables(shard.counts[several], base[shard.word[several]], others, model.discount, STRENGTH, rng)
        customers = np.where(shard.frequent, 0, shard.per_word(tables))
        uniform = np.full(len(customers), 1 / (model.distinct + 1))
        below = sample_tables(customers, uniform, np.maximum(model.tables[0] - below, 0), model.parent_discount, PARENT_STRENGTH, rng)
        if sweep >= SWEEPS - 1:
            kept_sums.append(shard.per_context(tables))
            kept_state += [small(tables[several]), small(below)]
            kept_words.append(shard.per_word(tables))
            scalars += [int(tables.sum()), int(below.sum())]
    counts = shard.per_context(shard.counts)
    rows = [*_up(shard, origin, shards, [counts, *kept_sums]), *_frequent(shard, kept_words),
            (_STATE, origin, -1, pack(*kept_state), None, None), (_SCALARS, None, None, None, None, scalars)]
    return pa.Table.from_batches([_message_batch(rows)])


def _scores(shard: Shard, tokens: bytes, answers: pa.Table, shards: int, model: Model, draws: int) -> Iterator[tuple[int, bytes]]:
    """(block, data): documents of a block with the sums of their tokens in this shard."""
    (counts_of_context, *tables_of_context), state = _with_answers(shard, answers, shards)
    several = np.flatnonzero(shard.counts > 1)
    total = counts_of_context[shard.context] + STRENGTH
    probability = np.zeros(len(shard.counts))
    for k in range(draws):
        tables = np.minimum(shard.counts, 1)
        tables[several] = state[2 * k]
        customers = shard.of_word(shard.per_word(tables), model.frequent_customers[:, k])
        root = shard.of_word(state[2 * k + 1].astype(np.int64), model.frequent_tables[:, k])
        seen = np.maximum(shard.counts - model.discount * tables, 0)
        del tables
        more = (STRENGTH + model.discount * tables_of_context[k])[shard.context]
        more *= model.parent(customers, root, k)[shard.word]
        seen += more
        seen /= total
        seen /= draws
        probability += seen
    del total, more, seen
    of_word = shard.of_word(shard.per_word(shard.counts), model.counts)
    score, base, known = np.log10(probability, out=probability), model.base(of_word)[shard.word], (of_word > 0)[shard.word]
    for block, steps, counts, docs in unpack(tokens)[0]:
        at = np.repeat(np.cumsum(steps.astype(np.int64)), counts)
        own, place = np.unique(docs, return_inverse=True)
        yield block, pack(small(own.astype(np.int64)), small(np.bincount(place, known[at]).astype(np.int64)), np.bincount(place, base[at]), np.bincount(place, score[at]))


def _bucketed(df: DataFrame, label: str, by: str, buckets: int) -> DataFrame:
    """The frame as a table in the shared folder, bucketed: grouping by its key exchanges nothing."""
    name = f"llm_{label}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, by).option("path", fresh_path(df.sparkSession, label)).saveAsTable(name)
    return df.sparkSession.table(name)


def _frequent_tokens(df: DataFrame, id_col: str, text_col: str, shards: int, rows: int) -> np.ndarray:
    """Sorted hashes of tokens with more than a quarter of a shard's share in about SAMPLE_DOCS documents.

    The list decides which tokens are dealt by pair, never what is counted; by the share it is shorter than FREQUENT.
    """
    if shards == 1:
        return np.zeros(0, np.uint64)
    sample = df.where(F.pmod(F.xxhash64(f"`{id_col}`", F.octet_length(f"`{text_col}`")), F.lit(-(-rows // SAMPLE_DOCS))) == 0).select(text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = np.unique(token_hashes(batch.column(text_col))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["w", "n"])

    found = written(sample.mapInArrow(count, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "sample")
    total = found.agg(F.sum("n")).first()[0] or 0
    own = found.where(F.col("n") > total / min(4 * shards, FREQUENT)).collect()
    return np.sort(np.array([r["w"] for r in own], np.int64).view(np.uint64))


def _discount(once: int, twice: int) -> float:
    """The discount that the counts of what is seen once and twice suggest."""
    return float(np.clip(once / (once + 2 * twice), 0.05, 0.95)) if once else 0.5


def pitman_yor_scores(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) for each row of df.

    Tokens are the lower-cased (A-Z) words of a text, then its end; a null text is empty and has its end alone. The model
    learns from rows whose crc32(id as text) mod 10 is not 0; a row without an id is held out. score is the log10
    probability of all tokens, base_score that of single tokens with 0.1 added to their counts; perplexity is
    10 ^ (-score / n_tokens). Rows that repeat are learned from and scored each. Where nothing is learned all
    probabilities are 1; an empty table has no rows. Results repeat for the same rows. Other columns of df aren't read.
    df must give a task the same rows in the same order when the task is run again, as files and written tables do.
    """
    schema = StructType([StructField(id_col, df.schema[id_col].dataType), StructField("held_out", BooleanType()), *(StructField(c, LongType()) for c in ("n_tokens", "n_known", "train_tokens")),
                         *(StructField(c, DoubleType()) for c in ("base_score", "score", "perplexity"))])
    spark = df.sparkSession
    own = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    n_bytes, n_rows = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    if not n_rows:
        return spark.createDataFrame([], schema)
    shards = max(1, -(-(n_bytes + n_rows) // SHARD_BYTES))
    frequent = _frequent_tokens(own, "id", "text", shards, n_rows)
    held = F.coalesce(F.crc32(F.col("id").cast("string")) % FOLDS == 0, F.lit(True))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, kept = TaskContext.get().partitionId() << 32, []

        def sent() -> Iterator[pa.RecordBatch]:
            sizes, flags, ids = *(np.concatenate([k[i] for k in kept]) for i in (1, 2)), pa.concat_arrays([k[3] for k in kept])
            found = messages(np.concatenate([k[0] for k in kept]), sizes, ~flags, frequent, shards)
            kept.clear()
            for shard, data in found:
                yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([number]), pa.array([data], pa.binary())], names=["shard", "block", "data"])
            docs = pack(ids, sizes, flags)
            yield pa.RecordBatch.from_arrays([pa.array([-1 - number]), pa.array([number]), pa.array([docs], pa.binary())], names=["shard", "block", "data"])

        for batch in batches:
            if batch.num_rows:
                tokens, sizes = token_hashes(batch.column("text"))
                kept.append((tokens, sizes, batch.column("held").to_numpy(zero_copy_only=False), batch.column("id")))
            if sum(len(k[0]) for k in kept) >= BLOCK_TOKENS:
                yield from sent()
                number += 1
        if kept:
            yield from sent()

    sent = own.withColumn("held", held).mapInArrow(blocks, "shard long, block long, data binary")
    table = _bucketed(sent.groupBy("shard").applyInArrow(merged, "shard long, pairs binary, tokens binary"), "pairs", "shard", min(shards, BUCKETS))
    pairs = table.where("shard >= 0").select("shard", "pairs")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for origin, data in zip(batch.column("shard").to_pylist(), batch.column("pairs").to_pylist(), strict=True):
                s = Shard(data, frequent)
                one = np.minimum(s.counts, 1)
                words, under = s.per_word(s.counts), s.per_word(one)
                alone = np.where(s.frequent, 0, under)
                scalars = [int(s.counts.sum()), int((alone > 0).sum()), int(one.sum()), *(int((x == n).sum()) for x in (s.counts, alone) for n in (1, 2))]
                yield _message_batch([*_up(s, origin, shards, [s.per_context(s.counts), s.per_context(one)]), *_frequent(s, [words, under]), (_SCALARS, None, None, None, None, scalars)])

    def gathered(messages: DataFrame) -> tuple[DataFrame, list[int], np.ndarray]:
        """Answers to all shards with their state, the sums of the scalars, and those of the frequent tokens."""
        listed = messages.where(f"kind = {_SCALARS}").select(F.posexplode("v")).groupBy("pos").agg(F.sum("col").alias("s")).collect()
        scalars = [r["s"] for r in sorted(listed, key=lambda r: r["pos"])]
        sums = messages.where(f"kind = {_FREQUENT}").select("w", F.posexplode("v")).groupBy("w", "pos").agg(F.sum("col").alias("s")).collect()  # a bounded list
        out = np.zeros((len(frequent), 1 + max((r["pos"] for r in sums), default=1)), np.int64)
        for r in sums:
            out[np.searchsorted(frequent, np.int64(r["w"]).view(np.uint64)), r["pos"]] = r["s"]
        back = messages.where(f"kind = {_UP}").select("dest", "origin", "data").groupBy("dest").applyInArrow(answered, ANSWER)
        state = messages.where(f"kind = {_STATE}").select(F.col("dest").alias("shard"), "origin", "data")
        return back.unionByName(state), scalars, out

    answers, scalars, sums = gathered(written(pairs.mapInArrow(seen, MESSAGE), "contexts"))
    model = Model(scalars[0], scalars[1] + int((sums[:, 0] > 0).sum()), _discount(scalars[3], scalars[4]), _discount(scalars[5], scalars[6]),
                  [scalars[2]], [scalars[1] + int((sums[:, 1] > 0).sum())], frequent, sums[:, 0], sums[:, 1:2], np.minimum(sums[:, 1:2], 1))

    def turn(model: Model, number: int, draws: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def work(left: pa.Table, right: pa.Table) -> pa.Table:
            return _round(Shard(left["pairs"][0].as_py(), frequent), left["shard"][0].as_py(), right, shards, model, number, draws)

        return work

    for number in range(ROUNDS):
        draws = DRAWS if number == ROUNDS - 1 else 1
        sampled = written(pairs.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(turn(model, number, draws), MESSAGE), "round")
        answers, scalars, sums = gathered(sampled)
        rng = np.random.default_rng(number)
        sums = sums[:, :draws] if sums.shape[1] >= draws else np.zeros((len(frequent), draws), np.int64)
        uniform = np.full(len(frequent), 1 / (model.distinct + 1))
        tables = np.column_stack([sample_tables(sums[:, k], uniform, np.full(len(frequent), scalars[2 * k + 1]), model.parent_discount, PARENT_STRENGTH, rng) for k in range(draws)])
        model = model._replace(customers=[scalars[2 * k] for k in range(draws)], tables=[scalars[2 * k + 1] + int(tables[:, k].sum()) for k in range(draws)],
                               frequent_customers=sums, frequent_tables=tables)

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        shard = Shard(left["pairs"][0].as_py(), frequent)
        rows = list(_scores(shard, left["tokens"][0].as_py(), right, shards, model, DRAWS))
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "data"])

    parts = table.where("shard >= 0").groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(scored, "block long, data binary")
    docs = table.where("shard < 0").select((-1 - F.col("shard")).alias("block"), F.col("tokens").alias("docs"))

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, sizes, held = unpack(left["docs"][0].as_py())
        known, base, score = np.zeros(len(sizes), np.int64), np.zeros(len(sizes)), np.zeros(len(sizes))
        for data in right["data"]:
            own, *sums = unpack(data.as_py())
            for total, more in zip((known, base, score), sums, strict=True):
                total[own] += more
        n = len(sizes)
        return pa.table([ids, pa.array(held), pa.array(sizes, pa.int64()), pa.array(known), pa.array(np.full(n, model.tokens, np.int64)), pa.array(base), pa.array(score),
                         pa.array(10 ** np.minimum(-score / sizes, 300))], names=schema.fieldNames())

    return docs.groupBy("block").cogroup(parts.groupBy("block")).applyInArrow(summed, schema)
