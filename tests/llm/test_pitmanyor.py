"""Language-model scores: counts and base scores against brute force, the sampler against enumeration, the model by its sums."""

import collections
import itertools
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from prepkit.llm import pitmanyor
from prepkit.llm.common import tuned

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def _tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), None]


def _held(i):
    return i is None or zlib.crc32(str(i).encode()) % 10 == 0


def brute(rows):
    counts = collections.Counter(w for i, t in rows if not _held(i) for w in _tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        ws = _tokens(t)
        out.append((i, _held(i), len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)))
    return sorted(out, key=str)


def _same(got, want):
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=str)
    key = lambda r: (str(r[0]), r[2], r[3], round(r[5], 6))
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-10, atol=1e-9)


def _random_rows(seed, n=120):
    rng = random.Random(seed)
    words = ["The", "the", "é", "É", "a", "b|", "\x7f", "x" * 9000, *(f"w{k}" for k in range(40))]
    rows = [(i, "".join(rng.choice(words) + rng.choice([" ", "\n", "\t ", "\x0b", " "]) for _ in range(rng.randint(0, 60)))) for i in range(n)]
    return [*rows, (7, None), (8, ""), (9, " \n "), (None, "the a"), rows[0], rows[0], (500, "the \x1c a\x85b")]


@pytest.mark.parametrize(("block", "shard"), [(4_000_000, 16 << 20), (500, 4000)])
def test_counts_and_base_scores(spark, monkeypatch, block, shard):
    monkeypatch.setattr(pitmanyor, "BLOCK_TOKENS", block)
    monkeypatch.setattr(pitmanyor, "SHARD_BYTES", shard)
    rows = _random_rows(4)
    df = tuned(spark).createDataFrame(rows, "doc_id long, text string").repartition(3)
    df = df.selectExpr("*", "1 AS id", "2 AS held", "3 AS score", "4 AS shard", "5 AS block")
    got = pitmanyor.pitman_yor_scores(df).collect()
    _same(got, brute(rows))
    assert all(r.score < 0 and abs(r.perplexity - 10 ** (-r.score / r.n_tokens)) < 1e-9 * r.perplexity for r in got)
    again = pitmanyor.pitman_yor_scores(df.coalesce(1)).collect()
    mean = lambda rows: sum(r.score for r in rows) / sum(r.n_tokens for r in rows)
    assert abs(mean(got) - mean(again)) < 0.02  # other draws, the same model


def test_many_shards_with_frequent_tokens_are_one_model(spark, monkeypatch):
    monkeypatch.setattr(pitmanyor, "SHARD_BYTES", 600)
    rows = [(i, " ".join(["the"] * (i % 30) + [f"w{i * k % 17}" for k in range(12)])) for i in range(100)]
    df = tuned(spark).createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert len(pitmanyor._frequent_tokens(df, "doc_id", "text", 60, 100)) > 1
    _same(pitmanyor.pitman_yor_scores(df).collect(), brute(rows))


def test_the_model_sums_to_one_in_a_shard():
    """All words of a vocabulary in one shard: predictive probabilities of a seen and an unseen context."""
    rng = np.random.default_rng(3)
    words = np.sort(rng.integers(1, 2**63, 30).astype(np.uint64))
    contexts = np.array([5, 9], np.uint32)
    counts = rng.integers(0, 6, (30, 2))
    counts[0, 0] = 3000
    pairs = pitmanyor.pack(words, np.full(30, 2), np.tile(contexts, 30), counts.ravel())
    s = pitmanyor.Shard(pairs, np.zeros(0, np.uint64))
    assert (s.per_context(s.counts) == counts.sum(axis=0)).all() and (s.per_word(s.counts) == counts.sum(axis=1)).all()
    one = np.minimum(s.counts, 1)
    known = int((counts.sum(axis=1) > 0).sum())
    empty = np.zeros((0, 1), np.int64)
    model = pitmanyor.Model(int(counts.sum()), known, 0.6, 0.4, [int(one.sum())], [known], np.zeros(0, np.uint64), np.zeros(0, np.int64), empty, empty)
    table = lambda sums, state: pa.table({"origin": [0, -1][: 2 if state else 1], "data": [pitmanyor.pack(*sums), *([state] if state else [])]})
    messages = pitmanyor._round(s, 0, table([s.per_context(s.counts), s.per_context(one)], None), 1, model, 0, 2).to_pylist()
    (up,), (state,), (scalars,) = ([m for m in messages if m["kind"] == k] for k in (0, 1, 3))
    _, c, *tables = pitmanyor.unpack(up["data"])
    model = model._replace(customers=scalars["v"][::2], tables=scalars["v"][1::2], frequent_customers=np.zeros((0, 2), np.int64), frequent_tables=np.zeros((0, 2), np.int64))
    assert all(t.sum() == n for t, n in zip(tables, model.customers, strict=True))
    # a document for each pair, so that a document's score is that pair's
    tokens = pitmanyor.pack([(0, pitmanyor.small(np.diff(np.arange(60), prepend=0)), np.ones(60, np.uint8), np.arange(60, dtype=np.uint8))])
    ((_, data),) = pitmanyor._scores(s, tokens, table([c, *tables], state["data"]), 1, model, 2)
    p = 10 ** pitmanyor.unpack(data)[3].reshape(30, 2)
    own = counts.sum(axis=1) > 0
    assert np.allclose(p[own].sum(axis=0) + _unknown(model, c, tables), 1, atol=1e-12)
    assert np.allclose(p[~own], _unknown(model, c, tables), atol=1e-12)


def _unknown(model, c, tables):
    """Mean over the draws of a context's probability of a word that was never seen."""
    zero = np.zeros(1, np.int64)
    return np.mean([(1.0 + model.discount * t) / (c + 1.0) * model.parent(zero, zero, k)[0] for k, t in enumerate(tables)], axis=0)


def test_stirling_numbers():
    """S(n, t) adds up, over partitions of n customers to t tables, products of (1 - a)(2 - a) ... (size - 1 - a)."""
    a = 0.3

    def seatings(n):
        if n == 0:
            yield []
            return
        for s in seatings(n - 1):
            for k in range(len(s)):
                yield [*s[:k], s[k] + 1, *s[k + 1 :]]
            yield [*s, 1]

    for n in range(1, 7):
        want = collections.Counter()
        sizes = collections.Counter(tuple(s) for s in seatings(n))
        for s, times in sizes.items():
            want[len(s)] += times * math.prod(math.prod(j - a for j in range(1, k)) for k in s)
        got = np.exp(pitmanyor.log_stirling(a)[n, : n + 1])
        assert np.allclose(got[1:], [want[t] for t in range(1, n + 1)])


def test_tables_follow_their_conditional():
    """Draws of many equal dishes against the weights of all seatings, order by order."""
    n, base, others, a, b = 6, 0.2, 3, 0.5, 1.0
    weights = np.zeros(n + 1)
    for opens in itertools.product([0, 1], repeat=n - 1):
        t, weight = 1, (b + a * others) * base
        for i, new in enumerate(opens, 1):
            weight *= (b + a * (others + t)) * base if new else i - a * t
            t += new
        weights[t] += weight
    size = 40_000
    draws = pitmanyor.sample_tables(np.full(size, n), np.full(size, base), np.full(size, others), a, b, np.random.default_rng(1))
    assert np.allclose(np.bincount(draws, minlength=n + 1) / size, weights / weights.sum(), atol=0.01)


@pytest.mark.parametrize(("n", "base", "others", "a"), [(1025, 0.05, 50, 0.6), (5000, 0.05, 50, 0.6), (4000, 0.3, 300, 0.75), (20_000, 0.02, 20_000, 0.7), (3000, 0.5, 800, 0.4), (6000, 0.01, 0, 0.9)])
def test_tables_of_many_customers(n, base, others, a):
    """Weights beyond the tabulated numbers against a recursion over all customers."""
    top = 1500
    t = np.arange(top + 1)
    weights = np.full(top + 1, -np.inf)
    weights[1] = 0.0
    with np.errstate(divide="ignore"):
        opened = np.log((1.0 + a * (others + t)) * base)
        for i in range(1, n):
            weights = np.logaddexp(weights + np.log(np.maximum(i - a * t, 0)), np.concatenate([[-np.inf], (weights + opened)[:-1]]))
    want = np.exp(weights - weights.max())
    want /= want.sum()
    got = np.exp((s := pitmanyor._long_scores(n, base, others, a, 1.0)) - s.max())
    got = np.pad(got / got.sum(), (1, max(0, top - len(got))))[: top + 1]
    mean = (t * want).sum()
    assert want[-1] < 1e-12 and abs((t * got).sum() / mean - 1) < 0.002
    assert np.abs(got - want).sum() < 0.05


@pytest.mark.parametrize(("n", "base", "others", "a"), [(3000, 0.5, 800, 0.2), (1500, 0.7, 400, 0.4), (2000, 0.3, 1500, 0.5)])
def test_tables_of_many_customers_with_many_tables(n, base, others, a):
    """Hundreds of tables, where those that stay are far from a law of independent ones."""
    t = np.arange(1501)
    weights = np.where(t == 1, 0.0, -np.inf)
    with np.errstate(divide="ignore"):
        opened = np.log((1.0 + a * (others + t)) * base)
        for i in range(1, n):
            weights = np.logaddexp(weights + np.log(np.maximum(i - a * t, 0)), np.concatenate([[-np.inf], (weights + opened)[:-1]]))
    want, got = (np.exp(s - s.max()) for s in (weights, pitmanyor._long_scores(n, base, others, a, 1.0)))
    want, got = want / want.sum(), np.pad(got / got.sum(), (1, 1500 - len(got)))
    assert abs((t * got).sum() / (t * want).sum() - 1) < 0.003 and np.abs(got - want).sum() < 0.05


def _most_bytes(work):
    tracemalloc.start()
    try:
        out = work()
        return tracemalloc.get_traced_memory()[1], out
    finally:
        tracemalloc.stop()


def test_memory_of_a_block():
    """Two workers share an executor: bytes that a token of a block, and a byte of text, take at most."""
    n = 500_000
    tokens = np.random.default_rng(1).zipf(1.3, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sizes, frequent = np.full(n // 500, 500), np.unique(tokens)[:50]
    found = _most_bytes(lambda: [(shard, sum(map(int, pitmanyor.unpack(data)[3]))) for shard, data in pitmanyor.messages(tokens, sizes, np.ones(len(sizes), bool), frequent, 300)])
    assert found[0] < 45 * n
    assert sum(c for _, c in found[1]) == n and sorted(s for s, _ in found[1]) == sorted({s for s, _ in found[1]}) and max(s for s, _ in found[1]) > 255
    text = " ".join(map(str, range(400_000)))
    most, (hashes, _) = _most_bytes(lambda: pitmanyor.token_hashes(pa.array([text])))
    assert most < 25 * len(text) and len(set(hashes.tolist())) == 400_001


def test_token_hashes_do_not_cross_texts():
    texts = ["ab", "c", "", None, " a\tb ", "AB", "Ab c", "x" * 10_000, "x" * 10_001, "y" * 4096 + "x" * 100, "x" * 100 + "y" * 4096]
    tokens, sizes = pitmanyor.token_hashes(pa.array(texts))
    words = [w for t in texts for w in _tokens(t)]
    assert sizes.tolist() == [len(_tokens(t)) for t in texts]
    assert len(set(zip(words, tokens.tolist(), strict=True))) == len(set(words)) == len(set(tokens.tolist()))
    part, _ = pitmanyor.token_hashes(pa.array(texts)[4:7])
    assert part.tolist() == tokens[sum(sizes[:4]) : sum(sizes[:7])].tolist()


def test_tables_without_rows_or_without_learning(spark):
    df = tuned(spark).createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    assert pitmanyor.pitman_yor_scores(df.where("false")).collect() == []
    got = pitmanyor.pitman_yor_scores(df).collect()
    assert [(r.held_out, r.train_tokens, r.n_known, r.base_score, r.score) for r in got] == [(True, 0, 0, 0.0, 0.0)] * 2


def test_held_out_texts_are_likelier_than_by_the_base(spark, table):
    out = pitmanyor.pitman_yor_scores(table("documents")).where("held_out").selectExpr("sum(score) AS s", "sum(base_score) AS b").first()
    assert out.s > out.b
