"""The conversation trie against a trie built in plain Python."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from prepkit.llm import trie
from prepkit.llm.common import tuned

SCHEMA = "conv_id long, turn long, role string, text string"


def _digest(role, text):
    one = lambda s: hashlib.sha256((s or "").encode()).hexdigest()
    return hashlib.sha256((one(role) + one(text)).encode()).hexdigest()


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0, _digest(role, text)), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        family = int(c - np.fmod(c, 20))
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(family, [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = {}
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        ends = sorted(c for c in convs if len(built[c]) == len(path))
        words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        out[min(convs), len(path)] = (
            min(members[path[:-1]]) if path else None, len(convs), sum(len(p) == len(path) + 1 for p in below),
            sum(not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in members) for p in below),
            sum((len(members[p]) - 1) * words(p) for p in below), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return out


def _got(df):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in trie.conversation_trie(df).collect()}


def _random_rows(seed, convs=70, most=6):
    rng = random.Random(seed)
    rows = []
    for c in [*rng.sample(range(-30, 130), convs)]:
        for turn in range(rng.randint(1, most)):
            rows.append((c, rng.choice([turn, turn, turn, 3, None]), rng.choice(["user", None, "assistant"]), rng.choice(["a b", "a", "", None, "x y z\nw"])))
    rows += [(None, 0, "user", "lost"), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize(("band", "shard_rows"), [(4096, 100_000), (2, 40), (1, 7)])
def test_trie_against_brute_force(spark, monkeypatch, band, shard_rows):
    monkeypatch.setattr(trie, "BAND", band)
    monkeypatch.setattr(trie, "SHARD_ROWS", shard_rows)
    rows = _random_rows(3)
    assert _got(tuned(spark).createDataFrame(rows, SCHEMA).repartition(4)) == brute(rows)


def test_copies_and_turnless_conversations(spark):
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 400, 20) for t in range(3)]  # one path, twenty members
    short = [c for c in range(401, 480) if zlib.crc32(str(c).encode()) % 4 >= 2 and c % 20][:3]
    rows += [(c, 0, "user", "gone") for c in short]  # their only turn is replaced by turns of a missing conversation
    got = _got(tuned(spark).createDataFrame(rows, SCHEMA))
    assert got == brute(rows)
    assert got[0, 0][1] == 20 + len(short) and got[0, 0][5] == hashlib.sha256(",".join(map(str, short)).encode()).hexdigest()
    only = [(c, 0, "user", "gone") for c in short]
    assert _got(spark.createDataFrame(only, SCHEMA)) == brute(only)


def test_empty_table_long_text_and_clashing_columns(spark):
    rows = [(1, 0, "user", "word " * 400_000), (1, 1, None, ""), (20, 0, "user", "a")]
    df = tuned(spark).createDataFrame(rows, SCHEMA)
    more = df.selectExpr("*", "1 AS c", "2 AS pos", "3 AS th", "4 AS words", "5 AS ka", "6 AS n", "7 AS _range", "8 AS base", "9 AS h", "10 AS depth")
    assert _got(more) == brute(rows)
    assert trie.conversation_trie(df.where("false")).collect() == []


def test_ids_of_a_node_are_hashed_over_many_texts(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS", 3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    df = spark.range(100).selectExpr("id % 2 AS ka", "0L AS kb", "id - 50 AS c").repartition(5)
    got = {r.ka: r.ends for r in trie.end_hashes(df).collect()}
    tuned(spark)
    for k in (0, 1):
        assert got[k] == hashlib.sha256(",".join(str(c) for c in range(-50, 50) if c % 2 == k).encode()).hexdigest()


def test_slots_are_minimal_perfect_and_verified():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 20_000):
        a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for _ in range(2))
        slots = trie.SlotTable(a, b)
        assert sorted(slots.find(a, b)) == list(range(n))
        assert (slots.find(a, b + np.uint64(1)) == -1).all()


def test_steps_that_differ_under_one_digest_are_reported():
    z = lambda *x: pa.array(x, pa.int64())
    steps = pa.table({"ka": z(1, 1, 2), "kb": z(1, 1, 2), "pa": z(0, 0, 0), "pb": z(0, 0, 0), "depth": z(1, 1, 1), "words": z(2, 2, 2), "c": z(5, 4, 6),
                      "th": pa.array([b"a" * 32, b"b" * 32, b"c" * 32])})
    got = {r["ka"]: (r["n"], r["conv"], r["clash"]) for r in trie.counted(steps).to_pylist()}
    assert got == {1: (2, 4, True), 2: (1, 6, False)}
