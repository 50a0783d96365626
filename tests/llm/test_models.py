"""Quality rules, toxicity, sampled segmentations and exact top-k against brute force or held-out labels."""

import collections
import math
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepkit.llm import lattice, quality, topk, toxicity
from prepkit.llm.bpe import vocabulary_path
from prepkit.llm.codepoints import words
from tests.conftest import rows

LABELLED = "/root/testdata/sf0.01"


def _brute_counts(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_base_counts():
    rng = random.Random(1)
    parts = ["a", "b", "#", " ", "\n", "\t", " ", "é", "c d e f g", "\x7f", " ", "|", "\x1c", "\x85", " a b a b a b a ", "x y\n"]
    for text in ["", *("".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(1500))]:
        assert quality.base_counts(text, words(text)) == _brute_counts(text), text


@pytest.fixture(scope="module")
def labelled(spark):
    d = LABELLED if os.path.isdir(LABELLED) else "/root/testdata/sf0.001"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_quality_on_labels_it_has_not_seen(spark, labelled):
    docs, labels = labelled
    seen = labels.where("doc_id % 3 <> 0")
    out = quality.quality_rules(docs, seen).join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id").where("doc_id % 3 = 0 AND NOT base_failed").collect()
    assert np.mean([(r.quality >= 0.5) == bool(r.label) for r in out]) > 0.95


def test_quality_of_odd_rows(docs, labelled):
    good = "these are some plain words that follow each other without any junk in them at all"
    df = docs([(1, None, "s"), (2, "", "s"), (3, good, "s"), (3, good, "s"), (4, "ha " * 50, "s"), (5, good * 3000, "s")]).withColumn("kept", F.lit("clash"))
    none = labelled[1].where("false")
    got = {r.doc_id: (r.n_words, r.base_failed, r.quality, r.kept) for r in quality.quality_rules(df, none).collect()}
    assert got[1] == got[2] == (0, True, None, False) and got[3] == (16, False, None, True)
    assert got[4][1] and not got[4][3] and got[5][1]
    assert quality.quality_rules(df.where("false"), none).count() == 0


def test_platt_recovers_a_curve():
    rng = np.random.default_rng(2)
    x = rng.normal(0, 2, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-(1.5 * x - 0.5)))).astype(float)
    slope, shift = quality.platt(x, y)
    assert abs(slope - 1.5) < 0.1 and abs(shift + 0.5) < 0.1


def _brute_segments(score):
    total = np.concatenate([[0], np.cumsum(score)])

    def best(a, b):
        top = max(((total[j] - total[i], -i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if top[0] <= 1e-9:
            return []
        i, j = -top[1], top[2]
        return [*best(a, i), (i, j), *best(j, b)]

    return best(0, len(score))


def test_all_maximal_segments():
    rng = random.Random(3)
    for _ in range(200):
        score = np.array([rng.choice([-3.1, -1.37, -0.513, 1.117, 2.71, 0.719]) * (1 + rng.random()) for _ in range(rng.randint(0, 16))])
        assert sorted((a, b) for a, b, _ in toxicity.segments(score)) == sorted(_brute_segments(score))


def test_toxicity(spark, docs):
    rng = random.Random(4)
    bad = ["grobble", "snarfle", "quibwit"]
    data = []
    for i in range(900):
        text = [rng.choice(["plain", "text", "with", "other", "words", "in", "it", f"w{rng.randint(0, 400)}"]) for _ in range(rng.randint(20, 200))]
        if i % 8 == 0:
            for _ in range(4):
                text.insert(rng.randint(0, len(text)), rng.choice(bad))
        data.append((i, " ".join(text), "s"))
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(900)], "doc_id long, toxic int")
    df = docs([*data, (1000, None, "s"), (1001, "", "s"), (1002, "Grobble, snarfle: QUIBWIT! " * 3000, "s"), (0, data[0][1], "s")])
    got = {r.doc_id: r for r in toxicity.toxicity(df.withColumn("score", F.lit("clash")), labels).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id < 900]
    assert 200 < len(held) < 400
    assert np.mean([r.predicted == int(r.doc_id % 8 == 0) for r in held]) > 0.97
    assert got[1002].predicted == 1 and got[1000].predicted == got[1001].predicted == 0 and got[1000].passages == []
    text = dict((i, t) for i, t, _ in data)
    assert all(any(w in text[r.doc_id][p.begin : p.end] for w in bad) for r in held for p in r.passages if r.predicted)
    # no label of a held-out row is read
    import zlib
    other = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: (r.score, r.held_out) for r in toxicity.toxicity(df, other).collect()}
    assert again == {i: (r.score, zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items()}
    assert {r.score for r in toxicity.toxicity(df, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.toxicity(df.where("false"), labels).count() == 0


@pytest.fixture(scope="module")
def lat():
    return lattice.Lattices(lattice.Vocabulary(vocabulary_path("piece_bpe_32k.model")), 0.5)


def _all_segmentations(v, text):
    data, bytes_ = text.encode(), set(v.byte_ids.tolist())
    pieces = {v.text[i]: i for i in range(len(v.text)) if v.text[i] and i not in bytes_}
    out = []

    def go(at, ids):
        if at == len(data):
            return out.append(ids)
        n = 1
        while at + n < len(data) and (data[at + n] & 0xC0) == 0x80:
            n += 1
        for e in range(at + n, len(data) + 1):
            if data[at:e] in pieces:
                go(e, [*ids, pieces[data[at:e]]])
        if data[at : at + n] not in pieces:
            go(at + n, [*ids, *(int(v.byte_ids[b]) for b in data[at : at + n])])

    go(0, [])
    return out


def test_samples_survive_dropped_words(monkeypatch):
    def run():
        lat = lattice.Lattices(lattice.Vocabulary(vocabulary_path("piece_bpe_32k.model")), 0.5)
        out, rng = [], np.random.default_rng(3)
        for a in range(12):
            texts = [lat.v.library.normalize(" ".join(f"w{x} große" for x in rng.zipf(1.5, 30) % 90)) for _ in range(8)]
            for group, text in zip(lattice.sample_texts(lat, texts, list(range(8 * a, 8 * a + 8)), 2), texts, strict=True):
                assert lattice.round_trips(lat.v, [ids for ids, *_ in group], [text] * len(group)) == [True] * len(group)
                out += [(ids.tolist(), *rest) for ids, *rest in group]
        return out, len(lat.first)

    whole, words = run()
    for words_kept, edges_kept in ((words // 2, 10**9), (10**9, 300), (1, 1)):
        monkeypatch.setattr(lattice, "KEPT_WORDS", words_kept)
        monkeypatch.setattr(lattice, "KEPT_EDGES", edges_kept)
        fewer, left = run()
        assert fewer == whole and left < words


def test_round_trips_tell_other_texts():
    v = lattice.vocabulary(vocabulary_path("piece_bpe_32k.model"))
    ids = [np.array(v.library.encode(t), np.int64) for t in ("one two", "", "three")]
    normal = [lattice.decoded(v, x) for x in ids]
    assert lattice.round_trips(v, ids, normal) == [True] * 3
    assert lattice.round_trips(v, ids, [normal[0] + "x", "", normal[2][:-1]]) == [False, True, False]
    assert lattice.round_trips(v, [], []) == []


@pytest.mark.parametrize("text", ["ab cd", "héllo", "a  b", "日𐍈x", "\n \n"])
def test_samples_are_the_lattices(lat, text):
    normal = lat.v.library.normalize(text)
    paths = _all_segmentations(lat.v, normal)
    weight = np.array([0.5 * sum(lat.v.score[i] for i in p) for p in paths])
    share = {tuple(p): w for p, w in zip(paths, np.exp(weight) / np.exp(weight).sum(), strict=True)}
    every = lattice.sample_texts(lat, [normal], [7], 10_000)[0]
    assert sorted(tuple(x[0].tolist()) for x in every) == sorted(share)  # all of them, none twice
    assert all(math.exp(x[1]) == pytest.approx(share[tuple(x[0].tolist())], rel=1e-6) and x[3] == 0 for x in every)
    assert all(a[2] >= b[2] for a, b in zip(every, every[1:], strict=False))
    n = 3000
    drawn = lattice.sample_texts(lat, [normal] * n, list(range(n)), 2)
    firsts = collections.Counter(tuple(x[0][0].tolist()) for x in drawn)
    estimate = collections.Counter()
    for x in drawn:
        for ids, _, _, inclusion in x:
            estimate[tuple(ids.tolist())] += 1 / n / math.exp(inclusion) * share[tuple(ids.tolist())]
    for p, s in share.items():
        assert abs(firsts[p] / n - s) < 5 * math.sqrt(s * (1 - s) / n) + 1e-3
    assert sum(estimate.values()) == pytest.approx(1, abs=0.05)  # inclusion scores weigh samples right


def test_sampling_rows(docs, lat):
    path = vocabulary_path("piece_bpe_32k.model")
    texts = [None, "", "a", "some words here", "it's 日本 😀\n\n x", "lorem ipsum " * 3000]
    df = docs([(i, t, "s") for i, t in enumerate(texts)] + [(3, texts[3], "s")]).withColumn("sample", F.lit("clash"))
    out = lattice.sample_segmentations(df, path, k=3)
    got = sorted(out.collect(), key=lambda r: (r.doc_id, r.sample))
    assert all(r.round_trip for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert [r.ids for r in by[0] + by[1]] == [[], []] and len(by[3]) == 6 and len({tuple(r.ids) for r in by[3]}) == 3
    again = {(r.doc_id, r.sample): r for r in lattice.sample_segmentations(df.repartition(7), path, k=3).collect()}
    assert all(again[r.doc_id, r.sample] == r for r in got)  # draws don't depend on partitions
    text = {(r.doc_id, r.text) for r in lattice.decode_segmentations(out, path).collect()}
    assert text == {(i, t or "") for i, t in enumerate(texts)}
    library = lat.v.library
    assert all(library.decode(r.ids) == texts[r.doc_id] for r in by[3] + by[5])
    assert lattice.sample_segmentations(df.where("false"), path).count() == 0


def _brute_top(data, every, k):
    v = {}
    for i, x in data:
        if x is not None and all(c is not None and math.isfinite(c) for c in x):
            v.setdefault(i, []).append([math.floor(256 * c) for c in x])
    out = []
    for q in sorted(v):
        if q % every == 0:
            scored = [(-sum(a * b for a, b in zip(v[q][0], c, strict=False)), i) for i, own in v.items() for c in own if i != q]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return out


@pytest.mark.parametrize("block", [16, 4096])
def test_top_inner_products(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = random.Random(5)
    data = [(i, [float(np.float32(rng.gauss(0, 0.3) * (1 + i % 5))) for _ in range(8)]) for i in range(150)]
    data += [(200 + i, data[3][1]) for i in range(20)] + [(300, None), (301, [1.0, None] * 4), (302, [float("nan")] * 8), (303, [float("inf")] * 8), (304, [0.0] * 8), (305, [2.0] * 3)]
    data += [(7, data[7][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash")).repartition(4)
    got = rows(topk.top_inner_products(df, every=10), "query_id", "rank")
    assert got == _brute_top(data, 10, 5)
    few = df.where("vec_id IN (0, 1, 302)")
    assert len(rows(topk.top_inner_products(few, every=10))) == 1
    assert topk.top_inner_products(df.where("false")).count() == 0


def test_queries_of_one_id(spark):
    rng = random.Random(6)
    data = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(40)]
    data += [(10, [-x for x in data[10][1]]), (20, data[20][1]), (20, data[20][1]), (30, [rng.gauss(0, 1) for _ in range(6)])]
    v = [(i, [math.floor(256 * c) for c in x]) for i, x in data]
    want = []
    for q in (0, 10, 20, 30):  # as the SQL: every row of the id with every row of another
        scored = sorted((-sum(a * b for a, b in zip(x, c, strict=True)), i) for own, x in v if own == q for i, c in v if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:5])]
    for parts in (1, 7):
        df = spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(parts)
        assert rows(topk.top_inner_products(df, every=10), "query_id", "rank") == want
