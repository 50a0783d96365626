"""The Jaccard join, components and the pipeline against brute force."""

import collections
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from prepkit.llm import graph, jaccard
from prepkit.llm.bpe import encoder, vocabulary_path
from tests.conftest import rows


def _sets(texts):
    out = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def _brute(texts):
    sets = [(i, s) for i, own in _sets(texts).items() for s in own]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return sorted((i, len(s), root(i)) for i, s in sets)


def _corpus():
    rng = random.Random(7)
    word = lambda: rng.choice(["alpha", "Beta", "gamma,", "delta", "é", "x1"]) + str(rng.randint(0, 60))
    passage = [word() for _ in range(40)]
    base = [word() for _ in range(120)]
    texts = []
    for i in range(60):
        texts.append([word() for _ in range(rng.randint(1, 90))] + (passage if i % 2 else []))
    for _ in range(70):  # near copies of one text, of which some link only through others
        own = list(base)
        for _ in range(rng.randint(0, 5)):
            own[rng.randrange(len(own))] = word()
        texts.append(own)
    for k in range(12):  # a chain
        texts.append(base[: 100 - 6 * k] + [f"c{k}{n}" for n in range(6 * k)])
    texts += [[w] for w in ("one", "one", "two")] + [passage] * 5 + [passage[:4]] * 2
    out = [" ".join(t) if n % 3 else "\n\t".join(t).upper() for n, t in enumerate(texts)]
    out += [None, "", "  \n", "only four words here", "ONLY four\twords here", "huge text " * 20_000]
    data = list(enumerate(out))
    rng.shuffle(data)
    return data


@pytest.mark.parametrize("frequent", [0, 500_000])
def test_components_of_texts(docs, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT_TOKENS", frequent)
    data = _corpus()
    df = docs([(i, t, "s") for i, t in data] + [(5, dict(data)[5], "s")])
    got = rows(jaccard.jaccard_components(df.withColumn("component_id", F.lit("clash"))), "doc_id")
    assert got == _brute([*data, (5, dict(data)[5])])
    left = rows(jaccard.one_of_each(df).select("doc_id"), "doc_id")
    assert [r[0] for r in left] == sorted({c for _, _, c in got})
    assert jaccard.jaccard_components(df.where("false")).count() == 0


def test_bounds():
    rng = random.Random(8)
    import numpy as np

    for _ in range(300):
        pool = [rng.getrandbits(63) for _ in range(rng.randint(2, 300))]
        x = np.unique(np.array([t for t in pool if rng.random() < 0.9] or pool[:1], np.int64))
        y = np.unique(np.array([t for t in pool if rng.random() < 0.9] or pool[:1], np.int64))
        bx, by = jaccard.parity_bitmap(x), jaccard.parity_bitmap(y)
        while len(bx) > len(by):
            bx = bx[: len(bx) // 2] ^ bx[len(bx) // 2 :]
        while len(by) > len(bx):
            by = by[: len(by) // 2] ^ by[len(by) // 2 :]
        assert sum(int(v).bit_count() for v in (bx ^ by).view(np.uint64)) <= len(np.setxor1d(x, y))
        shared = len(np.intersect1d(x, y))
        if 100 * shared >= 80 * (len(x) + len(y) - shared):
            small, large = sorted((x, y), key=len)
            assert set(small[: jaccard.index_length(len(small))].tolist()) & set(large[: jaccard.probe_length(len(large))].tolist())


def test_folded_bitmaps(spark):
    import numpy as np

    sets = [np.arange(k, k + 5000, dtype=np.int64) * 7919 for k in (0, 40, 4000)]
    df = spark.createDataFrame([(i, [int(v) for v in jaccard.parity_bitmap(s)]) for i, s in enumerate(sets)], "i int, bits array<long>")
    short = {r.i: np.array(r.b, np.int64) for r in df.select("i", jaccard._short("bits").alias("b")).collect()}
    for i, s in enumerate(sets):
        whole = jaccard.parity_bitmap(s)
        while len(whole) > jaccard.CARRIED_WORDS:
            whole = whole[: len(whole) // 2] ^ whole[len(whole) // 2 :]
        assert (short[i] == whole).all()


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)] + [(5000, 5000 + k) for k in range(200)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            p, q = sorted((root(a), root(b)))
            parent[q] = p
    got = rows(graph.components(spark.createDataFrame(edges, "a long, b long")), "node")
    assert got == sorted((x, root(x)) for x in parent)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pipeline_stages(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    before = {r.doc_id: r.text for r in docs.collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert out.columns == docs.columns, name
            now = {r.doc_id: r.text for r in out.collect()}
            assert set(now) <= set(before)
            assert out.where("n_chars <> length(text)").count() == 0
        if k == 0:
            assert 0.5 * len(before) < len(now) and all(now[i] == before[i] for i in now)
        if k == 1:
            assert set(now) == set(before) and all(set(now[i].split("\n")) <= {*before[i].split("\n"), ""} for i in now)
        if k == 2:
            assert sorted(now) == sorted({c for _, _, c in _brute(list(before.items()))})
        if k == 3:
            assert set(now) == set(before)
            assert all(re.fullmatch(re.escape(now[i]).replace(re.escape("[REDACTED]"), "(?s:.+)"), before[i]) for i in now)
        if k == 4:
            lengths = collections.Counter()
            for r in out.collect():
                lengths[r.doc_id] += r.length
            ids = encoder(vocabulary_path())
            assert lengths == {i: len(ids.ids([t])[0]) // 4 + 1 for i, t in before.items()}
        if k < 4:
            docs, before = out, now
    assert "pipeline" in __spark_entry__.queries() and len(corpus_pipeline.STAGES) == 5


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_nothing_else_imports_the_subpackage():
    top = Path(corpus_pipeline.__file__).parent
    for p in [*top.glob("prepkit/**/*.py"), *top.glob("checks/*.py")]:
        if "llm" not in p.relative_to(top).parts:
            assert "llm" not in p.read_text(), p
