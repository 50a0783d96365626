"""Line dedup, secret scans and archives against plain Python, with odd rows."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prepkit.llm import jaccard, linededup, secretscan, warc
from prepkit.llm.common import fresh_path
from tests.conftest import rows

LINES = [f"line number {i} of the set" for i in range(12)] + ["", "  ", "é tail"]


def _python_chunks(docs):
    """Of each document: chunks, and those of two lines and more that stand before."""
    h = lambda line: int(hashlib.md5(line.encode()).hexdigest()[:8], 16)
    seen, out = set(), {}
    for i, text in sorted(docs.items()):
        lines = (text or "").split("\n")
        at = [k for k, line in enumerate(lines) if re.search(r"[^ \t-\r]", line)]
        hs = [h(lines[k]) for k in at]
        rolled = [x + 31 * (hs[k - 1] if k else 0) for k, x in enumerate(hs)]
        ends = [k for k in range(len(at)) if k == len(at) - 1 or (k and rolled[k] < rolled[k - 1] and rolled[k] <= rolled[k + 1])]
        gone = []
        for a, b in zip([0, *(e + 1 for e in ends)], ends):
            body = "\n".join(lines[at[a] : at[b] + 1])
            if a < b and body in seen:
                gone.append(at[b] - at[a] + 1)
            seen |= {body} if a < b else set()
        out[i] = (len(ends), len(gone), sum(gone))
    return out


def test_boundaries_resist_shifts(docs):
    passage = "\n".join(f"shared passage, line {i}" for i in range(30))
    df = docs([(1, passage, "s"), (2, "new first line\nanother\n" + passage, "s"), (3, passage + "\nlast", "s")])
    got = {r.doc_id: r for r in linededup.drop_repeated_chunks(df).collect()}
    assert (got[1].lines_removed, got[2].lines_removed, got[3].lines_removed) == (0, 30, 30)
    assert got[2].text == "new first line\nanother" and got[3].text == "last"
    assert min(got[2].chunk_lines, got[3].chunk_lines) >= 20  # most of them through chunks


def _python_runs(docs, long_words=50):
    seen, out = {}, {}
    for i, text in sorted(docs.items()):
        lines, gone = (text or "").split("\n"), set()
        at = [k for k, line in enumerate(lines) if re.search(r"[^ \t-\r]", line)]
        for a, b in sorted([*zip(at, at[1:]), *((k, k) for k in at if len(lines[k].split()) >= long_words)]):
            doc, last = seen.setdefault("\n".join(lines[a : b + 1]), (i, b))
            if (doc, last) != (i, b):
                gone |= set(range(last + 1 if doc == i and a <= last else a, b + 1))
        out[i] = (None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
    return out


def test_repeated_runs(docs):
    rng = random.Random(3)
    many = [*LINES, "\t", " ".join(["word"] * 50), " ".join(["word"] * 49)]
    texts = {i: "\n".join(rng.choice(many) if rng.random() < 0.3 else f"own {rng.random()}" for _ in range(rng.randint(1, 20))) for i in range(80)}
    texts |= {90: "blank\n\n \n\t\n\nlines", 91: "others\n\n \n\t\n\nstay", 80: None, 81: "", 82: "single", 83: "\n".join(LINES), 84: "\n\n\n\n", 85: "\n".join(LINES * 300), 86: "same\nsame\nsame\nsame"}
    df = docs([(i, t, "s") for i, t in texts.items()]).withColumn("n_lines", F.lit("clash"))
    out = linededup.drop_repeated_chunks(df).collect()
    got = {r.doc_id: (r.text, r.lines_removed) for r in out}
    assert got == _python_runs(texts)
    assert {r.doc_id: (r.n_chunks, r.chunks_removed, r.chunk_lines) for r in out} == _python_chunks(texts)
    assert got[86] == ("same\nsame", 2) and sum(lost for _, lost in got.values()) > 100
    twice = docs([(1, texts[83], "s"), (1, texts[83], "s"), (2, texts[83], "s"), (None, texts[83], "s")])
    assert sorted(r.lines_removed for r in linededup.drop_repeated_chunks(twice).where("doc_id > 0").collect()) == [15, 15, 15]
    assert linededup.drop_repeated_chunks(df.where("false")).count() == 0


def test_short_passages_go_completely(docs):
    passages = [[f"passage {p}, line {k}" for k in range(n)] for n in (2, 3, 4, 5) for p in [n, 10 + n, 20 + n]] + [[" ".join(["long"] * 50)]]
    own = lambda d: [f"own {d} {k}" for k in range(3)]
    data = [(d * 100 + p, "\n".join([*own((d, p, 0)), *lines, *own((d, p, 1))]), "s") for p, lines in enumerate(passages) for d in range(3)]
    left = {r.doc_id: r.text for r in corpus_pipeline.lines(docs(data).sparkSession, docs(data), "").collect()}
    assert all(left[i] == (text if i < 100 else "\n".join(own((i // 100, i % 100, 0)) + own((i // 100, i % 100, 1)))) for i, text, _ in data)


# The base patterns as the task gives them.
BASE = [("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+")]


def _base_spans(text):
    out = []
    for place, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text, re.I | re.A if kind == "assign" else 0):
            if len(m[2]) >= 8 if kind == "assign" else len(m[0]) >= (16 if kind == "access" else 32):
                out.append((m.start(), place, kind, m.end()))
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


HEX, KEY = "0123456789abcdef" * 3, "AKIA" + "Z9X8" * 5
SECRETS = [
    None, "", f'😀 Token = "{HEX}" and {KEY}.', f"AKIA{KEY}", "password: short", "password: token=abcdefghij", "API_KEY='aaaaaaaaa' apikey:bbbbbbbbb",
    "secret=secret=secret=abc", f"é{HEX}é{HEX}", "TOKEN:   x.y-z_1234=", f"{HEX} {KEY} passwd={KEY}", "AKIAAKIAAKIAAKI", "token=\"\" token=12345678",
    "a live one Zx9Qw8Er7Ty6Ui5Op4As3 here", "many copy Aa1Bb2Cc3Dd4Ee5Ff6Gg7Hh8 this", "x" * 5000 + f" token={HEX}" * 200,
]


def test_secret_scan(docs):
    rng = random.Random(2)
    parts = ["token", "=", " ", '"', "AKIA", "ABCDEFGH12345678", "deadbeef" * 4, "password", ":", "é", "\n", "'", "abcdefgh", "api_key"]
    texts = SECRETS + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 25))) for _ in range(200)]
    data = [(i, t, f"s{i % 7}") for i, t in enumerate(texts)] + [(900 + k, SECRETS[14], f"s{k}") for k in range(5)] + [(0, None, "s")]
    got = {r.doc_id: r for r in secretscan.secret_scan(docs(data)).collect()}
    for i, text, _ in data:
        want = _base_spans(text or "")
        assert [s for s in got[i].spans.split(",") if s and not s.startswith("owned")] == want, text
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(s.startswith(k) for s in want) for k, _ in BASE)
    assert got[13].spans == "owned:11:32" and got[13].n_owned == 1  # of one owner
    assert got[14].spans == "" and got[900].spans == ""  # of many
    assert secretscan.secret_scan(docs(data).where("false")).count() == 0


def test_owners_and_repositories(docs):
    """One owner with many repositories, several owners, and documents without a source or an id."""
    keys = [f"Zx9Qw8Er7Ty6Ui5Op4As{k}" for k in range(5)]
    data = [(100 + k, f"a {keys[0]} b", "hot") for k in range(9)] + [(200 + k, f"a {keys[1]} b", "hot") for k in range(10)]
    data += [(300 + k, f"a {keys[2]} b", None) for k in range(2)] + [(400 + k, f"a {keys[3]} b", None) for k in range(3)]
    data += [(None, f"c {keys[4]} d {k}", None) for k in range(4)]
    got = {}
    for r in secretscan.secret_scan(docs(data)).collect():
        got.setdefault(r.doc_id and r.doc_id // 100, set()).add((r.n_owned, r.n_live, r.most_repos, r.most_owners))
    assert got == {1: {(1, 1, 9, 1)}, 2: {(0, 0, 0, 0)}, 3: {(1, 1, 2, 2)}, 4: {(0, 0, 0, 0)}, None: {(1, 1, 1, 1)}}
    texts = {r.doc_id: r.text for r in secretscan.redact(docs(data)).where("doc_id IS NOT NULL").collect()}
    assert texts[100] == "a [REDACTED] b" and texts[200] == f"a {keys[1]} b" and texts[400] == f"a {keys[3]} b"


HELPERS = ["_id", "_th", "_gid", "_gth", "_fid", "_fth", "_kid", "_kth", "_lines", "_at", "_ends", "_chunks", "_cuts", "_text", "_label", "own_0", "gone", "cuts", "h", "a.b"]


@pytest.mark.parametrize("operator", [linededup.drop_repeated_chunks, secretscan.redact, jaccard.one_of_each])
def test_helper_names_clash(docs, operator):
    text = "\n".join(LINES)
    data = [(1, text, "s"), (2, text + "\nmore", "s"), (2, text + "\nmore", "s"), (None, f"x token={HEX} y", "s"), (3, None, None)]
    plain = docs(data)
    df = plain.select("*", *(F.lit(f"{k} kept").alias(c) for k, c in enumerate(HELPERS)))
    out = operator(df)
    assert out.columns[: len(df.columns)] == df.columns
    assert {tuple(r)[5 : 5 + len(HELPERS)] for r in out.collect()} == {tuple(f"{k} kept" for k in range(len(HELPERS)))}
    assert sorted(map(str, out.select("doc_id", "text").collect())) == sorted(map(str, operator(plain).select("doc_id", "text").collect()))
    assert operator(df.where("false")).count() == 0


def test_redaction(docs):
    copied = f"token={HEX}"
    df = docs([(1, f"a {KEY} b token={KEY[4:]}Q c", "s1"), (2, None, "s2"), (3, "", "s3"), (4, "clean", "s4")] + [(10 + k, copied, f"s{k}") for k in range(4)])
    got = {r.doc_id: r.text for r in secretscan.redact(df).collect()}
    assert got[1] == "a [REDACTED] b [REDACTED] c"
    assert (got[2], got[3], got[4], got[10]) == (None, "", "clean", copied)
    assert secretscan.redact(df).columns == df.columns


@pytest.fixture
def pages(spark):
    html = {0: None, 1: "", 2: "<p>é</p>", 3: "<p>é</p>", 4: "x" * 3_000_000, 5: "<p>é</p>", 6: "\r\n\r\nWARC/1.1\r\n\r\n", 7: "y", 8: "y"}
    data = [(i, None if i == 2 else f"http://h/{i}\r\nX: y", h, "clash") for i, h in html.items()]
    return spark.createDataFrame([*data, (7, "u", "y", "clash")], "page_id long, url string, html string, record_type string").repartition(3)


def test_archives(spark, pages):
    got = {(r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.warc_round_trip(pages).collect()}
    want = {(0, "revisit", 1, 0), (1, "response", None, 0), (2, "revisit", 5, 9), (3, "revisit", 5, 9), (5, "response", None, 9), (4, "response", None, 3_000_000),
            (6, "response", None, 16), (7, "revisit", 8, 1), (8, "response", None, 1)}
    assert got == want
    assert warc.warc_round_trip(pages.where("false")).count() == 0
    small = {(r.page_id, r.record_type) for r in warc.warc_round_trip(pages, least=5).collect()}
    assert {(0, "response"), (7, "response"), (2, "revisit")} <= small


def test_members_stand_alone(spark, pages):
    folder = fresh_path(spark, "test")
    out = warc.normalise(warc.write_archives(pages, folder), folder).collect()
    assert sum(r.records for r in out) == 10
    for r in out:
        for line in b"".join(warc._read_chunks(r["index"])).splitlines():
            offset, size, name = line.split(b" ")
            one = list(warc.records(warc.inflated(warc._read_chunks(r.path, int(offset), int(size)))))
            assert len(one) == 1 and warc.head(one[0])[0]["warc-record-id"].encode() == name


def test_inflate_and_split():
    data = [warc.record(i, "u", bytes([i]) * (i * 1000), "D", None) for i in range(30)]
    import gzip

    whole = gzip.compress(b"".join(data[:10])) + gzip.compress(b"".join(data[10:]))
    for step in (1, 7, 4096, len(whole)):
        parts = (whole[i : i + step] for i in range(0, len(whole), step))
        assert list(warc.records(warc.inflated(parts))) == data
    with pytest.raises(ValueError):
        list(warc.records(iter([data[3][:-1]])))


def test_products_beyond_64_bits(spark):
    from prepkit.llm import topk

    data = [(0, [1e9, 1e9]), (1, [1e9, 2.0]), (2, [-1e12, -1e12]), (3, [1e15, 1e15]), (4, [1e15, 2e15]), (50, [-1.0, 0.5]), (7, [1e300, 0.0]), (8, [float("nan"), 1.0])]
    got = rows(topk.top_inner_products(spark.createDataFrame(data, "vec_id long, embedding array<double>")), "query_id", "rank")
    v = {i: [min(max(math.floor(256 * x), -(2**63)), 2**63 - 1) for x in e] for i, e in data if i != 8}
    for q in (0, 50):
        score = {i: min(max(sum(a * b for a, b in zip(v[q], e, strict=True)), 1 - 2**63), 2**63 - 1) for i, e in v.items() if i != q}
        best = sorted(score, key=lambda i: (-score[i], i))[:5]
        assert [tuple(r) for r in got if r[0] == q] == [(q, k + 1, i, score[i]) for k, i in enumerate(best)]
