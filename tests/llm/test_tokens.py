import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prepkit.llm.bpe import PieceEncoder, encoder, vocabulary_path
from prepkit.llm.packing import best_fit_pack, fullest, minimum_bin_slack
from prepkit.llm.tokencount import count_spliced, token_counts
from tests.conftest import rows

ODD = ["a", "bc", " ", "  ", "\n", "\t", "'s", "1", "é", "!", " ", "日", "zzzz", "<|endoftext|>"]
TEXTS = ["", None, "one two\nthree", "  lead", "tail \n\n x", "a\tb", "<|endoftext|> in <|endoftext|>", "😀 it's 'll 123 4567", "x" * 3000, "word " * 2000]


@pytest.fixture(scope="module")
def enc():
    return encoder(vocabulary_path())


def _ids(enc, text):
    return enc.library.encode(text, add_special_tokens=False).ids


def test_pieces_are_the_librarys(enc):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    small = PieceEncoder(vocabulary_path(), kept=20)  # the dictionary starts again all the time
    for got in (enc.ids(texts), [small.ids([t])[0] for t in texts[:300]]):
        for text, ids in zip(texts, got, strict=False):
            assert np.frombuffer(ids, "<u4").tolist() == _ids(enc, text), text


def test_pieces_with_punctuation_are_the_librarys():
    rng = random.Random(7)
    parts = ["don't", "'s", "'S.", "'ll", "...", "!'", "a.'s", "_x_", "word", "Word", "ñandú", "日本", "\u0251", "\u1c89", "٣", "²", "\u0301", "<|", "|>", "\u00a0", "\t", "\u0120a", "é,", "7%", "$", "--", "😀", "\r", "\x1c", "\x85", "\u2028", "\ufeff"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", "", " ", "\n", "."]) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    for kept in (30, 400_000):
        fresh = PieceEncoder(vocabulary_path(), kept=kept)
        for k in range(0, len(texts), 100):
            for text, ids in zip(texts[k : k + 100], fresh.ids(texts[k : k + 100]), strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == _ids(fresh, text), text


def test_a_stem_is_encoded_once(monkeypatch):
    fresh, given = PieceEncoder(vocabulary_path()), []
    block = PieceEncoder._encode_block
    monkeypatch.setattr(PieceEncoder, "_encode_block", lambda self, pieces, lead: given.extend(pieces) or block(self, pieces, lead))
    (ids,) = fresh.ids(["on stem stem. stem, stem;) stem"])
    assert sorted(p.strip() for p in given) == ["on", "stem"] and np.frombuffer(ids, "<u4").tolist() == _ids(fresh, "on stem stem. stem, stem;) stem")


def test_spliced_counts(enc):
    rng = random.Random(4)
    for _ in range(400):
        text = "".join(rng.choice(ODD[:-1]) for _ in range(rng.randint(1, 80)))
        assert count_spliced(enc.library, text, rng.randint(1, 12), rng.randint(1, 6)) == len(_ids(enc, text))
    long = "a" * 5000 + " b" * 40 + "c" * 3000  # pre-tokens longer than the overlap, and than the chunk
    assert count_spliced(enc.library, long, 200, 10) == len(_ids(enc, long))


def test_token_counts(docs, enc):
    df = docs([(i, t, "s") for i, t in enumerate(TEXTS)]).withColumn("n_tokens", F.lit("clash"))
    got = {r.doc_id: r for r in token_counts(df, vocabulary_path(), limit=100, huge=1000, chunk=300, overlap=20).collect()}
    for i, t in enumerate(TEXTS):
        n = len(_ids(enc, t or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit, got[i].source) == (len((t or "").encode()), n, n > 100, "s")
    assert token_counts(df.where("false"), vocabulary_path()).count() == 0


def test_fullest_combination():
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randint(1, 20): rng.randint(0, 4) for _ in range(5)}
        room, sums = rng.randint(0, 40), {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1)}
        used = fullest(counts, room)
        assert all(c <= counts[n] for n, c in used.items())
        assert sum(n * c for n, c in used.items()) == max(s for s in sums if s <= room)


def test_bins_hold_every_piece_once():
    rng = random.Random(6)
    histogram = {n: rng.randint(1, 300) for n in range(1, 45)} | {64: 500}
    bins, seen = {}, dict.fromkeys(histogram, 0)
    for p in minimum_bin_slack(histogram, 64):
        assert p.rank == seen[p.length]
        after = [q.rank for q in minimum_bin_slack(histogram, 64) if q.length == p.length and q.rank > p.rank]
        n = (min(after) if after else histogram[p.length]) - p.rank
        for j in range(n):
            bins.setdefault(p.bin + j // p.each, []).append((p.offset + j % p.each * p.length, p.length))
        seen[p.length] += n
    assert seen == histogram
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64
    total = sum(n * c for n, c in histogram.items())
    assert len(bins) <= -(-total // 64) + 3


def test_packing(docs, enc):
    texts = TEXTS + ["some words here " * k for k in range(1, 40)] + ["same text"] * 5
    df = docs([(i, t, "s") for i, t in enumerate(texts)] + [(0, "", "s")])
    got = rows(best_fit_pack(df, vocabulary_path(), capacity=64), "doc_id", "piece")
    names = ["doc_id", "piece", "start", "length", "crc", "bin", "offset"]
    found = [dict(zip(names, r, strict=True)) for r in got]
    bins = {}
    for i, t in enumerate(texts):
        ids = np.array([*_ids(enc, t or ""), 2], "<u4")
        own = [r for r in found if r["doc_id"] == i]
        if i == 0:  # this row is there twice
            assert len(own) == 2
            own = own[:1]
        assert sum(r["length"] for r in own) == len(ids)
        assert len(own) == -(-len(ids) // 64) and all(r["length"] == 64 for r in own[1:])
        for r in own:
            assert r["crc"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for r in found:
        bins.setdefault(r["bin"], []).append((r["offset"], r["length"]))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r["length"] for r in found) // 64) + 1
    assert best_fit_pack(df.where("false"), vocabulary_path()).count() == 0
