"""Sampled SentencePiece segmentations without replacement: Gumbel top-k by perturbed A-star over the lattice.

The lattice of a text has a node a byte and an edge a piece. A hypothesis is a prefix of edges; its bound is the
largest Gumbel-perturbed log-probability below it, drawn top down so that the best child of a hypothesis keeps
its bound and the others get Gumbels truncated at it. The hypothesis of the highest bound is opened
next, so that whole segmentations come out by descending perturbed score, all distinct. The siblings of a step
stay in the agenda as one group with one bound, and part only when it is opened.

Pieces don't go past the start of a word, so a text's lattice is a chain of its words' lattices: each distinct
word's edges and probabilities are made once, and steps of all words of a batch are drawn together. Draws are a
hash of the row's key, the sample, the word and the step, so that they don't depend on partitions or batches.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from prepkit.llm.codepoints import mixed
from prepkit.llm.common import texts_of

SPACE = "▁"
#: Words, and edges of 28 bytes, whose lattices a worker keeps beyond the batch at hand.
KEPT_WORDS = 300_000
KEPT_EDGES = 6_000_000
#: Step of the counters of which the draws are hashes.
STEP = np.uint64(0xD1342543DE82EF95)
#: Log-probability by which bytes of unknown characters lie below the rarest piece.
BYTE_PENALTY = 10.0
_UNITS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Vocabulary:
    """Pieces of a SentencePiece model as a byte trie, with log-probabilities.

    A unigram model's scores are log-probabilities. A BPE model's scores are merge ranks; they are read by
    Zipf's law: the piece of rank r has a probability in proportion to 1 / (r + 1).
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_ids = np.full(256, -1, np.int64)
        plain = []
        for i in range(n):
            if sp.is_byte(i):
                self.byte_ids[int(sp.id_to_piece(i)[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                plain.append(i)
        score = np.array([sp.get_score(i) for i in plain])
        if len(score) and np.array_equal(score, np.round(score)):
            score = -np.log(1.0 - np.minimum(score, 0))
            score -= np.log(np.exp(score).sum())
        self.score = np.full(n, score.min(initial=0.0) - BYTE_PENALTY)
        self.score[plain] = score
        self.unknown = sp.unk_id()
        pieces = {i: sp.id_to_piece(i) for i in plain}
        self.inner_space = any(SPACE in p.lstrip(SPACE) for p in pieces.values())
        self.inner_break = any("\n" in p and p != "\n" for p in pieces.values())
        self.text = [b""] * n  # what an id decodes to, with spaces as SPACE
        for i, p in pieces.items():
            self.text[i] = p.encode()
        for b, i in enumerate(self.byte_ids):
            if i >= 0:
                self.text[i] = bytes([b])
        self.size = np.array([len(t) for t in self.text])
        self.begin = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(self.text), np.uint8)
        used = sorted({b for i in plain for b in self.text[i]})
        self.classes = np.zeros(256, np.int64)
        self.classes[used] = np.arange(1, len(used) + 1)
        nodes: list[dict[int, int]] = [{}]
        ends = {}
        for i in plain:
            at = 0
            for b in self.text[i]:
                at = nodes[at].setdefault(b, len(nodes)) if b in nodes[at] else self._grow(nodes, at, b)
            ends[at] = i
        self.width = len(used) + 1
        self.next = np.zeros((len(nodes), self.width), np.int32)  # 0: no such piece
        for at, branch in enumerate(nodes):
            for b, to in branch.items():
                self.next[at, self.classes[b]] = to
        self.next = self.next.ravel()
        self.piece = np.full(len(nodes), -1, np.int32)
        self.piece[list(ends)] = list(ends.values())

    @staticmethod
    def _grow(nodes: list[dict[int, int]], at: int, byte: int) -> int:
        nodes.append({})
        nodes[at][byte] = len(nodes) - 1
        return len(nodes) - 1

    def units(self, normal: str) -> list[str]:
        """Parts of a normalised text that no piece crosses."""
        if self.inner_space or not normal:
            return [normal] if normal else []
        if SPACE + SPACE in normal or normal[-1:] == SPACE:
            return _UNITS.findall(normal)
        if self.inner_break:
            return self._line(normal)
        first, *lines = normal.split("\n")
        out = self._line(first)
        for line in lines:
            out.append("\n")
            out += self._line(line)
        return out

    @staticmethod
    def _line(text: str) -> list[str]:
        head, *rest = text.split(SPACE)
        return [head, *map(SPACE.__add__, rest)] if head else list(map(SPACE.__add__, rest))

    def edges(self, data: np.ndarray, end: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(from, to, id) of all edges over the bytes, a part a length, longer ones first; end[i]: where the unit of byte i ends."""
        classes = self.classes[data]
        first = (data & 0xC0) != 0x80  # a character's first byte
        at = np.flatnonzero(first)
        state, depth, out = np.zeros(len(at), np.int64), 0, []
        begin = at
        single = np.zeros(len(data), bool)
        char_end = np.append(at[1:], len(data))
        char_end_of = np.zeros(len(data), np.int64)
        char_end_of[at] = np.minimum(char_end, end[at])
        while len(begin):
            place = begin + depth
            alive = place < end[begin]
            begin, state, place = begin[alive], state[alive], place[alive]
            state = self.next[state * self.width + classes[place]]
            alive = (state > 0) & (classes[place] > 0)
            begin, state = begin[alive], state[alive].astype(np.int64)
            depth += 1
            piece = self.piece[state]
            hit = piece >= 0
            out.append((begin[hit], begin[hit] + depth, piece[hit].astype(np.int64)))
            single[begin[hit][begin[hit] + depth == char_end_of[begin[hit]]]] = True
        out.reverse()
        unknown = np.flatnonzero(first & ~single)
        if len(unknown):  # characters that aren't pieces: byte by byte
            sizes = char_end_of[unknown] - unknown
            places = np.repeat(unknown - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            ids = self.byte_ids[data[places]]
            out.append((places, places + 1, np.where(ids >= 0, ids, self.unknown)))
        return out


class Lattices:
    """Lattices of distinct units in flat arrays; node 0 is the end of all. Edges of a node lie together, longer ones first."""

    def __init__(self, vocabulary: Vocabulary, alpha: float):
        self.v, self.alpha = vocabulary, alpha
        self.clear()

    def clear(self) -> None:
        self.first: dict[str, int] = {}
        self.again: set[str] = set()  # units asked for again since the others were dropped
        self.nodes = self.n_edges = 0
        for name, kind in (("start", np.int32), ("degree", np.int32), ("to", np.int32), ("id", np.int32), ("head", np.int32), ("logp", np.float64), ("cum", np.float64)):
            setattr(self, name, np.zeros(1 << 16, kind))
        self._put(0, start=np.zeros(1), degree=np.zeros(1))
        self.nodes = 1

    def _put(self, at: int, **columns: np.ndarray) -> None:
        """Columns from ``at`` on; the arrays double when they are full."""
        for name, values in columns.items():
            own = getattr(self, name)
            if at + len(values) > len(own):
                larger = np.zeros(max(2 * len(own), at + len(values)), own.dtype)
                larger[:at] = own[:at]
                setattr(self, name, own := larger)
            own[at : at + len(values)] = values

    def siblings(self, edge: int) -> np.ndarray:
        """All edges that start where this one does."""
        head = int(self.head[edge])
        rest = np.flatnonzero(self.head[head : min(head + 4096, self.n_edges)] != head)
        return np.arange(head, head + (int(rest[0]) if len(rest) else min(4096, self.n_edges - head)))

    def _keep(self, units: set[str]) -> None:
        """Drop all lattices but those of the units."""
        kept = list(units)
        sizes = np.array([len(u.encode()) for u in kept], np.int64)
        nodes = _ranges(np.array([self.first[u] for u in kept], np.int64), sizes)
        degree = self.degree[nodes].astype(np.int64)
        edges, start = _ranges(self.start[nodes], degree), np.cumsum(degree) - degree
        place = np.zeros(self.nodes, np.int32)
        place[nodes] = np.arange(1, len(nodes) + 1)
        left = dict(to=place[self.to[edges]], id=self.id[edges], head=np.repeat(start, degree), logp=self.logp[edges], cum=self.cum[edges])
        self.clear()
        self._put(1, start=start, degree=degree)
        self._put(0, **left)
        self.first = dict(zip(kept, (1 + np.cumsum(sizes) - sizes).tolist(), strict=True))
        self.nodes, self.n_edges = 1 + len(nodes), len(edges)

    def learn(self, units: set[str]) -> None:
        known = units & self.first.keys()
        new = list(units - known)
        self.again |= known
        if (len(self.first) + len(new) > KEPT_WORDS or self.n_edges > KEPT_EDGES) and self.first:
            self._keep(self.again if len(self.again) <= KEPT_WORDS // 2 else known)
        if not new:
            return
        parts = [u.encode() for u in new]
        sizes = np.array([len(p) for p in parts])
        data = np.frombuffer(b"".join(parts), np.uint8)
        unit_end = np.cumsum(sizes)
        end = np.repeat(unit_end, sizes)
        edges = self.v.edges(data, end)
        degree, start = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64)
        for a, _, _ in edges:
            degree[a] += 1
        # nodes of fewer bytes to the end come first; edges lie by their nodes
        nodes = np.flatnonzero(degree)
        left = end[nodes] - nodes
        order = np.argsort(left.astype(np.uint16) if left.max() < 1 << 16 else left, kind="stable")
        nodes, left = nodes[order], left[order]
        each = degree[nodes]
        heads = np.cumsum(each) - each
        start[nodes] = heads
        b, piece = np.empty(int(each.sum()), np.int64), np.empty(int(each.sum()), np.int64)
        free = start.copy()
        for a, to, ids in edges:
            at = free[a]
            b[at], piece[at] = to, ids
            free[a] = at + 1
        start[nodes] += self.n_edges
        score = self.alpha * self.v.score[piece]
        last = b == np.repeat(end[nodes], each)  # the edge ends its unit
        beta = np.zeros(len(data) + 1)
        weight = np.zeros(len(b))
        cuts = np.flatnonzero(np.diff(left, prepend=-1))
        for p, q in zip(cuts, np.append(cuts[1:], len(nodes)), strict=True):
            s, e = heads[p], heads[q - 1] + each[q - 1]
            w = score[s:e] + np.where(last[s:e], 0.0, beta[b[s:e]])
            top = np.maximum.reduceat(w, heads[p:q] - s)
            total = top + np.log(np.add.reduceat(np.exp(w - np.repeat(top, each[p:q])), heads[p:q] - s))
            beta[nodes[p:q]] = total
            weight[s:e] = w - np.repeat(total, each[p:q])
        cum, j = np.exp(weight), 1
        more = heads[each > 1], each[each > 1]
        while len(more[0]):
            cum[more[0] + j] += cum[more[0] + j - 1]
            j += 1
            more = more[0][more[1] > j], more[1][more[1] > j]
        self._put(self.nodes, start=start, degree=degree)
        self._put(self.n_edges, to=np.where(last, 0, b + self.nodes), id=piece, head=np.repeat(heads + self.n_edges, each), logp=weight, cum=cum)
        self.first.update(zip(new, (unit_end - sizes + self.nodes).tolist(), strict=True))
        self.nodes, self.n_edges = self.nodes + len(data), self.n_edges + len(b)

    def paths(self, node: np.ndarray, seed: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Paths drawn from each node to its unit's end: for each step, which starts take it and over which edge."""
        who, steps, k = np.flatnonzero(node), [], np.uint64(0)
        node, seed = node[who], seed[who]
        while len(who):
            draw = (mixed(seed + k) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = self.start[node]
            last = edge + self.degree[node] - 1
            open_ = np.flatnonzero((draw >= self.cum[edge]) & (edge < last))
            while len(open_):
                edge[open_] += 1
                at = edge[open_]
                open_ = open_[(draw[open_] >= self.cum[at]) & (at < last[open_])]
            steps.append((who, edge))
            node = self.to[edge]
            go = np.flatnonzero(node)
            who, node, seed, k = who[go], node[go], seed[go], k + np.uint64(1)
        return steps


def _flat(steps: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of all starts in order, and how many each of the n starts has."""
    count = np.zeros(n, np.int64)
    for who, _ in steps:
        count[who] += 1
    begin = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(begin[-1], np.int64)
    for k, (who, edge) in enumerate(steps):
        out[begin[who] + k] = edge
    return out, count


class Path(NamedTuple):
    edges: np.ndarray
    unit: np.ndarray  # the unit of each edge
    bound: np.ndarray  # the bound of each step's siblings, -inf before the step where the path left another
    before: np.ndarray  # log-probability of the prefix before each step
    score: float  # the perturbed score
    taken: dict[int, list[int]]  # edges that other paths took at a step


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _truncated(location: np.ndarray, most: np.ndarray | float, draw: np.ndarray) -> np.ndarray:
    """Gumbels of the locations, below ``most``."""
    with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
        out = location - np.log(np.exp(location - most) - np.log(draw))
    return np.where(np.isneginf(location), -np.inf, np.minimum(out, most))


def _uniform(seed: np.ndarray) -> np.ndarray:
    return ((mixed(seed) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _seeds(keys: np.ndarray, sample: int, kind: int) -> np.ndarray:
    """The first counter of each key."""
    return mixed(keys ^ np.uint64((sample << 8) ^ kind))


def _counters(seeds: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """So many counters from each seed, one seed after the other."""
    return np.repeat(seeds, sizes) + _ranges(np.zeros(len(sizes), np.int64), sizes).astype(np.uint64) * STEP


def sample_texts(lat: Lattices, texts: list[str], keys: list[int], k: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each normalised text up to k distinct segmentations (ids, log-probability, perturbed score, log of the inclusion
    probability), by descending perturbed score."""
    split = [lat.v.units(t) for t in texts]
    lat.learn(set().union(*split))
    first = [np.fromiter(map(lat.first.__getitem__, s), np.int64, len(s)) for s in split]
    paths: list[list[Path]] = [[] for _ in texts]
    kappa = [-np.inf] * len(texts)
    live = [i for i, s in enumerate(split) if s]
    signs = np.array(keys, np.int64).view(np.uint64)
    for r in range(k + 1):
        asked, nodes = [], []
        draws = _uniform(_seeds(signs[live], r, 1 if r == 0 else 3)[:, None] + np.arange(2, dtype=np.uint64) * STEP)
        for i, u in zip(live, draws, strict=True):
            if r == 0:
                asked.append((i, None, 0, -1, 0, float(-np.log(-np.log(u[0])))))
                nodes.append(first[i])
                continue
            tops = [int(p.bound.argmax()) for p in paths[i]]
            j = max(range(len(tops)), key=lambda x: paths[i][x].bound[tops[x]])  # noqa: B023
            path, t = paths[i][j], tops[j]
            bound = float(path.bound[t])
            if bound == -np.inf:
                continue  # no other segmentation
            if r == k:
                kappa[i] = bound
                continue
            # the group at step t parts: one sibling keeps its bound, the others stay in the agenda
            e0 = path.edges[t]
            left = lat.siblings(int(e0))
            for gone in (e0, *path.taken.get(t, [])):
                left = left[left != gone]
            mass = np.exp(lat.logp[left])
            pick = int(left[min(int(np.searchsorted(np.cumsum(mass), u[0] * mass.sum(), "right")), len(left) - 1)])
            path.taken.setdefault(t, []).append(pick)
            rest = mass.sum() - np.exp(lat.logp[pick])
            rest = path.before[t] + np.log(rest) if len(left) > 1 and rest > 0 else -np.inf
            path.bound[t] = _truncated(np.array([rest]), bound, u[1:])[0]
            unit = int(path.unit[t])
            asked.append((i, j, t, pick, unit, bound))
            nodes.append(np.concatenate([lat.to[[pick]], first[i][unit + 1 :]]))
        live = [x[0] for x in asked]
        if r == k or not asked:
            continue
        sizes = np.array([len(x) for x in nodes])
        drawn, count = _flat(lat.paths(np.concatenate(nodes), _counters(_seeds(signs[live], r, 2), sizes)), int(sizes.sum()))
        ends = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(sizes)])]
        own = np.repeat(_ranges(np.array([x[4] for x in asked]), sizes), count)  # the unit of each edge
        # the prefixes of all paths, then the bounds of all siblings at once
        logp = lat.logp[drawn]
        befores, prefix = [], np.empty(len(drawn))
        for (i, j, t, pick, _, _), a, b in zip(asked, ends[:-1], ends[1:], strict=True):
            steps = logp[a:b] if j is None else np.concatenate([lat.logp[paths[i][j].edges[:t]], [lat.logp[pick]], logp[a:b]])
            befores.append(np.concatenate([[0.0], np.cumsum(steps)]))
            prefix[a:b] = befores[-1][len(steps) - (b - a) : -1]
        with np.errstate(divide="ignore"):
            others = prefix + np.log(-np.expm1(np.minimum(logp, 0.0)))
        others[logp > -1e-15] = -np.inf  # no sibling
        many = np.diff(ends)
        group = _truncated(others, np.repeat([x[5] for x in asked], many), _uniform(_counters(_seeds(signs[live], r, 4), many)))
        for (i, j, t, pick, unit, bound), before, a, b in zip(asked, befores, ends[:-1], ends[1:], strict=True):
            if j is None:
                paths[i].append(Path(drawn[a:b], own[a:b], group[a:b], before, bound, {}))
                continue
            p = paths[i][j]
            paths[i].append(Path(np.concatenate([p.edges[:t], [pick], drawn[a:b]]), np.concatenate([p.unit[:t], [unit], own[a:b]]),
                                 np.concatenate([np.full(t + 1, -np.inf), group[a:b]]), before, bound, {}))
    return [[(lat.id[p.edges], float(p.before[-1]), p.score, _log_inclusion(float(p.before[-1]) - kap)) for p in own] for own, kap in zip(paths, kappa, strict=True)]


def _log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x))): a Gumbel at x above 0."""
    return x if x < -30 else 0.0 if x > 4 else float(np.log(-np.expm1(-np.exp(x))))


def decoded(vocabulary: Vocabulary, ids: np.ndarray) -> str:
    """The normalised text that ids stand for; bytes that aren't UTF-8 become U+FFFD."""
    return b"".join(map(vocabulary.text.__getitem__, ids.tolist())).decode("utf-8", "replace")


def round_trips(vocabulary: Vocabulary, ids: list[np.ndarray], texts: list[str]) -> list[bool]:
    """Whether ids decode to their normalised texts: the bytes of some lists at a time are gathered and compared."""
    out, step = [], 64
    for s in range(0, len(ids), step):
        flat = np.concatenate(ids[s : s + step])
        size = vocabulary.size[flat]
        data = vocabulary.bytes[_ranges(vocabulary.begin[flat], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0, *map(len, ids[s : s + step])])].tolist()
        for own, text, a, b in zip(ids[s : s + step], texts[s : s + step], ends[:-1], ends[1:], strict=True):
            out.append(data[a:b] == text.encode() or decoded(vocabulary, own) == text)
    return out


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def lattices(path: str, alpha: float) -> Lattices:
    """One dictionary of lattices a worker, model and temperature."""
    return Lattices(vocabulary(path), alpha)


def sample_segmentations(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", k: int = 2, alpha: float = 0.5, seed: int = 0,
) -> DataFrame:
    """Rows (id, sample, ids, log_prob, perturbed, log_inclusion, round_trip): up to k distinct segmentations a text.

    They are drawn without replacement in proportion to exp(alpha x sum of piece scores), the first like one draw.
    log_inclusion is the log-probability that the segmentation's perturbed score exceeds the (k+1)-th, 0 where
    a text has no more than k. round_trip: the ids decode to the normalised text. The row's key, a hash of id and
    seed, fixes its draws: rows that repeat have the same samples. A null or empty text has one empty
    segmentation; an empty table has no rows; other columns are not read.
    """
    results = [StructField("sample", IntegerType()), StructField("ids", ArrayType(IntegerType())), StructField("log_prob", DoubleType()),
               StructField("perturbed", DoubleType()), StructField("log_inclusion", DoubleType()), StructField("round_trip", BooleanType())]
    schema = StructType([StructField(id_col, df.schema[id_col].dataType), *results])

    def run(batches):
        lat = lattices(path, alpha)
        for batch in batches:
            texts, keys, owner, rows = [lat.v.library.normalize(t) if t else "" for t in texts_of(batch, "_text")], batch.column("_key").to_pylist(), [], []
            for i, samples in enumerate(sample_texts(lat, texts, keys, k)):
                for r, (ids, logp, perturbed, inclusion) in enumerate(samples or [(np.zeros(0, np.int32), 0.0, 0.0, 0.0)]):
                    owner.append(i)
                    rows.append((r + 1, ids, logp, perturbed, inclusion))
            if rows:
                kinds = [pa.int32(), pa.list_(pa.int32()), pa.float64(), pa.float64(), pa.float64()]
                same = round_trips(lat.v, [x[1] for x in rows], [texts[i] for i in owner])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_id").take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)), pa.array(same, pa.bool_())], names=schema.fieldNames())

    keyed = df.select(F.col(id_col).alias("_id"), F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)).alias("_key"), F.col(text_col).alias("_text"))
    return keyed.mapInArrow(run, schema)


def decode_segmentations(df: DataFrame, path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """df with ``text_col``: the text of the ids, spaces for SPACE, without the space that the model puts in front.

    Null ids give a null text, empty ones an empty text; a column named ``text_col`` is replaced.
    """
    others = [f for f in df.schema.fields if f.name != text_col]
    schema = StructType([*others, StructField(text_col, StringType())])

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            texts = [None if x is None else decoded(v, np.array(x, np.int64)).replace(SPACE, " ").removeprefix(" ") for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in others), pa.array(texts, pa.string())], names=schema.fieldNames())

    return df.select(*(F.col(f"`{f.name}`") for f in others)).mapInArrow(run, schema)
