"""Conversation prefix trie: a node for each distinct sequence of first turns, with counts of its whole subtree.

A turn's digest is a SHA-256 of role and text. A prefix's digest is a sum over its turns of hashes of (depth, turn),
carried as four sums of 32 bits each, so that a running sum gives it and one conversation can be many ranges. Steps
(conversation, depth) are dealt to shards by bands of depth and a hash of the conversation. A shard enumerates its
distinct prefix digests, gives them the slots of a minimal perfect hash table (a digest kept in each slot verifies a
look-up) and scatters counts into flat arrays; what shards count of the same node is added up. A node's own number
of leaves and tokens then goes to the one shard that holds its smallest member, shards add their arrays up through
parent slots in depth order, and sums of shards are added again. Bands are done from the deepest, one job for
each; with at most ``BAND`` turns a conversation there is one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from prepkit.llm.codepoints import mixed
from prepkit.llm.common import WORD, written
from prepkit.operators.ordering import RANGE, row_numbers, running_sums

# Fixed values of the rebuilding: families of conversations, and how many first turns one may take over (less one).
FAMILY, TAKEN = 20, 4
#: Depths of a band, rows of a shard (about), conversations of one text of ids.
BAND, SHARD_ROWS, IDS = 4096, 100_000, 65_536
_LOW = 0xFFFFFFFF
KEY = ["ka", "kb"]


class SlotTable:
    """Slots 0 .. n-1 of n distinct pairs of 64 bits, by levels of bits in which a pair stands alone."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.a, self.b = np.zeros(len(a), np.uint64), np.zeros(len(a), np.uint64)
        left, taken = np.arange(len(a)), 0
        while len(left):
            place = self._places(a[left], b[left], len(self.levels), 3 * len(left) // 2 + 1)
            bits = np.bincount(place, minlength=3 * len(left) // 2 + 1) == 1
            rank = np.cumsum(bits) - 1 + taken
            alone = bits[place]
            slot = rank[place[alone]]
            self.a[slot], self.b[slot] = a[left[alone]], b[left[alone]]
            self.levels.append((bits, rank))
            taken += int(bits.sum())
            left = left[~alone]

    @staticmethod
    def _places(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mixed(a + mixed(b + np.uint64(level + 1))) % np.uint64(size)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each pair; -1 where the digest in the slot is another one."""
        out, left = np.full(len(a), -1), np.arange(len(a))
        for level, (bits, rank) in enumerate(self.levels):
            place = self._places(a[left], b[left], level, len(bits))
            hit = bits[place]
            out[left[hit]] = rank[place[hit]]
            left = left[~hit]
        known = out >= 0
        known[known] = (self.a[out[known]] == a[known]) & (self.b[out[known]] == b[known])
        return np.where(known, out, -1)


def _pairs(table: pa.Table, a: str, b: str) -> tuple[np.ndarray, np.ndarray]:
    return tuple(table[c].to_numpy().astype(np.int64).view(np.uint64) for c in (a, b))


def _distinct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A row of each distinct pair."""
    order = np.lexsort((b, a))
    first = np.ones(len(a), bool)
    first[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    return order[first]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def rebuilt(df: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(c, length) of the conversations and (c, depth, th, words, length) of their rebuilt turns."""
    role, text = (F.coalesce(F.col(f"`{x}`"), F.lit("")) for x in (role_col, text_col))
    own = df.where(F.col(f"`{conv_col}`").isNotNull()).select(
        F.col(f"`{conv_col}`").cast("long").alias("c"), F.col(f"`{turn_col}`").alias("turn"),
        F.unhex(F.sha2(F.concat(F.sha2(role, 256), F.sha2(text, 256)), 256)).alias("th"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    turns = written(row_numbers(own, ["c"], "turn", ["th"], "pos").drop("turn"), "turns")

    base, h = F.col("c") - F.col("c") % FAMILY, F.crc32(F.col("c").cast("string")) % TAKEN
    sizes = turns.groupBy("c").agg(F.count(F.lit(1)).alias("n")).withColumns({"base": base, "h": F.when(F.col("c") == base, F.lit(0)).otherwise(h)})
    bases = sizes.where("c = base").select("base", F.col("n").alias("nb"))
    convs = sizes.join(bases, "base", "left").withColumn("taken", F.least(F.col("h"), F.coalesce("nb", F.lit(0))))
    convs = written(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "convs")

    first = turns.where((F.col("c") % FAMILY == 0) & (F.col("pos") < TAKEN)).select(F.col("c").alias("base"), "pos", "th", "words")
    head = convs.where("taken > 0").join(first, "base").where("pos <= taken").select("c", F.col("pos").alias("depth"), "th", "words", "length")
    tail = turns.join(convs.select("c", "h", "taken", "length"), "c").where("pos > h")
    return convs.select("c", "length"), head.unionByName(tail.select("c", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "th", "words", "length"))


def _key(sums: list[Column]) -> list[Column]:
    a, b, c, d = (s.bitwiseAND(F.lit(_LOW)) for s in sums)
    return [F.shiftleft(a, 32).bitwiseOR(b), F.shiftleft(c, 32).bitwiseOR(d)]


def digests(steps: DataFrame, bands: int, seed: int) -> DataFrame:
    """Steps with band, the prefix's digest (ka, kb) and its parent's (pa, pb)."""
    x, y = F.xxhash64(F.lit(seed), F.col("depth"), F.col("th")), F.xxhash64(F.col("th"), F.col("depth"), F.lit(seed))
    limbs = {"l0": F.shiftrightunsigned(x, 32), "l1": x.bitwiseAND(F.lit(_LOW)), "l2": F.shiftrightunsigned(y, 32), "l3": y.bitwiseAND(F.lit(_LOW))}
    ranged = steps.withColumn(RANGE, F.floor((F.col("depth") - 1) / BAND).cast("int")).withColumns(limbs)
    sums = running_sums(ranged, ["c"], [F.col("depth")], {f"s{i}": F.col(f"l{i}") for i in range(4)}, bands)
    (ka, kb), (up, vp) = _key([F.col(f"s{i}") for i in range(4)]), _key([F.col(f"s{i}") - F.col(f"l{i}") for i in range(4)])
    return sums.select("c", "depth", "th", "words", "length", F.col(RANGE).alias("band"), ka.alias("ka"), kb.alias("kb"), up.alias("pa"), vp.alias("pb"))


def counted(table: pa.Table) -> pa.Table:
    """A shard's nodes: members, the smallest one, and a step's own columns; clash where steps of a node differ."""
    a, b = _pairs(table, "ka", "kb")
    slots = SlotTable(*(x[_distinct(a, b)] for x in (a, b)))
    at, n = slots.find(a, b), len(slots.a)
    some = np.zeros(n, np.int64)
    some[at] = np.arange(len(at))
    members, least = np.bincount(at, minlength=n), np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(least, at, table["c"].to_numpy())
    turn = np.frombuffer(b"".join(table["th"].to_pylist()), np.uint64).reshape(-1, 4)
    own = {c: table[c].to_numpy() for c in ("depth", "words", "pa", "pb")}
    differ = (turn != turn[some[at]]).any(axis=1)
    for x in own.values():
        differ |= x != x[some[at]]
    clash = np.bincount(at, differ, n) > 0
    return pa.table([_signed(slots.a), _signed(slots.b), *(pa.array(own[c][some]) for c in own), table["th"].take(pa.array(some)).combine_chunks(), pa.array(members), pa.array(least), pa.array(clash)],
                    names=["ka", "kb", *own, "th", "n", "conv", "clash"])


COUNTED = "ka long, kb long, depth long, words long, pa long, pb long, th binary, n long, conv long, clash boolean"


def summed(table: pa.Table) -> pa.Table:
    """A shard's sums of leaves and tokens over subtrees, for its nodes and the tops above them."""
    a, b = _pairs(table, "ka", "kb")
    up, vp = _pairs(table, "pa", "pb")
    rows = _distinct(a, b)
    every = (np.concatenate([a[rows], up]), np.concatenate([b[rows], vp]))
    slots = SlotTable(*(x[_distinct(*every)] for x in every))
    n, at = len(slots.a), slots.find(a, b)
    parent, depth = np.full(n, -1), np.full(n, -1, np.int64)
    parent[at[rows]], depth[at[rows]] = slots.find(up[rows], vp[rows]), table["depth"].to_numpy()[rows]
    depth[parent[at[rows]][depth[parent[at[rows]]] < 0]] = depth[at[rows]].min() - 1
    totals = []
    for name in ("leaves", "saved"):
        total = np.zeros(n, np.int64)
        np.add.at(total, at, table[name].to_numpy())
        totals.append(total)
    order = np.argsort(-depth, kind="stable")
    for level in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        if depth[level[0]] >= 0 and parent[level[0]] >= 0:
            for total in totals:
                np.add.at(total, parent[level], total[level])
    return pa.table([_signed(slots.a), _signed(slots.b), pa.array(depth), *map(pa.array, totals)], names=["ka", "kb", "depth", "leaves", "saved"])


SUMMED = "ka long, kb long, depth long, leaves long, saved long"


def _id_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and conversation to texts of ids with their first id."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b, c = (batch.column(x).to_numpy() for x in ("ka", "kb", "c"))
        cut = np.flatnonzero((np.diff(a) != 0) | (np.diff(b) != 0)) + 1
        cut = np.union1d(np.append(0, cut), np.arange(0, len(a), IDS))
        parts = np.split(c, cut[1:])
        yield pa.RecordBatch.from_arrays([pa.array(a[cut]), pa.array(b[cut]), pa.array(c[cut]), pa.array([",".join(map(str, p.tolist())) for p in parts])], names=["ka", "kb", "first", "ids"])


def _id_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of ids sorted by node and first id to one SHA-256 a node; a hash state is all that is held."""
    now, state = None, None
    for batch in batches:
        out = []
        for a, b, ids in zip(*(batch.column(x).to_pylist() for x in ("ka", "kb", "ids")), strict=True):
            if now != (a, b):
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = (a, b), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["ka", "kb", "ends"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], names=["ka", "kb", "ends"])


def end_hashes(ends: DataFrame) -> DataFrame:
    """(ka, kb, ends): SHA-256 of the comma-joined ascending ids of each node's rows (ka, kb, c)."""
    texts = ends.repartitionByRange("ka", "kb", "c").sortWithinPartitions("ka", "kb", "c").mapInArrow(_id_texts, "ka long, kb long, first long, ids string")
    return texts.repartition("ka", "kb").sortWithinPartitions("ka", "kb", "first").mapInArrow(_id_hashes, "ka long, kb long, ends string")


def _nodes(steps: DataFrame, bands: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """Written steps with digests, and the nodes below the root. A clash of digests takes other hashes."""
    shard = F.pmod(F.xxhash64("c"), F.lit(shards))
    for seed in range(1, 1 << 10):
        dug = written(digests(steps, bands, seed).withColumn("shard", shard), "steps")
        parts = dug.groupBy("band", "shard").applyInArrow(counted, COUNTED)
        same = ["depth", "words", "pa", "pb", "th"]
        clash = F.max("clash")
        for c in same:
            clash = clash | (F.min(c) != F.max(c))
        nodes = written(parts.groupBy(*KEY).agg(F.sum("n").alias("n"), F.min("conv").alias("conv"), *(F.min(c).alias(c) for c in same), clash.alias("clash")), "nodes")
        if nodes.where("clash").isEmpty():
            return dug, nodes.drop("clash")
    raise ValueError("digests of prefixes keep clashing")


def conversation_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, and turn_sha256 (hex digest of the node's last turn; null for the root).

    Turns are ordered by turn, nulls first, ties by the turn's digest, so that rows that repeat are turns each.
    Null roles and texts are empty; rows without a conversation take no part. A node is known by its smallest member
    and depth. An empty table has no nodes; conversations without a turn that is left are members of the root alone.
    Other columns of df aren't read.
    """
    spark = df.sparkSession
    schema = StructType([StructField(c, LongType()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")])
    schema = schema.add("ends_sha256", StringType()).add("turn_sha256", StringType())
    convs, steps = rebuilt(df, conv_col, turn_col, role_col, text_col)
    n, least, deepest, rows = convs.agg(F.count(F.lit(1)), F.min("c"), F.max("length"), F.sum("length")).first()
    if not n:
        return spark.createDataFrame([], schema)
    bands, shards = max(1, -(-deepest // BAND)), max(1, -(-rows // SHARD_ROWS))
    dug, nodes = _nodes(steps, bands, shards)
    below = nodes.groupBy("pa", "pb").agg(F.count(F.lit(1)).alias("n_children")).select(F.col("pa").alias("ka"), F.col("pb").alias("kb"), "n_children")
    below = written(below, "children")
    nodes = written(nodes.join(below, KEY, "left").na.fill(0, ["n_children"]), "counted")

    totals, carried = [], None
    own = nodes.select(*KEY, F.col("conv").alias("c"), "depth", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("words")).alias("saved"))
    for band in range(bands - 1, -1, -1):
        values = own.where((F.col("depth") > band * BAND) & (F.col("depth") <= (band + 1) * BAND))
        if carried is not None:
            more = carried.select(*KEY, F.col("leaves").alias("l"), F.col("saved").alias("s"))
            values = values.join(more, KEY, "left").withColumns({"leaves": F.col("leaves") + F.coalesce("l", F.lit(0)), "saved": F.col("saved") + F.coalesce("s", F.lit(0))})
        held = dug.where(F.col("band") == band).join(values.select("c", "depth", "leaves", "saved"), ["c", "depth"], "left").na.fill(0, ["leaves", "saved"])
        parts = held.select("shard", *KEY, "pa", "pb", "depth", "leaves", "saved").groupBy("shard").applyInArrow(summed, SUMMED)
        done = written(parts.groupBy(*KEY).agg(F.min("depth").alias("depth"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "subtrees")
        totals.append(done.where(F.col("depth") > band * BAND))
        carried = done.where(F.col("depth") == band * BAND)
    sums = totals[0]
    for more in totals[1:]:
        sums = sums.unionByName(more)
    root = carried.first()
    root_ends = convs.where("length = 0").select(F.lit(0).cast("long").alias("ka"), F.lit(0).cast("long").alias("kb"), "c")
    ends = written(end_hashes(dug.where("depth = length").select(*KEY, "c").unionByName(root_ends)), "ends")
    none, top_ends = hashlib.sha256(b"").hexdigest(), ends.where("ka = 0 AND kb = 0").first()
    top_children = below.where("ka = 0 AND kb = 0").first()
    top = spark.createDataFrame([(least, 0, None, n, top_children["n_children"] if top_children else 0, root["leaves"] if root else 1, root["saved"] if root else 0,
                                  top_ends["ends"] if top_ends else none, None)], schema)
    first = nodes.where("depth = 1").withColumn("parent", F.lit(least).cast("long"))
    owners = nodes.select(F.col("ka").alias("pa"), F.col("kb").alias("pb"), F.col("conv").alias("parent"))
    deeper = nodes.where("depth > 1").join(owners, ["pa", "pb"]).select(*first.columns)
    out = first.unionByName(deeper).join(sums.drop("depth"), KEY).join(ends, KEY, "left")
    return top.unionByName(out.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(none)).alias("ends_sha256"), F.lower(F.hex("th")).alias("turn_sha256")))


SQL = r"""
WITH t AS (
  SELECT conv_id AS c, turn, sha256(sha256(coalesce(role, '')) || sha256(coalesce(text, ''))) AS th,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT c, th, words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, th) AS pos FROM t),
b AS (SELECT c, max(pos) AS n, c - c % 20 AS base, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::UBIGINT) AS bytes FROM p GROUP BY c),
x AS (SELECT c, n, base, xor(list_reduce(list_prepend(4294967295::UBIGINT, bytes), lambda a, v: list_reduce(
    list_prepend(xor(a, v), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
    lambda r, z: xor(r >> 1, CASE WHEN r & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))), 4294967295::UBIGINT) % 4 AS h FROM b),
r AS (
  SELECT x.c, p.pos, p.th, p.words FROM x JOIN p ON p.c = x.base AND p.pos <= x.h
  UNION ALL SELECT x.c, 1000000000 + p.pos, p.th, p.words FROM x JOIN p ON p.c = x.c AND p.pos > x.h),
s AS (SELECT c, words, row_number() OVER w AS depth, string_agg(th, '') OVER w AS path, th FROM r WINDOW w AS (PARTITION BY c ORDER BY pos)),
l AS (SELECT x.c, coalesce(max(s.depth), 0) AS depth, coalesce(max_by(s.path, s.depth), '') AS path FROM x LEFT JOIN s USING (c) GROUP BY x.c),
n AS (
  SELECT path, depth, min(c) AS conv_id, count(*) AS n, any_value(words) AS words, any_value(th) AS th FROM s GROUP BY path, depth
  UNION ALL SELECT '', 0, min(c), count(*), 0, NULL FROM x HAVING count(*) > 0),
k AS (SELECT n.*, p.conv_id AS parent_conv_id FROM n LEFT JOIN n p ON p.depth = n.depth - 1 AND p.path = left(n.path, 64 * p.depth::INT)),
f AS (SELECT k.*, (SELECT count(*) FROM n m WHERE m.depth = k.depth + 1 AND left(m.path, 64 * k.depth::INT) = k.path) AS n_children FROM k),
g AS (SELECT f.path, f.depth, sum(CASE WHEN u.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((u.n - 1) * u.words) AS saved
  FROM f JOIN f u ON u.depth >= f.depth AND left(u.path, 64 * f.depth::INT) = f.path GROUP BY f.path, f.depth),
e AS (SELECT path, depth, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS ends FROM l GROUP BY path, depth)
SELECT f.conv_id, f.depth::BIGINT AS depth, f.parent_conv_id, f.n::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, g.n_leaves::BIGINT AS n_leaves,
  g.saved::BIGINT AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256, f.th AS turn_sha256
FROM f JOIN g USING (path, depth) LEFT JOIN e USING (path, depth)
"""
