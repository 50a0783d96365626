"""N-gram Jaccard join through a token-group matrix.

1. Equal sets become one node. Every node keeps its probing prefix (its first tokens in one global order, frequent
   tokens last), a parity bitmap and a few minimum hashes.
2. Groups of similar nodes: nodes that share a minimum hash are compared with one pivot of theirs, the one with
   the largest share of frequent tokens (in a group of copies that is nearest to their origin), and in a second
   round with another in each bucket. Links found are exact, and components are the groups.
3. The matrix holds the union of each group's prefix tokens, a row a token and group. A query's overlap with a
   group is at most its prefix tokens in the group's union plus its tokens after the prefix; that reaches the least
   overlap of a link only if the union holds a prefix token. Groups that qualify are opened: their nodes that
   share the token, fit in size, and pass the bounds by the tokens before it and by the bitmap are compared exactly.

No link between nodes of one group is needed for components, so that large groups of copies are never paired
within. The global order only has to be the same everywhere; which tokens count as frequent changes the work, not
the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prepkit.llm.codepoints import mixed, windows, words
from prepkit.llm.common import arrow_map, shielded, text_key, texts_of, written
from prepkit.llm.graph import components

BANDS = 8
#: A token counts as frequent from so many sets on; at most so many tokens are kept as such (8 bytes each).
FREQUENT_SETS, FREQUENT_TOKENS = 8, 500_000
#: Rows of two numbers up to which a side is sent to all tasks.
BROADCAST_ROWS = 1_000_000
#: 64-bit words of a bitmap that go along with every row of the matrix that is opened (a power of 2).
CARRIED_WORDS = 8
#: Sets whose tokens a task counts at a time.
COUNTED_TOKENS = 4_000_000
_SEEDS = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))


def shingles(text: str, n: int) -> np.ndarray:
    """Distinct hashes (signed, ascending) of the text's n-word shingles; with fewer words, of all words as one."""
    h = words(text, lower=True).hashes
    if not len(h):
        return np.zeros(0, np.int64)
    return np.unique(windows(h, min(n, len(h))).view(np.int64))


def least_overlap(n: int) -> int:
    """Tokens that a set of n shares at least with any set it links to (Jaccard similarity of 0.8 or more)."""
    return (4 * n + 4) // 5


def probe_length(n: int) -> int:
    return n - least_overlap(n) + 1


def index_length(n: int) -> int:
    """As :func:`probe_length`, if the other set isn't smaller."""
    return n - (8 * n + 8) // 9 + 1


def _node(tokens: np.ndarray) -> int:
    t = tokens.view(np.uint64)
    return int((mixed(t + np.uint64(0x632BE59BD9B4E019)).sum(dtype=np.uint64) ^ mixed(np.array([len(t)], np.uint64))[0]).view(np.int64))


def parity_bitmap(tokens: np.ndarray) -> np.ndarray:
    """Bits (in 64-bit words) of the parity of tokens by their low bits; at least as many bits as tokens.

    Two sets' bitmaps differ in no more bits than the sets differ in tokens.
    """
    bits = 128
    while bits < len(tokens):
        bits *= 2
    odd = np.bincount(tokens & (bits - 1), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view(np.int64)


def frequent_tokens(df: DataFrame, text_col: str, n: int) -> np.ndarray:
    """Tokens of many sets, ascending: those that tasks have met more than once, added up over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def emit() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(token[count > 1]), pa.array(count[count > 1])], names=["token", "n"])

        for batch in batches:
            for text in texts_of(batch, text_col):
                own = shingles(text, n)
                if len(own) and (node := _node(own)) not in seen:
                    seen.add(node)
                    held.append(own)
                    size += len(own)
            if size > COUNTED_TOKENS:
                yield emit()
                held, size, seen = [], 0, set()
        if held:
            yield emit()

    counted = df.select(text_col).mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT_SETS)
    return np.sort(counted.orderBy(F.desc("n"), "token").limit(FREQUENT_TOKENS).select("token").toArrow()["token"].to_numpy())


def set_features(df: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(id, _id, _th, n, node, and for the first of a task's equal sets prefix, bits, bands, hot)."""
    frequent = df.sparkSession.sparkContext.broadcast(frequent_tokens(df, text_col, n))  # at most FREQUENT_TOKENS numbers
    keyed = df.select(*text_key(id_col, text_col), F.col(text_col).alias("_text"))
    lists = ["prefix", "bits", "bands"]
    names = ["_id", "_th", "n", "node", *lists, "hot"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows: list[list] = [[] for _ in names[2:]]
            for text in texts_of(batch, "_text"):
                own = shingles(text, n)
                values: list = [len(own), _node(own) if len(own) else None, None, None, None, None]
                if len(own) and values[1] not in seen:
                    if len(seen) > 1_000_000:
                        seen.clear()
                    seen.add(values[1])
                    hot = np.zeros(len(own), bool)
                    if len(frequent.value):
                        at = np.minimum(np.searchsorted(frequent.value, own), len(frequent.value) - 1)
                        hot = frequent.value[at] == own
                    ordered = np.concatenate([own[~hot], own[hot]])
                    bands = [int(mixed(own.view(np.uint64) ^ s).min().view(np.int64)) for s in _SEEDS]
                    values[2:] = [ordered[: probe_length(len(own))], parity_bitmap(own), bands, float(hot.mean())]
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
            kinds = [pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 3, pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_th"), *(pa.array(c, t) for c, t in zip(rows, kinds, strict=True))], names=names)

    kind = df.schema[id_col].dataType.simpleString()
    return written(keyed.mapInArrow(run, f"_id {kind}, _th long, n long, node long, prefix array<long>, bits array<long>, bands array<long>, hot double"), "features")


def _small(df: DataFrame) -> DataFrame:
    """The written frame, sent to all tasks if it has few rows of fixed width; else joined by its keys."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _folded(bits: Column, size: Column) -> Column:
    return F.when(F.size(bits) > size, F.zip_with(F.slice(bits, 1, size), F.slice(bits, size + 1, size), lambda x, y: x.bitwiseXOR(y))).otherwise(bits)


def _differing(a: str, b: str) -> Column:
    """Bits in which two bitmaps differ, the longer one folded to the shorter."""
    size = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(_folded(F.col(a), size), _folded(F.col(b), size), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def _short(bits: str) -> Column:
    """The bitmap folded to CARRIED_WORDS words at most; it still differs in no more bits than the sets in tokens."""
    size = F.size(bits)
    word = lambda j: F.aggregate(F.sequence(j, size, F.lit(CARRIED_WORDS)), F.lit(0).cast("long"), lambda x, i: x.bitwiseXOR(F.element_at(bits, i)))
    return F.when(size <= CARRIED_WORDS, F.col(bits)).otherwise(F.transform(F.sequence(F.lit(1), F.lit(CARRIED_WORDS)), word))


class Verifier:
    """Exact comparison of pairs (a, b) of nodes; token sets are made again from the texts of the nodes asked for."""

    def __init__(self, docs: DataFrame, features: DataFrame, id_col: str, text_col: str, n: int):
        self.docs, self.id_col, self.text_col, self.n = docs, id_col, text_col, n
        self.sketches = written(features.where("bits IS NOT NULL").groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits")), "sketches")
        self.owner = features.where("bits IS NOT NULL").select("node", "_id", "_th")

    def near(self, pairs: DataFrame) -> DataFrame:
        """The pairs (with na, nb) whose sizes and bitmaps allow a link."""
        sides = [self.sketches.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("bits").alias(f"bits_{s}")) for s in "ab"]
        met = pairs.select("a", "b").join(sides[0], "a").join(sides[1], "b").where("5 * na >= 4 * nb AND 5 * nb >= 4 * na")
        return written(met.where(9 * _differing("bits_a", "bits_b") <= F.col("na") + F.col("nb")).select("a", "b", "na", "nb"), "near")

    def tokens(self, near: DataFrame) -> DataFrame:
        nodes = written(near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct(), "asked")
        keys = self.owner.join(_small(nodes), "node").groupBy("node").agg(F.min(F.struct("_id", "_th")).alias("k")).select("k._th", F.col("k._id").alias("_kid"))
        keys = written(keys.distinct(), "keys")
        own = self.docs.select(*text_key(self.id_col, self.text_col), F.col(self.text_col).alias("_text"))
        texts = own.join(_small(keys), (own["_th"] == keys["_th"]) & own["_id"].eqNullSafe(keys["_kid"]), "left_semi").select("_text")
        n = self.n

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(t, n) for t in texts_of(batch, "_text")]
            return pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["node", "tokens"])

        return written(arrow_map(texts, work, "node long, tokens array<long>").groupBy("node").agg(F.first("tokens").alias("tokens")), "tokens")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs that link: 100 * intersection >= 80 * union."""
        near = self.near(pairs)
        tokens = self.tokens(near)
        first = near.join(tokens.select(F.col("node").alias("a"), F.col("tokens").alias("ta")), "a")
        both = first.join(tokens.select(F.col("node").alias("b"), F.col("tokens").alias("tb")), "b")
        return written(both.where(9 * F.size(F.array_intersect("ta", "tb")) >= 4 * (F.col("na") + F.col("nb"))).select("a", "b"), "links")


def _labelled(df: DataFrame, groups: DataFrame | None, col: str, label: str) -> DataFrame:
    """df with the group of ``col``; a node alone is its own group."""
    if groups is None:
        return df.withColumn(label, F.col(col))
    side = groups.select(F.col("node").alias("_gnode"), F.col("label").alias("_glabel"))
    return df.join(_small(side), F.col(col) == F.col("_gnode"), "left").withColumn(label, F.coalesce("_glabel", F.col(col))).drop("_gnode", "_glabel")


def pivot_pairs(banded: DataFrame, rank: list[Column], groups: DataFrame | None) -> DataFrame:
    """(a, b): each node with the first by ``rank`` of every bucket it lies in, unless they are in one group."""
    pivots = banded.groupBy("band").agg(F.max(F.struct(*rank, "node")).alias("p"), F.count(F.lit(1)).alias("c")).where("c > 1")
    met = banded.join(written(pivots.select("band", F.col("p.node").alias("b")), "pivots"), "band").where("node <> b")
    pairs = met.select(F.col("node").alias("a"), "b").distinct()
    if groups is None:
        return pairs
    return _labelled(_labelled(written(pairs, "pairs"), groups, "a", "ga"), groups, "b", "gb").where("ga <> gb").select("a", "b")


def opened_pairs(features: DataFrame, groups: DataFrame, sketches: DataFrame) -> DataFrame:
    """(a, b) of different groups where the matrix has a prefix token of one in the other's group and all bounds hold."""
    own = _labelled(features.where("prefix IS NOT NULL").select("node", "n", "prefix"), groups, "node", "g")
    at = own.select("node", "g", "n", F.posexplode("prefix").alias("pos", "token"))
    posts = at.select("token", "node", "g", (F.shiftleft("n", 24) + F.col("pos")).alias("np")).repartition("token")
    matrix = posts.groupBy("token", "g").agg(F.count(F.lit(1)).alias("c"))
    crossed = matrix.groupBy("token").agg(F.max(F.struct("c", "g")).alias("top"), F.count(F.lit(1)).alias("groups")).where("groups > 1").select("token", F.col("top.g").alias("top"))
    found = posts.join(crossed, "token").select("token", "node", "g", F.shiftright("np", 24).alias("n"), (F.col("np") % (1 << 24)).alias("pos"), "top").distinct()
    rows = written(found.join(sketches.select("node", _short("bits").alias("bits")), "node"), "crossed")
    a = rows.where("g <> top").select("token", F.col("node").alias("a"), F.col("n").alias("na"), F.col("g").alias("ga"), F.col("pos").alias("pa"), F.col("bits").alias("bits_a"))
    b = rows.select("token", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("g").alias("gb"), F.col("pos").alias("pb"), F.col("bits").alias("bits_b"), (F.col("g") == F.col("top")).alias("big"))
    fits = F.expr("ga <> gb AND (big OR a < b) AND 5 * na >= 4 * nb AND 5 * nb >= 4 * na")
    smaller = F.expr("CASE WHEN na < nb OR (na = nb AND a < b) THEN pa < na - (8 * na + 8) div 9 + 1 ELSE pb < nb - (8 * nb + 8) div 9 + 1 END")
    # what stands before their first common token is in one of the two alone: too much of that, and they can't link
    before = F.expr("9 * (pa + pb) <= na + nb")
    alike = 9 * _differing("bits_a", "bits_b") <= F.col("na") + F.col("nb")
    return a.join(b, "token").where(fits & smaller & before & alike).select("a", "b").distinct()


def _joined(df: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(_id, _th, n_shingles, _label): the component of every row, by a node of it; null without words."""
    features = set_features(df, id_col, text_col, n)
    check = Verifier(df, features, id_col, text_col, n)
    banded = features.where("bands IS NOT NULL").select("node", "hot", F.explode("bands").alias("band")).distinct()
    banded = written(banded, "bands")
    links = check.links(pivot_pairs(banded, [F.col("hot")], None))
    groups = components(links)
    # another pivot in every bucket, so that a node meets several of its group
    more = check.links(pivot_pairs(banded, [F.xxhash64("node", "band")], groups))
    links = links.unionByName(more)
    groups = components(links)
    links = links.unionByName(check.links(opened_pairs(features, groups, check.sketches)))
    rows = features.select("_id", "_th", F.col("n").alias("n_shingles"), "node")
    return written(_labelled(rows, components(links), "node", "_label").drop("node"), "labelled")


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5) -> DataFrame:
    """(id, n_shingles, component_id): a row per row of df; component_id is the least id reachable by links.

    Words are lower-cased in A-Z and parted by ASCII white space. Texts without words, empty and null ones have
    no shingles, link with nothing and are components of their own. Rows that repeat are linked. A null id
    is no least id; a component of null ids alone has a null id. An empty table has no rows; other columns
    are not read.
    """
    labelled = _joined(df, id_col, text_col, n)
    least = written(labelled.where("_label IS NOT NULL").groupBy("_label").agg(F.min("_id").alias("component_id")), "least")
    alone = F.when(F.col("n_shingles") == 0, F.col("_id")).otherwise(F.col("component_id"))
    return labelled.join(least, "_label", "left").select(F.col("_id").alias(id_col), "n_shingles", alone.alias("component_id"))


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5) -> DataFrame:
    """The rows of df that stay if every component keeps its row of the least id (then text hash).

    Rows without words are components of their own and stay. Of rows that repeat in id and text one stays.
    """
    inner, own = shielded(df)
    id_col, text_col = own[id_col], own[text_col]
    labelled = _joined(inner, id_col, text_col, n)
    first = labelled.where("_label IS NOT NULL").groupBy("_label").agg(F.min(F.struct("_id", "_th")).alias("k")).select("k._th", F.col("k._id").alias("_kid"))
    keep = written(first.unionByName(labelled.where("n_shingles = 0").select("_th", F.col("_id").alias("_kid"))).distinct(), "kept")
    keyed = inner.select("*", *text_key(id_col, text_col))
    left = keyed.join(keep.withColumnRenamed("_th", "_kth").hint("merge"), (F.col("_th") == F.col("_kth")) & F.col("_id").eqNullSafe(F.col("_kid")), "left_semi")
    return left.dropDuplicates(["_id", "_th"]).drop("_id", "_th").toDF(*df.columns)


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, (SELECT min(b) FROM r WHERE r.a = d.doc_id)::BIGINT AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""
