"""Exact top-k inner products over integer vectors, by descending length and rotated partial sums.

Vectors are rotated by the singular vectors of all candidates (from their second-moment matrix, a sum of d x d
numbers), so that most of an inner product lies in the first components. Candidates are cut into blocks of
descending length. The block of the longest ones gives every query a first threshold, its k-th best score so far; after
that a block is opened for a query only if |query| x |longest in the block| can reach the threshold, and a
vector only if the partial sum over the first components plus Cauchy-Schwarz's bound on the rest can. What is
left is scored exactly in integers. Bounds are in floating point with a margin, and only skip.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prepkit.llm.common import written

#: Candidates of a block, and queries of a block.
BLOCK, QUERIES = 4096, 256
#: Components that the partial sums run over.
LEADING = 16


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """(id, v): floor(scale * x) of each component. Rows whose vector or a component is null or not finite go."""
    x = F.transform(vector_col, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    finite = ~F.exists(vector_col, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).where(finite).select(F.col(id_col).cast("long").alias("id"), x.cast("array<long>").alias("v"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, shorter ones padded with zeros."""
    values, offsets = np.asarray(column.values), np.asarray(column.offsets)
    offsets = offsets - offsets[0]
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(offsets[:-1], sizes)] = values[: offsets[-1]]
    return out


def _rotation(vectors: DataFrame, width: int) -> np.ndarray:
    """Columns: right singular vectors of all candidates, the largest singular value first."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            m = _matrix(batch.column("v"), width).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(list(total), pa.list_(pa.float64()))], names=["row", "sums"])

    sums = vectors.select("v").mapInArrow(moments, "row long, sums array<double>").select("row", F.posexplode("sums"))
    got = sums.groupBy("row", "pos").agg(F.sum("col").alias("s")).toArrow()
    gram = np.zeros((width, width))
    gram[got["row"].to_numpy(), got["pos"].to_numpy()] = got["s"].to_numpy()
    values, rotation = np.linalg.eigh((gram + gram.T) / 2)
    return rotation[:, np.argsort(-values)]


def best_of_block(qid: np.ndarray, q: np.ndarray, least: np.ndarray, cid: np.ndarray, c: np.ndarray, rotation: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, id, score) of each query's k best in a block, of those that reach ``least``; ties to smaller ids."""
    order = np.lexsort((cid, -(c.astype(float) ** 2).sum(1)))
    cid, c = cid[order], c[order]
    qr, cr = q.astype(float) @ rotation, c.astype(float) @ rotation
    lead = min(LEADING, c.shape[1])
    q_rest, c_rest = np.linalg.norm(qr[:, lead:], axis=1), np.linalg.norm(cr[:, lead:], axis=1)
    q_all, c_all = np.linalg.norm(qr, axis=1), np.linalg.norm(cr, axis=1)
    if q_all.max(initial=0) * c_all.max(initial=0) >= 2.0**62:
        c, q = c.astype(object), q.astype(object)  # products and sums of any size
    slack = 1e-6 * (q_all.max(initial=0) * c_all.max(initial=0) + 1)
    out = []
    for i in range(len(qid)):
        reach = int(np.searchsorted(-c_all, -(least[i] - slack) / max(q_all[i], 1e-9), "right")) if least[i] > 0 else len(cid)
        bound = cr[:reach, :lead] @ qr[i, :lead] + c_rest[:reach] * q_rest[i]
        at = np.flatnonzero((bound >= least[i] - slack) & (cid[:reach] != qid[i]))
        score = np.clip(c[at] @ q[i], -(2**63 - 1), 2**63 - 1).astype(np.int64) if len(at) else np.empty(0, np.int64)
        for j in np.lexsort((cid[at], -score))[:k]:
            if score[j] >= least[i]:
                out.append((int(qid[i]), int(cid[at[j]]), int(score[j])))
    return out


def top_inner_products(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every row whose id is divisible by ``every``.

    A query's candidates are all rows with another id. Vectors are integers (floor of 256 x); ties go to smaller
    ids. Vectors that are null or hold nulls or numbers that aren't finite take no part, as rows without an id;
    components and scores beyond 64 bits count as the nearest long; shorter vectors as padded with zeros; rows that repeat are candidates each; an empty table has no rows.
    Where an id divisible by ``every`` has several rows, each of them asks, and the k best of all are its results.
    """
    spark = df.sparkSession
    vectors = written(integer_vectors(df, id_col, vector_col).withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))), "vectors")
    seen = vectors.agg(F.max(F.size("v")), F.count(F.lit(1)), F.count(F.when(F.col("id") % every == 0, 1))).first()
    schema = "query_id long, vec_id long, score long"
    width = seen[0] or 0
    rotation = spark.sparkContext.broadcast(_rotation(vectors, width) if width else np.zeros((0, 0)))  # d x d numbers
    n_blocks, n_groups = -(-seen[1] // BLOCK) or 1, -(-seen[2] // QUERIES) or 1

    # Blocks by descending length; equal lengths are dealt by id, so that no length is one task's.
    cuts = vectors.repartitionByRange(n_blocks, F.desc("norm2"), "id").withColumn("block", F.spark_partition_id())
    blocks = written(cuts.groupBy("block", "norm2", "id", "v").agg(F.count(F.lit(1)).alias("copies")), "blocks")
    longest = blocks.groupBy("block").agg(F.max("norm2").alias("most"))
    # equal rows of an id ask once, and their results count as often as there are rows, of which k fill all places
    asking = vectors.where(F.col("id") % every == 0).groupBy("id", "v", "norm2").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("times"))
    queries = written(asking.select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.col("norm2").alias("q2"), "times",
                      F.pmod(F.xxhash64("id", "v"), F.lit(n_groups)).alias("part")), "queries")

    def opened(pairs: DataFrame) -> DataFrame:
        """Every (query group, block) is one task's group: at most some thousand candidates and hundreds of queries."""
        asked = pairs.select("part", "block", "query_id", "q", "least", F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<long>").alias("v"), F.col("times").alias("copies"))
        met = pairs.select("part", "block").distinct().join(blocks, "block").select("part", "block", F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("array<long>").alias("q"), F.lit(0).cast("long").alias("least"), "id", "v", "copies")

        def work(group: pa.Table) -> pa.Table:
            ask = group.filter(pa.compute.is_valid(group["query_id"]))
            have = group.filter(pa.compute.is_valid(group["id"]))
            times, copies = ask["copies"].to_numpy(), have["copies"].to_numpy()
            rows = best_of_block(
                np.repeat(ask["query_id"].to_numpy(), times), np.repeat(_matrix(ask["q"].combine_chunks(), width), times, axis=0), np.repeat(ask["least"].to_numpy(), times),
                np.repeat(have["id"].to_numpy(), copies), np.repeat(_matrix(have["v"].combine_chunks(), width), copies, axis=0), rotation.value, k)
            return pa.table([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else ([], [], []))], names=["query_id", "vec_id", "score"])

        return asked.unionByName(met).groupBy("part", "block").applyInArrow(work, schema)

    def best(found: DataFrame) -> DataFrame:
        line = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k)

    none = F.lit(-(2**63 - 1)).cast("long")
    start = longest.orderBy(F.desc("most")).limit(1).select("block")
    first = written(best(opened(queries.withColumn("least", none).join(F.broadcast(start)))), "first")
    known = first.groupBy("query_id").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("n"))
    asked = queries.join(known, "query_id", "left").withColumn("least", F.when(F.col("n") >= k, F.col("s")).otherwise(none))
    rest = longest.join(F.broadcast(start), "block", "left_anti")
    # blocks against query groups, bounded by the lengths alone (squares as doubles, with a margin)
    reach = (F.sqrt(F.col("q2")) * F.sqrt(F.col("most")) * (1 + 1e-9) + 1 >= F.col("least")) | (F.col("least") <= 0)
    further = opened(asked.join(rest, reach))
    return best(first.select("query_id", "vec_id", "score").unionByName(further)).select("query_id", "rank", "vec_id", "score")


SQL = r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
