"""Repeatable splits, folds, label codes and minority oversampling, independent of partitioning."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepkit.functions.columns import quoted
from prepkit.functions.hashing import hash_unit, row_digest
from prepkit.functions.sizing import bucket_count, lookup_side
from prepkit.operators.ordering import hash_ranks
from prepkit.operators.profile import label_codes


def encode_labels(df: DataFrame, target: str, out: str = "label") -> DataFrame:
    """Labels as sorted text -> 0..k-1 (numbers are compared as text, as their names would be)."""
    text = df.withColumn("_text", F.coalesce(quoted(target).cast("string"), F.lit("nan")))
    codes = label_codes(text, "_text").select(F.col("label").alias("_text"), F.col("code").alias(out))
    return text.join(lookup_side(codes), "_text").drop("_text")


def decode_labels(df: DataFrame, codes: DataFrame, code: str, out: str) -> DataFrame:
    """Back from codes to label text, with the (label, code) table."""
    back = codes.select(F.col("label").alias(out), F.col("code").cast("double").alias("_code"))
    return df.join(back, F.col(code).cast("double") == F.col("_code"), "left").drop("_code")


def stratified_split(df: DataFrame, key: Sequence[str], label: str | None = None, test_size: float = 0.2,
                     seed: int = 42, out: str = "is_test") -> DataFrame:
    """Mark the first ceil(test_size * n) rows of each label in hash order as test rows.

    Only label counts are joined back; ranks come from hash ranges, so one dominant label is spread.
    """
    groups = [label] if label else []
    ranked = hash_ranks(df, groups, key, seed)
    if label:
        sizes = df.groupBy(quoted(label)).agg(F.count("*").alias("_n"))
        sizes = lookup_side(sizes.withColumnRenamed(label, "_l"))
        ranked = ranked.join(sizes, quoted(label).eqNullSafe(F.col("_l"))).drop("_l")
    else:
        ranked = ranked.withColumn("_n", df.agg(F.count("*")).scalar())
    return ranked.withColumn(out, F.col("_rank") <= F.ceil(F.col("_n") * test_size)).drop("_rank", "_n")


def fold_assign(df: DataFrame, key: Sequence[str], label: str | None = None, k: int = 5, seed: int = 42,
                out: str = "fold") -> DataFrame:
    """Folds 0..k-1: the hash rank within the label, modulo k."""
    ranked = hash_ranks(df, [label] if label else [], key, seed)
    return ranked.withColumn(out, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


# --- oversampling --------------------------------------------------------------------------


#: Rows of a block of points, and pairs of points whose scores (8 bytes each) or differences are held at a time.
BLOCK, PAIRS, EXACT_PAIRS = 1 << 15, 1 << 20, 1 << 15
#: Blocks that a cell of few points is cut into, so that its pairs of blocks keep many tasks busy.
EVEN_BLOCKS, BLOCK_LEAST, TASKS = 8, 1024, 1000


def k_nearest(qi: np.ndarray, q: np.ndarray, ti: np.ndarray, t: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, neighbour, distance) of the k nearest other points among t of each q; ties go to the smaller id.

    Products of matrices tell which points can be among the k nearest, with a margin above their rounding errors;
    those alone are measured exactly. The k-th least of the minima of groups of points bounds the k-th distance.
    """
    with np.errstate(over="ignore", invalid="ignore"):  # such distances are left out below
        return _k_nearest(qi, q, ti, t, k)


def _first_copies(t: np.ndarray, most: int) -> np.ndarray:
    """Places of the rows, less those that have ``most`` equal rows before them: as near as these, they lose every tie."""
    _, group = np.unique(np.ascontiguousarray(t + 0.0).view(f"V{t.itemsize * t.shape[1]}").ravel(), return_inverse=True)
    by = np.argsort(group, kind="stable")
    nth = np.arange(len(by)) - np.searchsorted(group[by], group[by], "left")
    return np.sort(by[nth < most])


def _k_nearest(qi: np.ndarray, q: np.ndarray, ti: np.ndarray, t: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(ti, kind="stable")
    order = order[_first_copies(t[order], k + 1)]
    ti, t = ti[order], t[order]
    squares = (t * t).sum(1)
    right = np.column_stack([-2.0 * t, squares]).T
    margin = 8 * (t.shape[1] + 2) * np.finfo(float).eps * ((q * q).sum(1) + squares.max())
    first, last = np.searchsorted(ti, qi, "left"), np.searchsorted(ti, qi, "right")
    per = max(1, min(32, len(t) // (4 * k)))
    even = len(t) // per * per
    ids, near, dist = [], [], []
    step = max(1, PAIRS // len(t))
    for lo in range(0, len(q), step):
        own = q[lo : lo + step]
        score = np.column_stack([own, np.ones(len(own))]) @ right
        for i in np.flatnonzero(last[lo : lo + step] > first[lo : lo + step]):
            score[i, first[lo + i] : last[lo + i]] = np.inf
        least = np.column_stack([score[:, :even].reshape(len(own), per, -1).min(1), score[:, even:]])
        bound = np.partition(least, k - 1, axis=1)[:, k - 1] if least.shape[1] > k else np.full(len(own), np.inf)
        row, col = np.nonzero(~(score > (bound + margin[lo : lo + step])[:, None]))  # what is not a number is measured
        d = np.concatenate([np.empty(0), *(np.sqrt(((own[row[a : a + EXACT_PAIRS]] - t[col[a : a + EXACT_PAIRS]]) ** 2).sum(-1))
                                           for a in range(0, len(row), EXACT_PAIRS))])
        keep = np.isfinite(d) & ((col < first[lo + row]) | (col >= last[lo + row]))
        row, col, d = row[keep], col[keep], d[keep]
        by = np.lexsort((col, d, row))
        row, col, d = row[by], col[by], d[by]
        keep = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
        ids.append(qi[lo + row[keep]])
        near.append(ti[col[keep]])
        dist.append(d[keep])
    return np.concatenate(ids), np.concatenate(near), np.concatenate(dist)


def nearest_neighbours(points: DataFrame, key: str, features: str, k: int = 5,
                       pivots: int | None = None) -> DataFrame:
    """Exact k nearest other points of every point: (key, rank, neighbour, distance).

    Points are assigned to their nearest pivot. Each point first finds k neighbours inside its own
    cell; their distance bounds the search, and the triangle inequality tells which other cells can
    hold a nearer point. Only those cells get a copy of the point. Cells are cut into blocks of
    bounded size by hash, so a dense cell is many tasks, and no pair of points is ever a row. All
    pairs of points of the searched cells are scored, so time grows with their square.
    """
    if pivots is None:
        ranges = bucket_count(points)
        pivots = 1 if ranges == 1 else int(min(2000, 16 * ranges))
    base = points.select(F.col(key).alias("id"), F.col(features).cast("array<double>").alias("v"))
    # pivots: the first rows in hash order, a fixed number of vectors
    centres = np.array([r["v"] for r in base.orderBy(row_digest(["id"], "pivot"), "id").limit(pivots).collect()])

    def assign(batches):
        for pdf in batches:
            v = np.stack(pdf["v"].to_numpy())
            best = np.empty(len(v), dtype="int64")
            dist = np.empty(len(v))
            step = max(1, EXACT_PAIRS // len(centres))
            for lo in range(0, len(v), step):
                d = np.sqrt(((v[lo:lo + step, None, :] - centres[None]) ** 2).sum(-1))
                best[lo:lo + step], dist[lo:lo + step] = d.argmin(1), d.min(1)
            yield pd.DataFrame({"id": pdf["id"], "v": pdf["v"], "cell": best, "d0": dist})

    if len(centres) == 0:
        return base.select("id", F.lit(0).alias("rank"), F.col("id").alias("neighbour"), F.lit(0.0).alias("distance")).limit(0)
    celled = base.mapInPandas(assign, "id bigint, v array<double>, cell bigint, d0 double")
    shape = {r["cell"]: (r["n"], r["radius"]) for r in celled.groupBy("cell").agg(
        F.count("*").alias("n"), F.max("d0").alias("radius")).collect()}

    def cut(n: int) -> int:
        """Blocks of n points."""
        return max(-(-n // BLOCK), min(EVEN_BLOCKS, -(-n // BLOCK_LEAST)))

    blocks = {c: cut(n) for c, (n, _) in shape.items()}
    block_of = F.create_map(*[x for c, b in blocks.items() for x in (F.lit(c), F.lit(b))])[F.col("cell")]
    target = celled.withColumn("block", F.pmod(F.xxhash64("id"), block_of))

    def nearest(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = (np.empty(0, "int64"), np.empty(0, "int64"), np.empty(0))
        if len(left) and len(right):
            found = k_nearest(left["id"].to_numpy(), np.stack(left["v"].to_numpy()),
                              right["t_id"].to_numpy(), np.stack(right["t_v"].to_numpy()), k)
        return pd.DataFrame(dict(zip(("id", "neighbour", "distance"), found, strict=True)))

    def per_cell(counts: dict) -> Column:
        return F.create_map(*[x for c, b in counts.items() for x in (F.lit(c), F.lit(b))])[F.col("cell")]

    def search(queries: DataFrame, sizes: dict[int, int]) -> DataFrame:
        """Every query meets every block of its cell; both sides of a task are of bounded size."""
        chunks = {c: cut(n) for c, n in sizes.items()}
        tasks = min(TASKS, 2 * sum(n * blocks[c] for c, n in chunks.items()))
        asked = (queries.withColumn("chunk", F.pmod(F.xxhash64("id", F.lit(7)), per_cell(chunks)))
                 .withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), per_cell(blocks).cast("bigint") - 1))))
        held = (target.filter(F.col("cell").isin(list(chunks)))
                .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), per_cell(chunks).cast("bigint") - 1))))
        held = held.select(*[F.col(c).alias(f"t_{c}") for c in ("id", "v", "cell", "block", "chunk")])
        asked = asked.repartition(tasks, "cell", "block", "chunk")
        held = held.repartition(tasks, "t_cell", "t_block", "t_chunk")
        return (asked.groupBy("cell", "block", "chunk").cogroup(held.groupBy("t_cell", "t_block", "t_chunk"))
                .applyInPandas(nearest, "id bigint, neighbour bigint, distance double"))

    def best(found: DataFrame) -> DataFrame:
        # at most k candidates per searched block
        return found.groupBy("id").agg(
            F.slice(F.array_sort(F.collect_list(F.struct("distance", "neighbour"))), 1, k).alias("near"))

    own = search(celled.select("id", "v", "cell"), {c: n for c, (n, _) in shape.items()})
    if len(shape) > 1:
        bound = best(own).select("id", F.when(F.size("near") >= k, F.element_at("near", -1)["distance"]).alias("r"))
        cells = sorted(shape)
        radii = np.array([shape[c][1] for c in cells])

        def reach(batches):
            for pdf in batches:
                rows = []
                for i, v, cell, r in zip(pdf["id"], pdf["v"], pdf["cell"], pdf["r"]):
                    d = np.sqrt(((centres[cells] - v) ** 2).sum(-1))
                    limit = np.inf if pd.isna(r) else r
                    rows += [(i, v, c) for c, dd, rad in zip(cells, d, radii) if c != cell and dd - rad <= limit + 1e-9]
                yield pd.DataFrame(rows, columns=["id", "v", "cell"]).astype({"id": "int64", "cell": "int64"}) if rows \
                    else pd.DataFrame({"id": pd.Series(dtype="int64"), "v": pd.Series(dtype="object"), "cell": pd.Series(dtype="int64")})

        more = celled.join(bound, "id", "left").mapInPandas(reach, "id bigint, v array<double>, cell bigint")
        sizes = {r["cell"]: r["count"] for r in more.groupBy("cell").count().collect()}
        if sizes:
            own = own.unionByName(search(more, sizes))
    near = best(own)
    return near.select("id", F.posexplode("near").alias("pos", "x")).select(
        "id", (F.col("pos") + 1).alias("rank"), F.col("x.neighbour").alias("neighbour"), F.col("x.distance").alias("distance"))


def oversample_minority(df: DataFrame, key: str, label: str, features: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Add synthetic rows (key NULL) until every class has as many rows as the largest.

    A synthetic row lies between a class member and one of its k nearest members. Member i of m gets
    floor or ceil of (missing / m) rows, so all of them take part; neighbour and position are drawn
    from hashes. A class of one row is copied.
    """
    sizes = {r["y"]: r["n"] for r in df.groupBy(F.col(label).alias("y")).agg(F.count("*").alias("n")).collect()}
    top = max(sizes.values())
    kind = df.schema[key].dataType
    out = df.select(F.col(key), F.col(label), F.col(features).cast("array<double>").alias(features))
    for y, n in sorted(sizes.items(), key=lambda x: str(x[0])):
        if n == top:
            continue
        need = top - n
        members = out.filter(F.col(label).eqNullSafe(F.lit(y)) & F.col(key).isNotNull())
        near = nearest_neighbours(members, key, features, k).groupBy(F.col("id").alias("_of")).agg(
            F.map_from_entries(F.collect_list(F.struct("rank", "neighbour"))).alias("near"))
        ranked = hash_ranks(members, [], [key], seed)
        copies = F.lit(need // n) + (F.col("_rank") <= need % n).cast("int")
        drawn = (ranked.withColumn("_copies", copies).filter("_copies > 0")
                 .withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
                 .join(near, F.col(key) == F.col("_of"), "left"))
        pick = (F.floor(hash_unit([key, "_i"], f"{seed}n") * F.size("near")) + 1).cast("int")
        drawn = drawn.select(F.col(label), F.col(features).alias("_a"), F.coalesce(F.col("near")[pick], F.col(key)).alias("_b_id"),
                             hash_unit([key, "_i"], f"{seed}u").alias("_u"))
        other = members.select(F.col(key).alias("_b_id"), F.col(features).alias("_b"))
        made = drawn.join(other, "_b_id").select(
            F.lit(None).cast(kind).alias(key), F.col(label),
            F.zip_with("_a", "_b", lambda a, b: a + (b - a) * F.col("_u")).alias(features))
        out = out.unionByName(made)
    return out
