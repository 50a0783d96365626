"""Best-fit packing of documents into sequences of a fixed token length, by minimum bin slack.

Documents become pieces of at most ``capacity`` tokens. Packing depends on the lengths alone, so the
histogram of lengths (at most ``capacity`` numbers, whatever the corpus) is packed, and pieces take the
places by their rank among pieces of equal length. A bin starts with the longest length left; a bitset
(bit s: the sum s can be reached) over the lengths left finds the fullest combination, which is removed as
often as the lengths allow. Ranks come from each task's own counts plus the counts of the tasks before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from prepkit.llm.bpe import encoder
from prepkit.llm.common import texts_of, written


class Place(NamedTuple):
    """Ranks ``rank`` on of a length lie in bins ``bin`` on, ``each`` in a bin, from ``offset``."""

    length: int
    rank: int
    bin: int
    each: int
    offset: int


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of lengths (no more of each than there are) with the largest sum up to ``room``.

    Longer lengths are tried first, and among equal sums the walk back prefers shorter ones left out.
    """
    mask, sums, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n in counts if n <= room and counts[n]), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((length, take, sums))
            sums |= (sums << (length * take)) & mask
            left, take = left - take, take * 2
        if sums >> room & 1:
            break
    at, used = sums.bit_length() - 1, {}
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def minimum_bin_slack(histogram: dict[int, int], capacity: int) -> list[Place]:
    """Places for all pieces of the histogram {length: count}, 1 <= length <= capacity."""
    counts = {n: c for n, c in histogram.items() if c}
    done = dict.fromkeys(counts, 0)
    places, bins = [], 0
    while any(counts.values()):
        longest = max(n for n, c in counts.items() if c)
        counts[longest] -= 1
        used = fullest(counts, capacity - longest)
        counts[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times, offset = min(counts[n] // c for n, c in used.items()), 0
        for n in sorted(used, reverse=True):
            places.append(Place(n, done[n], bins, used[n], offset))
            done[n] += used[n] * times
            counts[n] -= used[n] * times
            offset += n * used[n]
        bins += times
    return places


def token_pieces(df: DataFrame, path: str, id_col: str, text_col: str, capacity: int, end_id: int) -> DataFrame:
    """A row per piece, with the task and the rank of the piece among the task's pieces of its length."""
    results = [("piece", IntegerType()), ("start", LongType()), ("length", LongType()), ("ids_crc32", LongType()),
               ("_task", IntegerType()), ("_rank", LongType())]
    schema = StructType([StructField(id_col, df.schema[id_col].dataType), *(StructField(n, t) for n, t in results)])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task = encoder(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            owner, rows = [], []
            for i, ids in enumerate(enc.ids(texts_of(batch, text_col))):
                ids += end
                n = len(ids) // 4
                cuts = [0, n] if n <= capacity else [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    owner.append(i)
                    rows.append((k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), task, int(seen[b - a])))
                    seen[b - a] += 1
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(id_col).take(pa.array(owner, pa.int64())),
                     *(pa.array(c, pa.int32() if n in ("piece", "_task") else pa.int64()) for (n, _), c in zip(results, zip(*rows, strict=True), strict=True))],
                    names=schema.fieldNames())

    return df.select(id_col, text_col).mapInArrow(run, schema)


def best_fit_pack(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2,
) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32, sequence_id, offset): where each piece of each document lies.

    Every document ends with ``end_id``. Only documents longer than ``capacity`` are cut; their first piece
    is the shorter one. A null or empty text is the end token alone; rows that repeat are packed each; an
    empty table has no rows; other columns are not read.
    """
    pieces = written(token_pieces(df, path, id_col, text_col, capacity, end_id), "pieces")
    counts = written(pieces.groupBy("length", "_task").agg(F.count(F.lit(1)).alias("n")), "lengths")
    before = counts.select("length", "_task", (F.sum("n").over(Window.partitionBy("length").orderBy("_task")) - F.col("n")).alias("_before"))
    histogram = {int(r[0]): int(r[1]) for r in counts.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    places = sorted(minimum_bin_slack(histogram, capacity))
    starts = {n: i for i, n in reversed(list(enumerate(p.length for p in places)))}
    ends = {p.length: i + 1 for i, p in enumerate(places)}
    columns = [np.array(c, np.int64) for c in zip(*places, strict=True)] or [np.zeros(0, np.int64)] * 5
    shared = df.sparkSession.sparkContext.broadcast(columns)  # a few numbers for each length and pattern

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, rank, bin_, each, offset = shared.value
        for batch in batches:
            length, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_own"))
            at = np.empty(len(length), np.int64)
            for n in np.unique(length):
                own_n = length == n
                a, b = starts[n], ends[n]
                at[own_n] = a + np.searchsorted(rank[a:b], own[own_n], "right") - 1
            j = own - rank[at]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(bin_[at] + j // each[at]), pa.array(offset[at] + j % each[at] * length)],
                names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    kept = [id_col, "piece", "start", "length", "ids_crc32"]
    ranked = pieces.join(before, ["length", "_task"]).select(*kept, (F.col("_rank") + F.col("_before")).alias("_own"))
    schema = StructType([*(f for f in ranked.schema.fields[:-1]), StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return ranked.mapInArrow(place, schema)
