"""CSV records that span lines, from files that are cut into many ranges.

Lines are read by Spark's splittable text source. Whether a line begins inside a quoted value depends on all lines before
it, so each range first tells how it maps that state, for both ways it may begin; a scan over a file's ranges then gives
the true state of each, and ranges put their lines together to records from there. What a range's first record lacks,
and what its last one has, are fragments that are joined by file and range. Where no record spans lines, Spark's own
reader splits the files as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CLOSING = re.compile(r'(?:[^"]+|"")*+"')
_MAPS = "file bigint, start bigint, after_outside boolean, after_inside boolean, spans_outside boolean"
_PARTS = "file bigint, start bigint, part int, first boolean, text string"
#: Parts of records: whole ones, the end of one that began in an earlier range, lines in the midst of one, the beginning of one.
WHOLE, HEAD, MIDDLE, TAIL = range(4)


class Quotes:
    """Whether a line ends inside a quoted value; quotes open at the start of a field and are doubled inside."""

    def __init__(self, sep: str) -> None:
        self._opening = re.compile(rf'(?:^|{re.escape(sep)})"')

    def ends_inside(self, line: str, inside: bool) -> bool:
        at = 0
        while True:
            if not inside:
                found = self._opening.search(line, at)
                if not found:
                    return False
                at = found.end()
            found = _CLOSING.match(line, at)
            if not found:
                return True
            at, inside = found.end(), False


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): physical lines in order inside each range of a file."""
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], list[str]]]:
    """((file, start), lines): consecutive lines of one range, in pieces."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        values, first = batch.column(2).to_pylist(), 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[first]:
                yield keys[first], values[first:i]
                first = i


def range_maps(lines: DataFrame, sep: str) -> DataFrame:
    """How each range with quotes maps the state, and whether a line ends inside where it begins outside."""
    quotes = Quotes(sep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[bool]] = {}
        for key, values in _ranges(batches):
            now = found.setdefault(key, [False, True, False])
            for line in values:
                outside, inside = now[0], now[1]
                after_outside = quotes.ends_inside(line, outside)
                now[1] = after_outside if inside == outside else quotes.ends_inside(line, inside)
                now[0] = after_outside
                now[2] = now[2] or after_outside
        if found:
            rows = [(*key, *state) for key, state in found.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64(), pa.int64(), *[pa.bool_()] * 3], strict=True)],
                                             names=[f.split()[0] for f in _MAPS.split(", ")])

    return lines.where(F.contains("value", F.lit('"'))).mapInArrow(work, _MAPS)


def _scan(table: pa.Table) -> pa.Table:
    """The state that each range of a file begins in, and whether a record of it spans lines."""
    table = table.sort_by("start")
    inside, states, spans = False, [], []
    for after_outside, after_inside, spans_outside in zip(*(table[c].to_pylist() for c in ("after_outside", "after_inside", "spans_outside")), strict=True):
        states.append(inside)
        spans.append(inside or spans_outside)
        inside = after_inside if inside else after_outside
    return pa.table([table["file"], table["start"], pa.array(states, pa.bool_()), pa.array([inside] * len(states), pa.bool_()), pa.array(spans, pa.bool_())],
                    names=["file", "start", "inside", "open_end", "spans"])


def range_states(maps: DataFrame) -> list[tuple[int, int, bool, bool, bool]]:
    """(file, start, inside, open_end, spans) of each range with quotes, on the driver: a row for each range of a file, some 100 MB.

    The ranges of one file are one group.
    """
    out = maps.groupBy("file").applyInArrow(_scan, "file bigint, start bigint, inside boolean, open_end boolean, spans boolean")
    return [tuple(r) for r in out.collect()]


def _parts(lines: DataFrame, states: list[tuple[int, int, bool, bool, bool]], sep: str) -> DataFrame:
    """Parts of records, by range."""
    quotes = Quotes(sep)
    own = {(file, start): inside for file, start, inside, _, _ in states} | {(file, -1): end for file, _, _, end, _ in states}
    known = lines.sparkSession.sparkContext.broadcast(own)  # a row for each range of a file
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = known.value
        by_file: dict[int, list[int]] = {}
        for file, start in sorted(k for k in starts if k[1] >= 0):
            by_file.setdefault(file, []).append(start)

        def begins(key: tuple[int, int]) -> bool:
            """A range without quotes begins as the next one with quotes does; after the last one, as the file goes on."""
            if key in starts:
                return starts[key]
            after = next((s for s in by_file.get(key[0], []) if s > key[1]), None)
            return starts[key[0], after] if after is not None else starts.get((key[0], -1), False)

        key, held, inside, head, first = None, [], False, False, False

        def ended(part: int) -> tuple:
            return (*key, part, first, "\n".join(held))

        for found, values in _ranges(batches):
            rows = []
            if found != key:
                if held:
                    rows.append(ended(MIDDLE if head else TAIL))
                key, held, inside, first = found, [], begins(found), found[1] == 0
                head = inside
            marked = pc.match_substring(pa.array(values, pa.string()), '"').to_pylist()
            for line, has in zip(values, marked, strict=True):
                held.append(line)
                inside = quotes.ends_inside(line, inside) if has else inside
                if not inside:
                    if held[-1].endswith("\r"):
                        held[-1] = held[-1][:-1]
                    if head or len(held) > 1 or held[0]:
                        rows.append(ended(HEAD if head else WHOLE))
                        first = False
                    held, head = [], False
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in _PARTS.split(", ")])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(ended(MIDDLE if head else TAIL), kinds, strict=True)], names=[f.split()[0] for f in _PARTS.split(", ")])

    return lines.mapInArrow(work, _PARTS)


def spanning_records(spark: SparkSession, path: str, sep: str) -> DataFrame | None:
    """(text, first) of every record of the files, first: a file's header; None where no record spans lines."""
    lines = _lines(spark, path)
    states = range_states(range_maps(lines, sep))
    if not any(spans for *_, spans in states):
        return None
    parts = _parts(lines, states, sep)
    order = Window.partitionBy("file").orderBy("start", "part")
    pieces = parts.where(f"part <> {WHOLE}").withColumn("began", F.last(F.when(F.col("part") == TAIL, F.col("start")), ignorenulls=True).over(order))
    joined = pieces.groupBy("file", "began").agg(F.sort_array(F.collect_list(F.struct("start", "part", "text"))).alias("p"), F.max("first").alias("first"))
    whole = parts.where(f"part = {WHOLE}").select("text", "first")
    return whole.unionByName(joined.select(F.array_join("p.text", "\n").alias("text"), "first"))
