"""Elements of JSON arrays, from files that are cut into many ranges.

A file is read by Spark's splittable text source with ``}`` as the end of a line, so that a file without line breaks is
many tasks too. Whether a piece begins inside a string, and how deep, depends on all pieces before it: each range tells how
it maps the state, for both ways it may begin, with the depth it adds; a scan over a file's ranges gives the true state
of each. An object of the array ends where a piece ends at depth 1. What a range's first object lacks, and what its
last one has, are fragments that are joined by file and range.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prepkit.functions.sizing import ensure_checkpoint_dir
from prepkit.sources.records import HEAD, MIDDLE, TAIL, WHOLE, _ranges

#: Marks that change the state: a backslash with what it escapes, quotes, brackets.
_MARK = re.compile(r'\\.|["{}\[\]]', re.S)
_MAPS = "file bigint, start bigint, string_outside boolean, depth_outside bigint, string_inside boolean, depth_inside bigint, array boolean"
_PARTS = "file bigint, start bigint, part int, text string"


def advance(piece: str, inside: bool) -> tuple[bool, int]:
    """The state after a piece that began outside or inside a string: inside a string or not, and the depth it adds."""
    depth = 0
    for found in _MARK.finditer(piece):
        mark = found.group()
        if mark == '"':
            inside = not inside
        elif not inside and mark in "{[":
            depth += 1
        elif not inside and mark in "}]":
            depth -= 1
    return inside, depth


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): texts between closing braces, in order inside each range of a file."""
    pieces = spark.read.option("lineSep", "}").text(path)
    return pieces.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _closed(piece: str) -> str:
    return piece + "}"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def _maps(pieces: DataFrame) -> DataFrame:
    """What each range does to the state; array: the file begins with an opening bracket (of its first range)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list] = {}
        for key, values in _ranges(batches):
            if key not in found:
                found[key] = [False, 0, True, 0, key[1] > 0 or values[0].lstrip("\ufeff \t\r\n").startswith("[")]
            now = found[key]
            for piece in map(_closed, values):
                for i in (0, 2):
                    now[i], added = advance(piece, now[i])
                    now[i + 1] += added
        if found:
            yield _batch([(*key, *state) for key, state in found.items()], _MAPS)

    return pieces.mapInArrow(work, _MAPS)


def _scan(table: pa.Table) -> pa.Table:
    table = table.sort_by("start")
    inside, depth, states = False, 0, []
    for string_outside, depth_outside, string_inside, depth_inside in zip(*(table[c].to_pylist() for c in ("string_outside", "depth_outside", "string_inside", "depth_inside")), strict=True):
        states.append((inside, depth))
        inside, depth = (string_inside, depth + depth_inside) if inside else (string_outside, depth + depth_outside)
    return pa.table([table["file"], table["start"], pa.array([s for s, _ in states], pa.bool_()), pa.array([d for _, d in states], pa.int64()), table["array"]],
                    names=["file", "start", "inside", "depth", "array"])


def _parts(pieces: DataFrame, states: dict[tuple[int, int], tuple[bool, int]]) -> DataFrame:
    known = pieces.sparkSession.sparkContext.broadcast(states)  # a row for each range of a file, some 100 MB

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, inside, depth, head = None, [], False, 0, False
        for found, values in _ranges(batches):
            rows = []
            if found != key:
                if held:
                    rows.append((*key, MIDDLE if head else TAIL, "".join(held)))
                key, held = found, []
                inside, depth = known.value[found]
                head = found[1] > 0 and (inside or depth > 1)
            for piece in map(_closed, values):
                held.append(piece)
                inside, added = advance(piece, inside)
                depth += added
                if not inside and depth == 1:
                    rows.append((*key, HEAD if head else WHOLE, "".join(held)))
                    held, head = [], False
            if rows:
                yield _batch(rows, _PARTS)
        if held:
            yield _batch([(*key, MIDDLE if head else TAIL, "".join(held))], _PARTS)

    return pieces.mapInArrow(work, _PARTS)


def array_objects(spark: SparkSession, path: str) -> DataFrame | None:
    """(text): every object of the files' arrays; None where a file is not an array."""
    pieces = _pieces(spark, path)
    found = _maps(pieces).groupBy("file").applyInArrow(_scan, "file bigint, start bigint, inside boolean, depth bigint, array boolean").collect()
    if not found or not all(r["array"] for r in found):
        return None
    parts = _parts(pieces, {(r["file"], r["start"]): (r["inside"], r["depth"]) for r in found})
    order = Window.partitionBy("file").orderBy("start", "part")
    some = parts.where(f"part <> {WHOLE}").withColumn("began", F.last(F.when(F.col("part") == TAIL, F.col("start")), ignorenulls=True).over(order))
    joined = some.groupBy("file", "began").agg(F.sort_array(F.collect_list(F.struct("start", "part", "text"))).alias("p"))
    texts = parts.where(f"part = {WHOLE}").select("text").unionByName(joined.select(F.array_join("p.text", "").alias("text")))
    # what stands between objects goes; line breaks outside strings are blanks, and inside them JSON has none
    bare = F.regexp_replace("text", r"^[\s\x{FEFF}]*(\[|,)?\s*", "")
    return texts.select(F.regexp_replace(bare, r"[\r\n]+", " ").alias("text")).where(~F.col("text").rlike(r"^\]?\s*\}?$"))


def read_arrays(spark: SparkSession, path: str) -> DataFrame | None:
    """The files' objects with the schema that Spark infers from all of them; None where a file is no array of objects.

    The objects are written once, a line each, to the shared checkpoint folder.
    """
    objects = array_objects(spark, path)
    if objects is None:
        return None
    ensure_checkpoint_dir(spark)
    home = f"{spark.sparkContext.getCheckpointDir()}/elements-{uuid.uuid4().hex}"
    objects.write.text(home)
    lines = spark.read.text(home)
    if lines.where(~F.col("value").startswith("{")).isEmpty():
        return spark.read.json(home)
    return None  # an array of other things than objects
