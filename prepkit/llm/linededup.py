"""Removal of repeated multi-line chunks with content-defined boundaries.

Line hashes are rolled over two lines; a chunk ends where the rolled value is a local minimum. Boundaries depend
on the four lines around them alone, so that lines put in before a repeated passage shift nothing. Chunks of two
lines and more whose hash occurs again are compared byte by byte, and of equal ones the first (by id, then place)
stays. DataFrame functions only.

A chunk goes only if both its ends fall alike, so the edges of a shared passage, and passages shorter than a chunk,
are left. An exact step completes them: of the neighbouring lines that no removed chunk holds, each two that stand
before go as well, and each line of many words. What a removed chunk holds stands before in the chunk that stays,
so that leaving it out of this step changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepkit.llm.common import WORD, shielded, text_key, written

#: Repeated hashes (8 bytes each) up to which the filter of the second scan is sent to all tasks.
BROADCAST_ROWS = 1_000_000
#: A character that is no white space: lines without one are no lines to the operator.
FILLED = r"[^\x20\x09-\x0D]"
RESULTS = ["n_lines", "n_chunks", "lines_removed", "chunks_removed", "chunk_lines"]


def _line_hash(line: Column) -> Column:
    """The first 32 bits of the line's md5."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")


def _lined(df: DataFrame, text_col: str) -> DataFrame:
    """df with _lines (the text's lines), _at (numbers of the filled ones) and _ends (where in _at a chunk ends)."""
    lined = df.withColumn("_lines", F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1))
    filled = lined.withColumn("_at", F.filter(F.sequence(F.lit(1), F.size("_lines")), lambda i: F.element_at("_lines", i).rlike(FILLED)))
    hashed = filled.withColumn("_hashes", F.transform("_at", lambda i: _line_hash(F.element_at("_lines", i))))
    rolled = hashed.withColumn("_rolled", F.transform("_hashes", lambda h, k: h + 31 * F.coalesce(F.get("_hashes", k - 1), F.lit(0))))
    least = lambda k: (k > 1) & (F.get("_rolled", k - 1) < F.get("_rolled", k - 2)) & (F.get("_rolled", k - 1) <= F.get("_rolled", k))
    ends = F.filter(F.sequence(F.lit(1), F.size("_at")), lambda k: (k == F.size("_at")) | least(k))
    none = F.array().cast("array<int>")
    return rolled.withColumn("_ends", F.when(F.size("_at") > 0, ends).otherwise(none)).drop("_hashes", "_rolled")


def _runs(long_words: int) -> Column:
    """Array of (chunk, start, stop), line numbers from 1: chunks; then each two neighbours, and each long line."""
    run = lambda chunk, start, stop: F.struct(F.lit(chunk).alias("chunk"), start.alias("start"), stop.alias("stop"))
    chunks = F.transform("_ends", lambda e, k: run(True, F.element_at("_at", F.coalesce(F.get("_ends", k - 1), F.lit(0)) + 1), F.element_at("_at", e)))
    pairs = F.transform("_at", lambda x, i: run(False, x, F.get("_at", i + 1)))
    long = F.filter("_at", lambda x: F.regexp_count(F.element_at("_lines", x), F.lit(WORD)) >= long_words)
    return F.concat(F.filter(chunks, lambda c: c.start < c.stop), F.filter(pairs, lambda p: p.stop.isNotNull()), F.transform(long, lambda x: run(False, x, x)))


def _again(runs: DataFrame, label: str) -> DataFrame:
    """The runs whose body stands before (by id, then place), with the first run of that body."""
    place = F.struct("_id", "_th", "start", "stop")
    first = runs.groupBy("h", "body").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return runs.join(written(first, label), ["h", "body"]).where(place != F.col("first"))


def repeated_runs(df: DataFrame, id_col: str, text_col: str, long_words: int) -> DataFrame:
    """Rows (_id, _th, cuts, chunks, chunk_lines): the ranges (start, stop) of lines that each document loses, apart
    and ascending, and how many chunks and lines of chunks are among them."""
    keyed = df.select(*text_key(id_col, text_col), F.col(text_col).alias("_text"))
    cut = _lined(keyed, "_text").select("_id", "_th", "_lines", _runs(long_words).alias("_runs"))
    body = lambda r: F.array_join(F.slice("_lines", r.start, r.stop - r.start + 1), "\n")
    hashes = cut.select(F.explode(F.transform("_runs", lambda r: F.xxhash64(r.chunk, body(r)))).alias("h"))
    hashes = written(hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "hashes")
    near = F.broadcast(hashes) if hashes.count() <= BROADCAST_ROWS else hashes
    runs = cut.select("_id", "_th", F.inline(F.transform("_runs", lambda r: F.struct(r.chunk.alias("chunk"), r.start.alias("start"), r.stop.alias("stop"), body(r).alias("body")))))
    found = written(runs.withColumn("h", F.xxhash64("chunk", "body")).join(near, "h", "left_semi"), "runs")
    chunks = written(_again(found.where("chunk"), "first").select("_id", "_th", "start", "stop").distinct(), "chunks")
    # a row for each line that a removed chunk holds: an equality join, however many chunks a document has
    held = chunks.select(F.col("_id").alias("_cid"), F.col("_th").alias("_cth"), F.explode(F.sequence("start", "stop")).alias("_line"), F.col("stop").alias("_end"))
    inside = (F.col("_th") == F.col("_cth")) & F.col("_id").eqNullSafe(F.col("_cid")) & (F.col("start") == F.col("_line")) & (F.col("stop") <= F.col("_end"))
    rest = written(found.where("NOT chunk").join(held, inside, "left_anti"), "rest")
    again = _again(rest, "first")
    # equal lines in a row overlap the first run of them, which stays whole
    over = (F.col("_th") == F.col("first._th")) & F.col("_id").eqNullSafe(F.col("first._id")) & (F.col("start") <= F.col("first.stop"))
    again = again.select("_id", "_th", F.when(over, F.col("first.stop") + 1).otherwise(F.col("start")).alias("start"), "stop").distinct()
    gone = again.withColumn("held", F.lit(0)).unionByName(chunks.withColumn("held", F.col("stop") - F.col("start") + 1))
    line = Window.partitionBy("_id", "_th").orderBy("start", "stop")
    new = F.col("start") > F.coalesce(F.max("stop").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    merged = gone.withColumn("_new", new.cast("int")).withColumn("_group", F.sum("_new").over(line))
    merged = merged.groupBy("_id", "_th", "_group").agg(
        F.min("start").alias("start"), F.max("stop").alias("stop"), F.count(F.when(F.col("held") > 0, 1)).alias("chunks"), F.sum("held").alias("held"))
    return written(merged.groupBy("_id", "_th").agg(
        F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("cuts"), F.sum("chunks").alias("chunks"), F.sum("held").alias("chunk_lines")), "cuts")


def drop_repeated_chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", long_words: int = 50) -> DataFrame:
    """df without the chunks, the runs of two lines and more, and the lines of ``long_words`` words and more, that stand before.

    A repeated run goes to its full extent; of equal ones the first (by id, then place) is kept unless its lines
    belong to another run that stands before. Adds n_lines, n_chunks, lines_removed, chunks_removed, and chunk_lines:
    the lines removed with chunks. Lines of white space alone count as no lines: they go inside a run, and stay
    elsewhere. A text all of whose lines go is empty, a null text stays null with 0 lines and chunks; an empty table
    has no rows. A null id is an id, before all others. Rows that repeat in id and text have the same result, as
    copies of one document. Columns of df named like a result are replaced by it; others keep their names and values.
    """
    kept = [c for c in df.columns if c not in RESULTS]
    inner, own = shielded(df)
    id_col, text_col = own[id_col], own[text_col]
    cuts = repeated_runs(inner, id_col, text_col, long_words).withColumnsRenamed({"_id": "_gid", "_th": "_gth"})
    keyed = inner.select("*", *text_key(id_col, text_col))
    # a merge join at every size: its shuffle of the texts grows with them, and hot keys can be split
    whole = keyed.join(cuts.hint("merge"), (F.col("_gth") == F.col("_th")) & F.col("_gid").eqNullSafe(F.col("_id")), "left")
    lined = _lined(whole, text_col)
    at, size, null = F.col("cuts"), F.size("_lines"), F.col(text_col).isNull()
    begin = lambda i: F.when(i > 1, F.element_at(at, i - 1).stop).otherwise(0)
    stop = lambda i: F.when(i <= F.size(at), F.element_at(at, i).start - 1).otherwise(size)
    left = F.transform(F.sequence(F.lit(1), F.size(at) + 1), lambda i: F.slice("_lines", begin(i) + 1, stop(i) - begin(i)))
    text = F.when(at.isNull(), F.col(text_col)).otherwise(F.array_join(F.flatten(left), "\n"))
    removed = F.when(at.isNull(), F.lit(0)).otherwise(F.aggregate(at, F.lit(0), lambda n, c: n + c.stop - c.start + 1))
    counts = [F.when(null, F.lit(0)).otherwise(size), F.size("_ends"), removed, F.coalesce("chunks", F.lit(0)), F.coalesce("chunk_lines", F.lit(0))]
    return lined.select(*((text if own[c] == text_col else F.col(own[c])).alias(c) for c in kept),
                        *(n.cast("long").alias(name) for name, n in zip(RESULTS, counts, strict=True)))


#: DuckDB SQL of the query over documents: what two neighbouring lines say covers the chunks as well.
SQL = rf"""
WITH docs AS (SELECT doc_id, text IS NULL AS empty, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT doc_id, empty, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM docs),
filled AS (
  SELECT doc_id, line, i, row_number() OVER w AS k, lead(i) OVER w AS following, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h
  FROM lines WHERE regexp_matches(line, '{FILLED}') WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
rolled AS (SELECT *, h + 31 * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) AS r FROM filled),
ended AS (
  SELECT *, following IS NULL OR (k > 1 AND r < lag(r) OVER w AND r <= lead(r) OVER w) AS ends FROM rolled
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM ended),
chunks AS (SELECT doc_id, min(i) AS a, max(i) AS b FROM numbered GROUP BY doc_id, c),
runs AS (
  SELECT true AS chunk, doc_id, a, b FROM chunks WHERE a < b
  UNION ALL SELECT false, doc_id, i, following FROM filled WHERE following IS NOT NULL
  UNION ALL SELECT false, doc_id, i, i FROM filled WHERE len(regexp_extract_all(line, '{WORD}')) >= 50),
ranked AS (
  SELECT chunk, doc_id, a, b, row_number() OVER w AS n, first_value(doc_id) OVER w AS fd, first_value(b) OVER w AS fb
  FROM (SELECT r.*, array_to_string(l[a:b], chr(10)) AS body FROM runs r JOIN docs USING (doc_id))
  WINDOW w AS (PARTITION BY chunk, body ORDER BY doc_id, a, b)),
gone AS (SELECT chunk, doc_id, CASE WHEN fd = doc_id AND a <= fb THEN fb + 1 ELSE a END AS a, b FROM ranked WHERE n > 1),
lost AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM gone),
whole AS (
  SELECT lines.doc_id, CASE WHEN empty THEN 0 ELSE count(*) END AS n_lines, count(lost.i) AS lines_removed,
    coalesce(string_agg(line, chr(10) ORDER BY lines.i) FILTER (lost.i IS NULL), '') AS left_text
  FROM lines LEFT JOIN lost ON lost.doc_id = lines.doc_id AND lost.i = lines.i GROUP BY lines.doc_id, empty),
cut AS (SELECT doc_id, count(*) AS n_chunks FROM chunks GROUP BY doc_id),
through AS (SELECT doc_id, count(*) AS chunks_removed, sum(b - a + 1) AS chunk_lines FROM gone WHERE chunk GROUP BY doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, coalesce(n_chunks, 0)::BIGINT AS n_chunks, lines_removed::BIGINT AS lines_removed,
  coalesce(chunks_removed, 0)::BIGINT AS chunks_removed, coalesce(chunk_lines, 0)::BIGINT AS chunk_lines, md5(left_text) AS text_md5
FROM whole LEFT JOIN cut USING (doc_id) LEFT JOIN through USING (doc_id)
"""
