"""Secrets in whole texts, told apart by who owns them in the corpus. DataFrame functions only.

Base kinds are patterns. The method adds ``owned`` spans: long mixed runs that look like live keys. Every
candidate is hashed, and counted over the corpus by distinct documents (repositories) and distinct
sources (owners): what COPIED_OWNERS owners or COPIED_REPOS repositories carry is a widely copied example, what
few of both carry is a live-looking credential of theirs. A document without a source is its own owner. Places come from the lengths of what stands between the matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prepkit.llm.common import shielded, text_key, written

# The kinds in the order in which they are listed, with their patterns and least lengths.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"  # a run either matches from its first AKIA on, or has no match at all
HEX = r"[0-9a-f]{32,}"
LEAST_ASSIGN = 8
#: A run of 20 characters and more that could be a key; it has to hold a digit, a letter and 10 different ones.
OWNED = r"[A-Za-z0-9+/_=-]{20,}"
LEAST_DIFFERENT = 10
#: Distinct owners from which on a value counts as a widely copied example.
COPIED_OWNERS = 3
#: Distinct repositories from which on it does, of however few owners.
COPIED_REPOS = 10


def _hits(kind: str, pattern: str, group: int) -> Column:
    """Matches of the kind as an array of (kind, i, gap, found, value); gap: characters since the match before."""
    text = F.col("_text")
    gaps, found, value = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.transform(F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("f"), value.alias("v")), lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(x.g).alias("gap"), F.length(x.f).alias("size"), x.v.alias("value")))
    none = F.array().cast("array<struct<kind:string,i:int,gap:int,size:int,value:string>>")
    return F.when(text.rlike(pattern), zipped).otherwise(none)


def candidate_spans(df: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    """Rows (_id, _th, owner, kind, start, end, value): base spans, and runs that look like keys apart from those."""
    keyed = df.select(*text_key(id_col, text_col), F.col(owner_col).cast("string").alias("owner"), F.col(text_col).alias("_text")).where("_text IS NOT NULL")
    kinds = [_hits("assign", ASSIGN, 2), _hits("access", ACCESS, 0), _hits("hex", HEX, 0), _hits("owned", OWNED, 0)]
    scanned = keyed.select("_id", "_th", "owner", F.concat(*kinds).alias("hits")).where(F.size("hits") > 0)
    once = scanned.groupBy("_id", "_th").agg(F.min("owner").alias("owner"), F.first("hits").alias("hits"))
    hits = written(once, "hits").select("_id", "_th", "owner", F.inline("hits"))
    before = Window.partitionBy("_id", "_th", "kind").orderBy("i")
    placed = hits.withColumn("end", F.sum((F.col("gap") + F.col("size")).cast("long")).over(before)).withColumn("start", F.col("end") - F.col("size"))
    key_like = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split("value", ""))) >= LEAST_DIFFERENT)
    good = placed.where(F.expr(f"CASE kind WHEN 'assign' THEN length(value) >= {LEAST_ASSIGN} ELSE true END") & ((F.col("kind") != "owned") | key_like))
    base = F.col("kind") != "owned"
    line = Window.partitionBy("_id", "_th").orderBy("start", F.when(base, 0).otherwise(1))
    apart = good.withColumns({
        "_left": F.max(F.when(base, F.col("end"))).over(line.rowsBetween(Window.unboundedPreceding, -1)),
        "_right": F.min(F.when(base, F.col("start"))).over(line.rowsBetween(1, Window.unboundedFollowing))})
    free = (F.coalesce("_left", F.lit(0)) <= F.col("start")) & (F.col("_right").isNull() | (F.col("_right") >= F.col("end")))
    return apart.where(base | free).select("_id", "_th", "owner", "kind", "start", "end", "value")


def owned_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """Rows (_id, _th, kind, start, end, n_repos, n_owners, live) of all base spans and of the live runs.

    live: fewer than COPIED_OWNERS owners and fewer than COPIED_REPOS repositories carry the value. Repositories are
    distinct ids (rows without an id are one), owners distinct sources and the repositories without a source, over
    the whole corpus; they are counted in two steps, so that a value of any frequency is spread over tasks.
    """
    spans = written(candidate_spans(df, id_col, text_col, owner_col).withColumn("vh", F.sha2("value", 256)).drop("value"), "spans")
    alone = F.when(F.col("owner").isNull(), F.col("_id")).alias("alone")
    owners = spans.select("vh", "owner", alone).distinct().groupBy("vh").agg(F.count(F.lit(1)).alias("n_owners"))
    repos = spans.select("vh", "_id").distinct().groupBy("vh").agg(F.count(F.lit(1)).alias("n_repos"))
    counted = written(owners.join(repos, "vh"), "owners")
    few = (F.col("n_owners") < COPIED_OWNERS) & (F.col("n_repos") < COPIED_REPOS)
    judged = spans.join(counted, "vh").withColumn("live", few)
    return judged.where((F.col("kind") != "owned") | F.col("live")).select("_id", "_th", "kind", "start", "end", "n_repos", "n_owners", "live")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s.place), s.start, s.end)), ",")


def _ordered(place: str) -> Column:
    return F.array_sort(F.collect_list(F.struct("start", F.col(place).alias("place"), "end")))


def secret_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """A row per row of df: id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_copied, n_live, most_repos, most_owners.

    Spans are kind:start:end in code points, end exclusive, by start and then by the order of kinds.
    most_repos and most_owners: the counts of the span whose value is carried most widely (0 without spans). A null or
    empty text has none, and the hash of the empty text; an empty table has no rows. Rows that repeat
    in id and text have the same result and count once in the corpus, with the least of their owners; a document
    without a source is an owner by itself.
    """
    spans = owned_spans(df, id_col, text_col, owner_col).withColumn("_place", F.expr("CASE kind " + " ".join(f"WHEN '{k}' THEN {i + 1}" for i, k in enumerate(KINDS)) + " END"))
    n = lambda cond, name: F.count(F.when(cond, 1)).alias(name)
    kind, base = F.col("kind"), F.col("kind") != "owned"
    found = spans.groupBy("_id", "_th").agg(
        *(n(kind == k, f"n_{k}") for k in KINDS), n(base & ~F.col("live"), "n_copied"), n(F.col("live"), "n_live"),
        F.max("n_repos").alias("most_repos"), F.max("n_owners").alias("most_owners"), _ordered("_place").alias("all"))
    found = written(found, "found").withColumnsRenamed({"_id": "_fid", "_th": "_fth"})
    rows = df.select(*text_key(id_col, text_col))
    joined = rows.join(found, (F.col("_fth") == F.col("_th")) & F.col("_fid").eqNullSafe(F.col("_id")), "left")
    every = F.coalesce("all", F.array().cast("array<struct<start:bigint,place:int,end:bigint>>"))
    count = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    return joined.select(F.col("_id").alias(id_col), count("n_assign"), count("n_access"), count("n_hex"),
                         F.sha2(_joined(F.filter(every, lambda s: s.place < len(KINDS))).cast("binary"), 256).alias("base_sha256"),
                         _joined(every).alias("spans"), count("n_owned"), count("n_copied"), count("n_live"),
                         count("most_repos"), count("most_owners"))


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", mark: str = "[REDACTED]") -> DataFrame:
    """df with every live span (base or owned) replaced by ``mark``; widely copied examples stay.

    Spans that overlap become one mark. Null and empty texts stay as they are.
    """
    inner, names = shielded(df)
    id_col, text_col, owner_col = names[id_col], names[text_col], names[owner_col]
    live = owned_spans(inner, id_col, text_col, owner_col).where("live")
    line = Window.partitionBy("_id", "_th").orderBy("start", "end")
    new = F.col("start") >= F.coalesce(F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = live.withColumn("_new", new.cast("int")).withColumn("_group", F.sum("_new").over(line))
    merged = grouped.groupBy("_id", "_th", "_group").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    cuts = written(merged.groupBy("_id", "_th").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("_cuts")), "cuts").withColumnsRenamed({"_id": "_fid", "_th": "_fth"})
    own = inner.select("*", *text_key(id_col, text_col))
    joined = own.join(cuts.hint("merge"), (F.col("_fth") == F.col("_th")) & F.col("_fid").eqNullSafe(F.col("_id")), "left")
    text, at = F.col(text_col), F.col("_cuts")
    begin = lambda i: F.when(i > 1, F.element_at(at, i - 1).end).otherwise(0)
    stop = lambda i: F.when(i <= F.size(at), F.element_at(at, i).start).otherwise(F.length(text).cast("long"))
    parts = F.transform(F.sequence(F.lit(1), F.size(at) + 1), lambda i: F.substring(text, (begin(i) + 1).cast("int"), (stop(i) - begin(i)).cast("int")))
    return joined.withColumn(text_col, F.when(at.isNull(), text).otherwise(F.array_join(parts, mark))).select(*names.values()).toDF(*df.columns)


def _sql_hits(kind: str, place: int, pattern: str, group: int) -> str:
    p = pattern.replace("'", "''")
    return (f"SELECT doc_id, source, '{kind}' AS kind, {place} AS place, string_split_regex(text, '{p}') AS g, "
            f"regexp_extract_all(text, '{p}', 0) AS f, regexp_extract_all(text, '{p}', {group}) AS v FROM documents WHERE regexp_matches(text, '{p}')")


_SQL_HITS = " UNION ALL ".join(_sql_hits(*x) for x in (("assign", 1, ASSIGN, 2), ("access", 2, ACCESS, 0), ("hex", 3, HEX, 0), ("owned", 4, OWNED, 0)))

#: DuckDB SQL of the query over documents.
SQL = f"""
WITH hits AS ({_SQL_HITS}),
one AS (SELECT *, unnest(range(1, len(f) + 1)) AS i FROM hits),
placed AS (
  SELECT doc_id, source, kind, place, v[i] AS value, (list_sum(list_transform(g[1:i], lambda x: len(x)))
    + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: len(x))), 0))::BIGINT AS start, len(f[i]) AS size FROM one),
good AS (
  SELECT *, start + size AS stop FROM placed WHERE CASE kind WHEN 'assign' THEN len(value) >= {LEAST_ASSIGN}
    WHEN 'owned' THEN regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]') AND len(list_distinct(string_split(value, ''))) >= {LEAST_DIFFERENT} ELSE true END),
free AS (
  SELECT * FROM good o WHERE place < 4 OR NOT EXISTS (
    SELECT 1 FROM good b WHERE b.doc_id = o.doc_id AND b.place < 4 AND b.start < o.stop AND b.stop > o.start)),
owners AS (
  SELECT value, count(DISTINCT row(source, CASE WHEN source IS NULL THEN doc_id END)) AS n_owners, count(DISTINCT doc_id) AS n_repos FROM free GROUP BY value),
judged AS (SELECT f.*, n_owners, n_repos, n_owners < {COPIED_OWNERS} AND n_repos < {COPIED_REPOS} AS live FROM free f JOIN owners USING (value) WHERE place < 4 OR live),
found AS (
  SELECT doc_id, count(*) FILTER (place = 1) AS n_assign, count(*) FILTER (place = 2) AS n_access, count(*) FILTER (place = 3) AS n_hex,
    count(*) FILTER (place = 4) AS n_owned, count(*) FILTER (place < 4 AND NOT live) AS n_copied, count(*) FILTER (live) AS n_live,
    max(n_repos) AS most_repos, max(n_owners) AS most_owners,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (place < 4) AS base,
    string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_owned, 0) AS n_owned, coalesce(n_copied, 0) AS n_copied, coalesce(n_live, 0) AS n_live,
  coalesce(most_repos, 0) AS most_repos, coalesce(most_owners, 0) AS most_owners
FROM documents d LEFT JOIN found USING (doc_id)
"""
