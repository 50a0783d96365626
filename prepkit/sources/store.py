"""Versioned feature sets and models: immutable version folders, a pointer to the latest, metadata lines.

Layout: root/<name>/version=<ms>-<n>/ with data, root/<name>/_meta/<version>.json, root/<name>/_log/<commits or registered>/<number>.json.
A version shows up only when its metadata file does, so a lost writer leaves nothing half visible.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from datetime import datetime, timezone
from typing import Any

import pyspark
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prepkit.functions.columns import local_rows
from prepkit.functions.hashing import row_digest
from prepkit.operators.ordering import row_numbers
from prepkit.operators.profile import head, sample_rows
from prepkit.sources.files import Files

VERSION_SCHEMA = "name string, version string, created_ts bigint, path string"


def content_checksum(df: DataFrame) -> DataFrame:
    """Order-free fingerprint: row count and the sum of 60-bit row hashes, as one row."""
    h = F.conv(F.substring(row_digest(df.columns), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(h).cast("string").alias("hash_sum"))


def schema_diff(spark: SparkSession, expected: dict[str, str], actual: dict[str, str]) -> DataFrame:
    """(column, expected, actual) of missing or differently typed columns; extra ones are fine."""
    rows = [(c, t, actual.get(c)) for c, t in expected.items() if actual.get(c) != t]
    return local_rows(spark, rows, "column string, expected string, actual string")


def validate_schema(expected: dict[str, str], df: DataFrame) -> None:
    actual = dict(df.dtypes)
    missing = [c for c in expected if c not in actual]
    if missing:
        raise ValueError(f"schema mismatch: missing columns {missing}")
    wrong = [(c, actual[c], t) for c, t in expected.items() if actual[c] != t]
    if wrong:
        raise ValueError(f"schema type mismatch (column, found, expected): {wrong}")


def list_versions(versions: DataFrame, keys: Sequence[str] = ("name",), ts: str = "created_ts") -> DataFrame:
    """Versions newest first, numbered per name (range by range when the log is large)."""
    newest_first = versions.withColumn("_age", -F.col(ts))
    return row_numbers(newest_first, keys, "_age", name="age_rank").drop("_age").orderBy(*keys, "age_rank")


def retention(versions: DataFrame, keep_last: int | None = 10, max_age_days: float | None = None,
              now_ts: Column | int | None = None, keys: Sequence[str] = ("name",), ts: str = "created_ts",
              unit: int = 1) -> DataFrame:
    """Versions to drop: beyond the newest keep_last, or older than the cutoff (either is enough).

    The newest ``keep_last`` per name are found with a rank limit that is applied before the shuffle;
    ``unit`` is the number of ts units in a second.
    """
    if keep_last is None and max_age_days is None:
        return versions.limit(0)
    out = versions
    old = F.lit(False)
    if max_age_days is not None and max_age_days > 0:
        now = now_ts if isinstance(now_ts, Column) else F.lit(int(time.time() * unit) if now_ts is None else now_ts)
        old = F.col(ts) < now - int(max_age_days * 86400 * unit)
    surplus = F.lit(False)
    if keep_last is not None and keep_last >= 0:
        w = Window.partitionBy(*keys).orderBy(F.desc(ts))
        kept = (versions.select(*keys, ts).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= keep_last)
                .groupBy(*keys).agg(F.min(ts).alias("_oldest_kept"), F.count("*").alias("_kept")))
        out = versions.join(kept, list(keys), "left")
        surplus = F.col("_oldest_kept").isNull() | (F.col(ts) < F.col("_oldest_kept"))
    return out.filter(surplus | old).select(*versions.columns)


@dataclass(frozen=True)
class VersionMeta:
    name: str
    version: str
    path: str
    created_ts: int
    created_iso: str
    tags: tuple[str, ...]
    facts: dict[str, Any]

    def frame(self, spark: SparkSession) -> DataFrame:
        return local_rows(spark, [(self.name, self.version, self.path, self.created_ts, self.created_iso,
                                   list(self.tags), json.dumps(self.facts, sort_keys=True))],
                          "name string, version string, path string, created_ts bigint, created_iso string, "
                          "tags array<string>, facts string")


class _Versions:
    """Version folders of one root, for any number of writers.

    What is committed or registered under a name is a numbered log: a writer creates the entry after the last one it has
    read, and where another writer was first, reads on and tries the next number. The latest version and the
    registered facts are read from the log. A version's number is claimed before its data is written.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)

    def uri(self) -> str:
        return self.root

    def exists(self, path: str) -> bool:
        return self.files.exists(path)

    def _home(self, name: str) -> str:
        return f"{self.root}/{re.sub(r'[^A-Za-z0-9_.-]+', '_', name)}"

    def _new_version(self, name: str) -> tuple[str, int]:
        taken, ms, n = set(self._ids(name)), int(time.time() * 1000), 0
        while f"{ms:013d}-{n}" in taken or not self.files.create_text(f"{self._home(name)}/_claims/{ms:013d}-{n}", ""):
            n += 1
        return f"{ms:013d}-{n}", ms

    def _numbers(self, name: str, log: str) -> list[int]:
        return [int(x.removesuffix(".json")) for x in self.files.names(f"{self._home(name)}/_log/{log}") if x.endswith(".json")]

    def _entry(self, name: str, log: str, number: int) -> dict[str, Any]:
        return json.loads(self.files.read_text(f"{self._home(name)}/_log/{log}/{number:012d}.json"))

    def _append(self, name: str, log: str, entry: dict[str, Any]) -> int:
        """The number under which the entry stands; every entry of every writer gets one of its own."""
        number = max(self._numbers(name, log), default=0) + 1
        while not self.files.create_text(f"{self._home(name)}/_log/{log}/{number:012d}.json", json.dumps(entry)):
            number += 1
        return number

    def _ids(self, name: str) -> list[str]:
        return [x.removesuffix(".json") for x in self.files.names(f"{self._home(name)}/_meta") if x.endswith(".json")]

    def _commit(self, meta: VersionMeta) -> None:
        home = self._home(meta.name)
        self.files.write_text(f"{home}/_meta/{meta.version}.json", json.dumps(asdict(meta)))
        self._append(meta.name, "commits", {"version": meta.version})

    def _meta(self, name: str, version: str) -> VersionMeta:
        path = f"{self._home(name)}/_meta/{version}.json"
        if not self.files.exists(path):
            raise FileNotFoundError(f"no version {version} of {name}")
        raw = json.loads(self.files.read_text(path))
        return VersionMeta(**{**raw, "tags": tuple(raw["tags"])})

    def latest_version(self, name: str) -> str:
        """The version that was committed last, of those that retention has left."""
        home = self._home(name)
        for number in reversed(self._numbers(name, "commits")):
            version = self._entry(name, "commits", number)["version"]
            if self.files.exists(f"{home}/_meta/{version}.json"):
                return version
        if self.files.exists(f"{home}/_latest"):  # written before there was a log
            return self.files.read_text(f"{home}/_latest").strip()
        raise FileNotFoundError(f"nothing stored under {name}")

    def latest_meta(self, name: str) -> VersionMeta:
        return self._meta(name, self.latest_version(name))

    def list_versions(self, name: str) -> DataFrame:
        rows = [(name, v, int(v.split("-")[0]), f"{self._home(name)}/version={v}") for v in reversed(self._ids(name))]
        return local_rows(self.spark, rows, VERSION_SCHEMA)

    def apply_retention(self, name: str, keep_last: int | None = 10, max_age_days: float | None = None) -> list[str]:
        ids, cutoff = list(reversed(self._ids(name))), None
        if max_age_days is not None and max_age_days > 0:
            cutoff = int((time.time() - max_age_days * 86400) * 1000)
        doomed = [v for i, v in enumerate(ids) if (keep_last is not None and i >= keep_last)
                  or (cutoff is not None and int(v.split("-")[0]) < cutoff)]
        for v in doomed:  # metadata first: a version without it is not visible
            self.files.remove(f"{self._home(name)}/_meta/{v}.json")
            self.files.remove(f"{self._home(name)}/version={v}")
        return doomed


def _iso(ms: int) -> str:
    return datetime.fromtimestamp(ms / 1000, tz=timezone.utc).isoformat()


class FeatureStore(_Versions):
    def __init__(self, spark: SparkSession, root: str = "feature_store") -> None:
        super().__init__(spark, root)

    def register(self, name: str, example: DataFrame | None = None, description: str | None = None,
                 owner: str | None = None, tags: Sequence[str] | None = None) -> dict[str, Any]:
        """Create or update the entry; fields given as None keep their old value."""
        new = {"name": name, "description": description, "owner": owner,
               "tags": list(tags) if tags is not None else None,
               "schema": dict(example.dtypes) if example is not None and not example.isEmpty() else None}
        number = self._append(name, "registered", {k: v for k, v in new.items() if v is not None})
        return self._registered(name, number)

    def _registered(self, name: str, up_to: int | None = None) -> dict[str, Any] | None:
        """The fields of all registrations, later ones over earlier ones."""
        path = f"{self._home(name)}/_registered.json"  # written before there was a log
        entry = json.loads(self.files.read_text(path)) if self.files.exists(path) else {}
        for number in self._numbers(name, "registered"):
            if up_to is None or number <= up_to:
                entry |= self._entry(name, "registered", number)
        return entry or None

    def get_registered(self, name: str) -> dict[str, Any] | None:
        return self._registered(name)

    def write(self, df: DataFrame, name: str, tags: Sequence[str] | None = None, keep_last: int | None = 10,
              max_age_days: float | None = None, validate: bool = True) -> str:
        """Write a new immutable version, point latest at it, apply retention; returns its path.

        Row count and checksum are taken from the written files, so the input is computed once.
        """
        entry = self.get_registered(name)
        if validate and entry and "schema" in entry:
            validate_schema(entry["schema"], df)
        version, ms = self._new_version(name)
        path = f"{self._home(name)}/version={version}"
        df.write.mode("errorifexists").parquet(path)
        facts = content_checksum(self.spark.read.parquet(path)).first()
        if not facts["rows"]:
            self.files.remove(path)
            raise ValueError("empty table")
        self._commit(VersionMeta(name, version, path, ms, _iso(ms), tuple(tags or ()), {
            "rows": facts["rows"], "cols": len(df.columns), "dtypes": dict(df.dtypes), "checksum": facts["hash_sum"]}))
        self.apply_retention(name, keep_last, max_age_days)
        return path

    def read_latest(self, name: str, columns: Sequence[str] | None = None) -> DataFrame:
        return self.read_version(name, self.latest_version(name), columns)

    def read_version(self, name: str, version_or_path: str, columns: Sequence[str] | None = None) -> DataFrame:
        path = version_or_path if "/" in version_or_path else f"{self._home(name)}/version={version_or_path}"
        if not self.files.exists(path):
            raise FileNotFoundError(f"version not found: {path}")
        df = self.spark.read.parquet(path)
        return df.select(*columns) if columns else df

    def head(self, name: str, n: int = 5, order: Sequence[str] | None = None) -> DataFrame:
        """The first rows along ``order``, or any n rows without one."""
        df = self.read_latest(name)
        return head(df, n, order) if order else df.limit(n)

    def sample(self, name: str, n: int = 5, seed: int = 42) -> DataFrame:
        return sample_rows(self.read_latest(name), n, seed)


class ModelCatalogue(_Versions):
    def __init__(self, spark: SparkSession, root: str = "models") -> None:
        super().__init__(spark, root)

    def _hash(self, path: str) -> str:
        """sha2 over the (file, content hash) list; contents are hashed by tasks, not by the driver."""
        files = (self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
                 .select(F.regexp_extract("path", r"version=[^/]+/(.*)$", 1).alias("f"), F.sha2("content", 256).alias("h")))
        listed = F.array_sort(F.collect_list(F.concat_ws(":", "f", "h")))
        return files.filter("f NOT LIKE '%.crc'").agg(F.sha2(F.concat_ws("\n", listed), 256)).first()[0]

    def save_model(self, model: PipelineModel, name: str, tags: Sequence[str] | None = None, keep_last: int = 10,
                   extra: dict[str, Any] | None = None) -> str:
        version, ms = self._new_version(name)
        path = f"{self._home(name)}/version={version}"
        model.write().save(path)
        self._commit(VersionMeta(name, version, path, ms, _iso(ms), tuple(tags or ()), {
            "size_bytes": self.files.size(path), "hash": self._hash(path), "framework": "pyspark.ml",
            "model_class": type(model).__name__, "libs": {"pyspark": pyspark.__version__}, **(extra or {})}))
        self.apply_retention(name, keep_last)
        return path

    def _resolve(self, path_or_name: str, version: str | None) -> str:
        if version is None and "/" in path_or_name and self.files.exists(path_or_name):
            return path_or_name
        return f"{self._home(path_or_name)}/version={version or self.latest_version(path_or_name)}"

    def load_model(self, path_or_name: str, version: str | None = None) -> PipelineModel:
        path = self._resolve(path_or_name, version)
        if not self.files.exists(path):
            raise FileNotFoundError(f"model not found: {path}")
        return PipelineModel.load(path)

    def latest_model_path(self, name: str) -> str:
        return self._resolve(name, None)

    def verify_model(self, name: str, version: str | None = None) -> bool:
        try:
            meta = self._meta(name, version or self.latest_version(name))
        except FileNotFoundError:
            return False
        return self.files.exists(meta.path) and self._hash(meta.path) == meta.facts["hash"]
