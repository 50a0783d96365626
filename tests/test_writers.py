"""Several writers of one name of a store."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest

from prepkit.sources.files import Files
from prepkit.sources.store import FeatureStore


def test_one_writer_creates_a_file(spark, tmp_path):
    files = Files(spark, str(tmp_path))
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: files.create_text(f"{tmp_path}/log/1.json", f"writer {i}"), range(24)))
    assert sum(won) == 1 and files.read_text(f"{tmp_path}/log/1.json") == f"writer {won.index(True)}"
    assert files.names(f"{tmp_path}/log") == ["1.json"]


def test_writers_of_one_name_lose_nothing(spark, tmp_path):
    df = spark.range(5).selectExpr("id", "id * 2 AS x")

    def work(i):
        store = FeatureStore(spark, str(tmp_path))  # a writer of its own
        store.register("set", owner=f"owner {i}", **({"description": "told"} if i == 1 else {}), **({"tags": ["t"]} if i == 2 else {}))
        return store.write(df.withColumn("x", df.x + i), "set", keep_last=None)

    with ThreadPoolExecutor(4) as pool:
        paths = list(pool.map(work, range(6)))
    store = FeatureStore(spark, str(tmp_path))
    assert len(set(paths)) == 6 and {r["path"] for r in store.list_versions("set").collect()} == set(paths)
    assert sorted(store._numbers("set", "commits")) == [1, 2, 3, 4, 5, 6] == sorted(store._numbers("set", "registered"))
    last = store._entry("set", "commits", 6)["version"]
    assert store.latest_version("set") == last and store.latest_meta("set").path in paths
    entry = store.get_registered("set")
    assert (entry["description"], entry["tags"]) == ("told", ["t"]) and entry["owner"].startswith("owner")
    for path in paths:
        assert store.read_version("set", path).count() == 5


def test_retention_of_a_racing_writer_leaves_a_latest(spark, tmp_path):
    df = spark.range(3)
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda i: FeatureStore(spark, str(tmp_path)).write(df, "set", keep_last=1), range(5)))
    store = FeatureStore(spark, str(tmp_path))
    assert store.read_latest("set").count() == 3


def test_stores_without_a_log_are_read(spark, tmp_path):
    store = FeatureStore(spark, str(tmp_path))
    path = store.write(spark.range(2), "set")
    home = path.rsplit("/", 1)[0]
    version = store.latest_version("set")
    store.files.remove(f"{home}/_log")
    with pytest.raises(FileNotFoundError):
        store.latest_version("set")
    store.files.write_text(f"{home}/_latest", version)
    store.files.write_text(f"{home}/_registered.json", json.dumps({"name": "set", "owner": "old"}))
    assert store.latest_version("set") == version and store.get_registered("set")["owner"] == "old"
    assert store.register("set", description="new")["owner"] == "old" and store.get_registered("set")["description"] == "new"
