import gzip
import json
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prepkit.operators.drift import plan_psi
from prepkit.plans import automl as am
from prepkit.plans.train_job import train_job
from prepkit.sources import readers as rd
from prepkit.sources import sinks as sk
from prepkit.sources import store as st
from prepkit.streaming.alerts import suppress_repeats, suppress_stream
from prepkit.streaming.drift import drift_stream, drift_windows
from prepkit.streaming.scoring import chunk_writer, predict_stream
from tests.conftest import rows


def test_formats(spark, tmp_path, table):
    o = table("nation")
    for fmt in ("csv", "json", "parquet", "orc"):
        path = sk.write_table(o, f"{tmp_path}/n.{fmt}", fmt)
        assert rd.detect_format(spark, path) == fmt
        back = rd.read_any(spark, path, "jsonl" if fmt == "json" else None)
        assert rows(back.select(*o.columns), "n_nationkey") == [tuple(r) for r in o.orderBy("n_nationkey").collect()]
    o.write.parquet(f"{tmp_path}/plain")
    o.write.orc(f"{tmp_path}/plain2")
    assert rd.detect_format(spark, f"{tmp_path}/plain") == "parquet" and rd.detect_format(spark, f"{tmp_path}/plain2") == "orc"


def test_csv_sniffing_duplicates_and_gzip(spark, tmp_path):
    text = "a;b;a\n1;x;2024-01-05\n200;na;2024-02-05\n3;;2024-03-05\n"
    (tmp_path / "t.csv").write_text(text)
    with gzip.open(tmp_path / "t.csv.gz", "wt") as f:
        f.write(text)
    for name in ("t.csv", "t.csv.gz"):
        df, meta = rd.smart_read(spark, f"{tmp_path}/{name}")
        assert df.columns == ["a", "b", "a__1"] and meta.detected_format == "csv"
        assert dict(df.dtypes)["a"] == "smallint" and [r["b"] for r in df.orderBy("a").collect()] == ["x", None, None]
        assert rd.load_meta(df, meta).frame(spark).first()["rows"] == 3
    assert rd.load_table(spark, None) is None and rd.load_table(spark, f"{tmp_path}/t.csv", 2).count() == 2


def test_nested_json(spark, tmp_path):
    (tmp_path / "n.json").write_text(json.dumps([{"a": {"b": 1, "c": {"d": "x"}}, "e": 2}, {"a": {"b": 3}, "e": 4}]))
    df = rd.read_any(spark, f"{tmp_path}/n.json")
    assert set(df.columns) == {"a.b", "a.c.d", "e"} and rows(df.select("`a.b`", "e"), "e") == [(1, 2), (3, 4)]


def test_downcast(spark):
    df = spark.createDataFrame([(1, 0.5, 1e300, 70000), (127, 2.0, 1.0, -1)], "a bigint, b double, c double, d bigint")
    assert dict(rd.downcast_numbers(df).dtypes) == {"a": "tinyint", "b": "float", "c": "double", "d": "int"}


def test_dates_month_first_then_day_first(spark):
    df = spark.createDataFrame([("01/02/2024", "13/02/2024", "hello")] * 5, "m string, d string, t string")
    out, found = rd.auto_parse_dates(df)
    r = out.first()
    assert found == ["m", "d"] and (r["m"].month, r["d"].day) == (1, 13)


def test_feature_store(spark, tmp_path, table):
    fs = st.FeatureStore(spark, f"{tmp_path}/fs")
    df = table("nation")
    fs.register("n", df, description="d", tags=["t"])
    fs.register("n", owner="me")
    assert fs.get_registered("n")["description"] == "d" and fs.get_registered("n")["owner"] == "me"
    paths = [fs.write(df.limit(5 + i), "n", keep_last=2) for i in range(3)]
    assert fs.list_versions("n").count() == 2 and not fs.exists(paths[0])
    assert fs.read_latest("n", ["n_name"]).columns == ["n_name"] and fs.read_latest("n").count() == 7
    assert fs.read_version("n", paths[1]).count() == 6 and fs.head("n", 3).count() == 3 and fs.sample("n", 2).count() == 2
    meta = fs.latest_meta("n")
    assert meta.facts["rows"] == 7 and meta.frame(spark).count() == 1
    with pytest.raises(ValueError, match="missing"):
        fs.write(df.drop("n_name"), "n")
    with pytest.raises(ValueError, match="type"):
        fs.write(df.withColumn("n_name", F.lit(1)), "n")
    with pytest.raises(ValueError, match="empty"):
        fs.write(df.limit(0), "n")
    with pytest.raises(FileNotFoundError):
        fs.read_latest("other")


def test_checksum_ignores_order(spark, table):
    o = table("customer")
    assert rows(st.content_checksum(o)) == rows(st.content_checksum(o.repartition(7)))
    assert rows(st.content_checksum(o)) != rows(st.content_checksum(o.filter("c_custkey > 0")))


def test_retention_is_a_union(spark):
    v = spark.createDataFrame([("a", t) for t in range(10)], "name string, created_ts bigint")
    assert rows(st.retention(v, 3, None), "created_ts") == [("a", t) for t in range(7)]
    assert rows(st.retention(v, 9, 1, now_ts=86400 + 4), "created_ts") == [("a", t) for t in range(4)]
    assert st.retention(v, None, None).count() == 0 and st.retention(v, 0, None).count() == 10


def test_model_catalogue_and_stream_scoring(spark, tmp_path):
    df = spark.createDataFrame(pd.DataFrame({"id": range(40), "x": np.arange(40.0), "y": 2 * np.arange(40.0) + 1}))
    model = am.Pipeline(stages=[*am.build_preprocessor(df, ["x"]).getStages(), am.LinearRegression(labelCol="y")]).fit(df)
    cat = st.ModelCatalogue(spark, f"{tmp_path}/models")
    path = cat.save_model(model, "line", tags=["t"])
    assert cat.verify_model("line") and not cat.verify_model("none") and cat.latest_model_path("line") == path
    back = cat.load_model("line")
    df.write.parquet(f"{tmp_path}/live")
    live = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/live")
    q = chunk_writer(predict_stream(back, live, ["id"]), f"{tmp_path}/lines", f"{tmp_path}/ck", "id").trigger(availableNow=True).start()
    q.awaitTermination()
    line = json.loads(spark.read.text(f"{tmp_path}/lines").first()[0])
    assert line["n"] == 40 and np.allclose(line["sample_pred"], [1, 3, 5, 7, 9], atol=1e-3)
    broken = next(p for p in (tmp_path / "models").rglob("*.parquet"))
    broken.write_bytes(broken.read_bytes() + b"x")
    (broken.parent / f".{broken.name}.crc").unlink(missing_ok=True)
    assert not cat.verify_model("line")


def chain(times, window):
    kept = []
    for t in sorted(times):
        if not kept or t - kept[-1] >= window:
            kept.append(t)
    return kept


@pytest.mark.parametrize("parts", [1, 4, 23])
def test_suppression_of_a_hot_signature(spark, parts):
    rng = np.random.RandomState(parts)
    hot = np.sort(rng.randint(0, 200_000, 3000))
    cold = np.array([5, 300, 304, 305, 700])
    data = [("hot", int(t)) for t in hot] + [("cold", int(t)) for t in cold]
    df = spark.createDataFrame(data, "s string, t bigint").withColumn("ts", F.timestamp_seconds("t"))
    got = suppress_repeats(df, ["s"], "ts", 300, parts, hot_rows=100).select("s", F.unix_seconds("ts").alias("t"))
    want = sorted([("hot", t) for t in chain(hot, 300)] + [("cold", t) for t in chain(cold, 300)])
    assert sorted(rows(got)) == want


def test_streams_equal_batch(spark, tmp_path, table):
    e = table("events")
    for lo, hi in ((0, 300), (300, 600), (600, 10**9)):  # files arrive in time order
        e.filter(f"event_id >= {lo} AND event_id < {hi}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
        time.sleep(0.05)
    live = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/e")
    sent = suppress_stream(live, ["event_type"], "ts", 3600)
    q = (sent.writeStream.format("parquet").option("path", f"{tmp_path}/sent").option("checkpointLocation", f"{tmp_path}/c1")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    batch = suppress_repeats(e, ["event_type"], "ts", 3600).select("event_type", F.col("ts").cast("timestamp"))
    assert rows(spark.read.parquet(f"{tmp_path}/sent"), "event_type", "ts") == rows(batch, "event_type", "ts")

    plan = plan_psi(e, ["value"])
    whole = rows(drift_windows(e, e, "ts", "value", plan).select("window_start", "n_curr", F.round("psi", 9)), "window_start")
    q = drift_stream(live, e, "ts", "value", lambda b, i: b.write.mode("append").parquet(f"{tmp_path}/psi"), plan)
    q.option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start().awaitTermination()
    closed = rows(spark.read.parquet(f"{tmp_path}/psi").select("window_start", "n_curr", F.round("psi", 9)), "window_start")
    assert closed == whole[: len(closed)] and len(whole) - len(closed) <= 3


def test_suppression_state_ends(spark, tmp_path):
    """Late events, a restart from the checkpoint after every file, and state that goes with its window."""
    source, state, out = (f"{tmp_path}/{x}" for x in ("in", "state", "out"))
    held = []
    files = [
        [("a", 0), ("a", 299), ("b", 100), ("c", None), (None, 50)],
        [("a", 300), ("b", 350), ("a", 250), ("a", 1000)],  # 250 is out of order, and a repeat of 0; the watermark goes to 400
        [("b", 5000)],  # the watermark goes to 4400: every other signature's window is over
        [("a", 4300), ("b", 5299), ("d", 4500), ("b", 5300)],  # 4300 is beyond the watermark
    ]
    for rows_ in files:
        new = spark.createDataFrame(rows_, "s string, t bigint").select("s", F.timestamp_seconds(F.col("t") + 10**6).alias("ts"))
        new.coalesce(1).write.mode("append").parquet(source)
        live = spark.readStream.schema("s string, ts timestamp").parquet(source)
        sent = suppress_stream(live, ["s"], "ts", 300, late="10 minutes")
        q = (sent.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
        left = spark.read.format("statestore").option("path", state).option("stateVarName", "last").load()
        held.append(sorted(str(r.key[0]) for r in left.select("key").collect()))
    got = sorted(rows(spark.read.parquet(out).select(F.coalesce("s", F.lit("")), F.unix_seconds("ts") - 10**6)))
    assert got == [("", 50), ("a", 0), ("a", 300), ("a", 1000), ("b", 100), ("b", 5000), ("b", 5300), ("d", 4500)]
    assert held == [['{"s":"a"}', '{"s":"b"}', "{}"], ['{"s":"a"}'], ['{"s":"b"}'], ['{"s":"b"}', '{"s":"d"}']]


def test_suppression_with_shared_states(spark, tmp_path):
    """Signatures that share states: the alerts of a state each, late events and restarts included, in a bounded number of states."""
    source, got, left = f"{tmp_path}/in", {}, {}
    rng = np.random.RandomState(3)
    files = [[(f"s{int(s)}", int(t)) for s, t in zip(rng.randint(0, 60, 400), rng.randint(lo, lo + 1500, 400), strict=True)] for lo in (0, 900, 1800, 9000)]
    files[1] += [(None, 1000), (None, 1100), ("s1", None)]
    for rows_ in files:
        new = spark.createDataFrame(rows_, "s string, t bigint").select("s", F.timestamp_seconds(F.col("t") + 10**6).alias("ts"))
        new.coalesce(1).write.mode("append").parquet(source)
        for groups in (None, 7):
            live = spark.readStream.schema("s string, ts timestamp").parquet(source)
            sent = suppress_stream(live, ["s"], "ts", 300, late="10 minutes", groups=groups)
            (sent.writeStream.format("parquet").option("path", f"{tmp_path}/out{groups}").option("checkpointLocation", f"{tmp_path}/state{groups}")
             .outputMode("append").trigger(availableNow=True).start().awaitTermination())
    for groups in (None, 7):
        got[groups] = sorted(rows(spark.read.parquet(f"{tmp_path}/out{groups}").select(F.coalesce("s", F.lit("")), F.unix_seconds("ts") - 10**6)))
        left[groups] = spark.read.format("statestore").option("path", f"{tmp_path}/state{groups}").option("stateVarName", "last").load().select("key").distinct().count()
    assert got[7] == got[None] and ("", 1000) in got[7] and ("", 1100) not in got[7]
    want, newest, at = {}, 0, []
    for rows_ in files:  # each run ends with a batch without data, after which the watermark holds
        for s, t in sorted((s or "", t) for s, t in rows_ if t is not None and (not newest or t > newest - 600)):
            if t >= want.get(s, -(10**9)) + 300:
                want[s] = t
                at.append((s, t))
        newest = max(newest, max(t for _, t in rows_ if t is not None))
    assert got[7] == sorted(at)
    assert left[7] <= 7 < left[None]


def test_train_job(spark, tmp_path):
    rng = np.random.RandomState(0)
    pdf = pd.DataFrame({"id": range(200), "a": rng.rand(200), "b": rng.rand(200)})
    pdf["y"] = pdf["a"] * 3 + pdf["b"]
    pdf.to_csv(tmp_path / "t.csv", index=False)
    r = train_job(spark, f"{tmp_path}/t.csv", "y", "id", f"{tmp_path}/out", trials=1, folds=2, rounds=(2, 3), final_trees=3).first()
    assert r["problem_type"] == "regression" and {x.n + x.missing for x in spark.read.parquet(r["drift_reference"]).collect()} == {200}
    assert spark.read.parquet(f"{r['report']}/describe").count() == 4
    with pytest.raises(KeyError):
        train_job(spark, f"{tmp_path}/t.csv", "zz", "id", f"{tmp_path}/out2")
