"""Streams: the tables are read as file streams, run until all input is used, and the sink is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import scratch, stream, table
from checks.drift import ORACLES as _DRIFT
from checks.models import _regression_model
from prepkit.operators.drift import plan_psi
from prepkit.streaming.alerts import suppress_stream
from prepkit.streaming.drift import drift_stream as start_drift
from prepkit.streaming.scoring import predict_stream as score

#: States that the signatures of ``suppress_repeats_stream`` share.
GROUPS = 1 << 12


def _drain(writer, checkpoint):
    q = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def drift_stream(spark, d):
    home = scratch(spark)
    base = table(spark, d, "events").filter("event_type = 'purchase'")
    plan = plan_psi(base, ["value"])
    live = stream(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))

    def sink(batch, epoch):
        batch.write.mode("append").parquet(f"{home}/out")

    _drain(start_drift(live, base, "ts", "value", sink, plan), f"{home}/state")
    out = spark.read.parquet(f"{home}/out")
    return out.withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "psi": F.round("psi", 6)})


def suppress(spark, d):
    home = scratch(spark)
    sent = suppress_stream(stream(spark, d, "events"), ["event_type", "user_id"], "ts", 300, groups=GROUPS)
    _drain(sent.writeStream.outputMode("append").format("parquet").option("path", f"{home}/out"), f"{home}/state")
    return spark.read.parquet(f"{home}/out").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def predict_stream(spark, d):
    home = scratch(spark)
    model, _, _ = _regression_model(spark, d)
    live = stream(spark, d, "part").withColumn("position", F.col("p_partkey"))
    _drain(score(model, live, ["p_partkey"]).writeStream.format("parquet").option("path", f"{home}/out"), f"{home}/state")
    return spark.read.parquet(f"{home}/out")


QUERIES = {"drift_stream": drift_stream, "suppress_repeats_stream": suppress, "predict_stream": predict_stream}

ORACLES = {
    # closed windows only: the ones the watermark (one hour behind the newest event) has passed
    "drift_stream": f"SELECT * FROM ({_DRIFT['drift_windows']}) WHERE window_start + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)",
    "suppress_repeats_stream": _DRIFT["suppress_repeats"],
}
