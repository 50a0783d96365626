"""Cases that once gave wrong rows, crashed, or changed with the size of the table."""

import datetime as dtm

import pytest
from pyspark.sql import functions as F

from prepkit.operators import ordering as od
from prepkit.operators import profile as pf
from prepkit.operators import scoring as sc
from prepkit.plans import automl as am
from prepkit.sources import readers as rd
from prepkit.streaming.alerts import suppress_repeats
from tests.conftest import rows


@pytest.mark.parametrize("parts,hot", [(1, 10), (4, 1)])
def test_events_without_a_time_hide_no_others(spark, parts, hot):
    day = lambda n: dtm.datetime(2024, 1, n)
    df = spark.createDataFrame([("a", None), ("a", day(1)), ("a", day(2)), ("b", None), ("a", day(2))], "s string, t timestamp_ntz")
    assert rows(suppress_repeats(df, ["s"], "t", 300, parts, hot), "t") == [("a", day(1)), ("a", day(2))]


def test_line_breaks_and_separators_in_quotes(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,"a,b",id\n1,"x\ny",2\n2,z,3\n')
    df = rd.read_csv(spark, str(path), ",")
    assert df.columns[:2] == ["id", "a,b"] and len(set(df.columns)) == 3
    assert rows(df, "id") == [(1, "x\ny", 2), (2, "z", 3)]


def test_dates_are_judged_by_all_rows(spark):
    late = spark.range(1000).select(F.when(F.col("id") < 300, "n/a x").otherwise(F.lit("2024-01-02")).alias("t"))
    assert rd.date_parse_plan(late, 0.6).keys() == {"t"}
    early = spark.range(1000).select(F.when(F.col("id") < 300, F.lit("2024-01-02")).otherwise("word").alias("t"))
    assert not rd.date_parse_plan(early)


def test_infinite_values_have_no_bin(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.0, float("inf"), float("-inf"), float("nan"), None)], "x double")
    assert [r["n"] for r in pf.histogram(df, bins=2).orderBy("bin").collect()] == [1, 2]
    only = df.filter(F.abs("x") == float("inf"))
    assert pf.histogram(only).count() == 0


def test_rows_in_the_order_of_a_text(scaled, spark):
    df = spark.range(500).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("k"), F.col("id").cast("double").alias("p"))
    got = rows(sc.predict_chunks(df, "p", ["k"], 7), "chunk")
    scaled.conf.unset("spark.prepkit.rangeRows")
    assert got == rows(sc.predict_chunks(df, "p", ["k"], 7), "chunk")
    holes = df.withColumn("k", F.expr("nullif(k, '0007')"))
    assert [r[0] for r in rows(od.row_numbers(holes, [], "k", parts=9).filter("k IS NULL").select("_pos"))] == [1]


def test_reports_show_all_columns(spark):
    wide = spark.range(3).select(*[(F.col("id") * i).alias(f"c{i}") for i in range(310)])
    assert pf.schema_profile(wide).count() == 310
    few = wide.select(*wide.columns[:30])
    assert pf.describe_numeric(few).count() == pf.describe_all(few).count() == 30
    assert pf.histogram(few, bins=2).select("feature").distinct().count() == 30


def test_every_value_has_its_own_slot(spark):
    df = spark.range(3000).select("id", F.concat(F.lit("v"), F.col("id").cast("string")).alias("c"))
    pre = am.build_preprocessor(df, ["c"]).fit(df)
    assert len(am.feature_names(pre, [])) == 3000
    assert pre.transform(df).select(F.col("features").cast("string")).distinct().count() == 3000


def test_training_sees_no_test_row(spark):
    from prepkit.operators.splits import stratified_split

    data = [(i, float(i % 10), "x" if i % 2 else "y", i % 2) for i in range(120)]
    df = spark.createDataFrame(data, "id bigint, n double, c string, y int")
    text = df.withColumn("_t", F.col("y").cast("string")).withColumn("label", F.col("y").cast("double"))
    held = {r["id"] for r in stratified_split(text, ["id"], "label", 0.2, 42).filter("is_test").collect()}
    odd = df.withColumn("c", F.when(F.col("id").isin(*held), "only in the test rows").otherwise(F.col("c")))
    out = am.train_baseline(odd, "y", ["id"], calibrated=False, trees=3, families=["Linear"])
    assert out.predictions.count() == len(held)
    assert not [n for n in out.feature_names if "only in the test" in n]
