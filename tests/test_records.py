"""CSV files whose records span lines, cut into many ranges, against Python's csv module."""

import csv
import io
import random

import pytest

from prepkit.sources import readers, records
from prepkit.sources.records import Quotes, spanning_records


@pytest.fixture(params=[1 << 27, 23])
def ranges(spark, request):
    """The size of a range of a file."""
    keys = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _values(seed, n):
    rng = random.Random(seed)
    parts = ["a", "b c", ",", '"', "\n", "\r\n", '""', '","', '\n"', "é", "0", "\n\n\n", ',"x', "long " * 9]
    return [["".join(rng.choice(parts) for _ in range(rng.randint(0, 7))) or "-" for _ in range(3)] for _ in range(n)]


def _text(rows, end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end).writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_values_with_line_breaks_in_many_ranges(spark, tmp_path, ranges, end):
    want = []
    for i in range(3):
        rows = _values(i, 12 + 9 * i)
        (tmp_path / f"f{i}.csv").write_bytes(_text([["x", "y", "x"], *rows], end).encode())
        want += rows
    df = readers.read_csv(spark, str(tmp_path), ",")
    assert df.columns == readers.dedupe_names(["x", "y", "x"])
    got = [tuple(r) for r in df.collect()]
    assert sorted(got) == sorted(map(tuple, want))
    if ranges < 1000:
        assert records._lines(spark, str(tmp_path)).select("file", "start").distinct().count() > 30


def test_a_value_over_whole_ranges_and_an_open_end(spark, tmp_path, ranges):
    (tmp_path / "f.csv").write_text('k,v\n1,"' + "line\n" * 60 + 'end"\n2,plain\n\n3,"also\nhere"\n4,"never closed\nat all\n')
    got = {r["k"]: r["v"] for r in readers.read_csv(spark, str(tmp_path / "f.csv"), ",").collect()}
    assert got[1] == "line\n" * 60 + "end" and got[2] == "plain" and got[3] == "also\nhere" and set(got) == {1, 2, 3, 4} and "at all" in got[4]


def test_a_header_that_spans_lines(spark, tmp_path, ranges):
    (tmp_path / "f.csv").write_text('"a\nfirst",b\n"x\ny",2\nz,3\n')
    df = readers.read_csv(spark, str(tmp_path / "f.csv"), ",")
    assert df.columns == ["a\nfirst", "b"] and sorted(map(tuple, df.collect())) == [("x\ny", 2), ("z", 3)]


def test_no_spanning_record_is_left_to_sparks_reader(spark, tmp_path, ranges):
    (tmp_path / "f.csv").write_text('a,b\n"x,""y""",5" pipe\nq,"w"\n')
    assert spanning_records(spark, str(tmp_path / "f.csv"), ",") is None
    df = readers.read_csv(spark, str(tmp_path / "f.csv"), ",")
    assert sorted(map(tuple, df.collect())) == [("q", "w"), ('x,"y"', '5" pipe')]


def test_quotes_against_the_csv_module():
    """A text ends inside quotes where the csv module, given one more line, makes no new record of it."""
    rng = random.Random(7)
    for _ in range(3000):
        # well-formed fields: quotes open at a field's start and are doubled inside
        fields = [rng.choice(["a", "", 'm"id', '"q"', '"q,""r"""', '""']) for _ in range(rng.randint(1, 4))]
        line = ",".join(fields) + rng.choice(["", ',"open', ',"open""', ',"open"",x', ',"open""",x'])
        rows = list(csv.reader(io.StringIO(line + "\nNEXT\n")))
        assert Quotes(",").ends_inside(line, False) == (len(rows) == 1), line
    assert Quotes("||").ends_inside('a||"b', False) and not Quotes("||").ends_inside('a|"b', False)
    assert Quotes(",").ends_inside('no quote', True) and not Quotes(",").ends_inside('end",x', True) and Quotes(",").ends_inside('end","x', True)


def test_types_like_those_of_sparks_reader(spark, tmp_path):
    head = "i,l,big,d,e,day,at,flag,text,none\n"
    rows = ['1,5000000000,123456789012345678901,1.5,1e3,2024-01-02,2024-01-02 03:04:05,true,"a",', '-2,7,2,3,NaN,2024-02-03,2024-01-02,FALSE,1x,', ",,,,,,,,,"]
    (tmp_path / "plain.csv").write_text(head + "\n".join(rows) + "\n")
    (tmp_path / "span.csv").write_text(head + "\n".join(rows).replace('"a"', '"a\nb"') + "\n")
    plain, span = (readers.read_csv(spark, str(tmp_path / f"{n}.csv"), ",") for n in ("plain", "span"))
    assert span.dtypes == plain.dtypes
    drop = lambda df: sorted(str(tuple(r)).replace("a\\nb", "a") for r in df.collect())
    assert drop(span) == drop(plain)


def test_a_schema_and_a_compressed_file(spark, tmp_path, ranges):
    import gzip

    with gzip.open(tmp_path / "f.csv.gz", "wt") as f:
        f.write('k,v\n1,"a\nb"\n2,c\n')
    df = readers.read_csv(spark, str(tmp_path / "f.csv.gz"), ",", schema="k int, v string")
    assert df.dtypes == [("k", "int"), ("v", "string")] and sorted(map(tuple, df.collect())) == [(1, "a\nb"), (2, "c")]
