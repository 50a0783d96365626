"""JSON arrays cut into many ranges, against Python's json module."""

import json
import random

import pytest

from prepkit.sources import elements, readers


@pytest.fixture(params=[1 << 27, 29])
def ranges(spark, request):
    """The size of a range of a file."""
    keys = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield request.param
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _objects(seed, n):
    rng = random.Random(seed)
    parts = ["a", "}", "{", "]", "[", '"', "\\", "\n", ",", "é", '\\"', "}]", " ", "long " * 12]
    text = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))
    return [{"k": i + 1000 * seed, "s": text(), "in": {"t": text(), "l": [{"x": text()} for _ in range(rng.randint(0, 2))]}} for i in range(n)]


@pytest.mark.parametrize("indent", [None, 2])
def test_objects_of_arrays_in_many_ranges(spark, tmp_path, ranges, indent):
    want = []
    for i in range(3):
        rows = _objects(i, 8 + 5 * i)
        (tmp_path / f"f{i}.json").write_text(" " * i + json.dumps(rows, indent=indent) + "\n" * i)
        want += rows
    (tmp_path / "none.json").write_text(" [ ]\n")
    got = [json.loads(r["text"]) for r in elements.array_objects(spark, str(tmp_path)).collect()]
    key = lambda r: r["k"]
    assert sorted(got, key=key) == sorted(want, key=key)
    if ranges < 1000:
        assert elements._pieces(spark, str(tmp_path)).select("file", "start").distinct().count() > 20
    back = {r["k"]: (r["s"], r["in.t"], [x["x"] for x in r["in.l"]]) for r in readers.read_json_records(spark, str(tmp_path)).collect()}
    assert back == {r["k"]: (r["s"], r["in"]["t"], [x["x"] for x in r["in"]["l"]]) for r in want}


def test_an_object_over_whole_ranges(spark, tmp_path, ranges):
    rows = [{"a": "x" * 500, "b": {"c": {"d": "} " * 100}}}, {"a": "y", "b": None}, {}]
    (tmp_path / "f.json").write_text(json.dumps(rows))
    got = [json.loads(r["text"]) for r in elements.array_objects(spark, str(tmp_path / "f.json")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, rows))


def test_what_is_no_array_of_objects_is_left_to_sparks_reader(spark, tmp_path):
    (tmp_path / "one.json").write_text('{"a": 1,\n "b": {"c": "x"}}')
    assert elements.read_arrays(spark, str(tmp_path / "one.json")) is None
    assert [tuple(r) for r in readers.read_json_records(spark, str(tmp_path / "one.json")).collect()] == [(1, "x")]
    (tmp_path / "mixed.json").write_text('[1, {"a": 2}]')
    assert elements.read_arrays(spark, str(tmp_path / "mixed.json")) is None


def test_states_compose():
    """A text cut anywhere after a brace: the state after it is that of its parts in turn."""
    rng = random.Random(4)
    text = json.dumps(_objects(9, 30))
    cuts = [i + 1 for i, c in enumerate(text) if c == "}"]
    for _ in range(50):
        at = rng.choice(cuts)
        inside, depth = elements.advance(text[:at], False)
        after, more = elements.advance(text[at:], inside)
        assert (after, depth + more) == elements.advance(text, False) == (False, 0)
