import json

from hypothesis import given, settings
from hypothesis import strategies as st
from lodestrata.operators import nested
from pyspark.sql import functions as F


def brute(record):
    found = set()

    def walk(v, path, parent, element):
        if isinstance(v, str):
            try:
                w = json.loads(v, parse_constant=lambda c: 1 / 0)
                v = w if isinstance(w, (dict, list)) else v
            except (ValueError, ZeroDivisionError):
                pass
        if isinstance(v, dict):
            if element:
                found.add((path, parent))
                parent = path
            for k, x in v.items():
                walk(x, f"{path}/{k.replace('~', '~0').replace('/', '~1')}", parent, False)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{path}/{i}", parent, True)

    walk(json.loads(record), "", "", False)
    return found


def paths(record):
    return {(n.path, n.parent) for n in nested.parse(record) if n.path}


values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=6), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(alphabet='ab/~"\\é', max_size=3), x, max_size=4), max_leaves=25)


@given(values, st.booleans())
@settings(max_examples=300, deadline=None)
def test_any_record(value, quoted):
    record = json.dumps(value)
    record = json.dumps(record) if quoted else record
    assert paths(record) == brute(record)


def test_text_values_that_are_json():
    record = json.dumps({"a": [json.dumps({"b": [{}, {"c": json.dumps([[{}]])}]}), '{"x":', "[1] "]})
    assert paths(record) == {("/a/0", ""), ("/a/0/b/0", "/a/0"), ("/a/0/b/1", "/a/0"), ("/a/0/b/1/c/0/0", "/a/0/b/1")}


def test_ends_early():
    whole = '{"e":[{"p":[{"x":1},{"y":2}]},{"q":[{}]}]}'
    assert paths(whole[:25]) == {("/e/0/p/0", "/e/0")}
    assert paths("﻿" + whole + "\n") == paths(whole)
    assert paths(whole + "}") == paths(whole)
    for record in (None, "", "  ", "nonsense", "[1,,{}]", '"\\ud800"', "[" * 5000):
        assert isinstance(nested.parse(record), list)


def test_tables(spark):
    record = json.dumps({"c": {"v": "1"}, "e": [{"t": 5, "p": {"l": [{"h": "a"}, {"h": None}]}}, {}]})
    df = spark.createDataFrame([(1, record, "x"), (1, record, "x"), (2, None, "y"), (3, "", None)], "id int, record string, value string")
    t = nested.triples(df, "id", "record")
    assert sorted(map(tuple, nested.nodes(df, "id", "record").select("node_path", "parent_path", "ordinal").collect())) == [("/e/0", "", 0), ("/e/0/p/l/0", "/e/0", 0), ("/e/0/p/l/1", "/e/0", 1), ("/e/1", "", 1)]
    events = nested.flat_table(t, "id", F.col("grp") == "/e/*", {"/t": "t"})
    assert sorted((r.node_path, r.t) for r in events.collect()) == [("/e/0", "5"), ("/e/1", None)]
    assert [r.v for r in nested.record_table(t, "id", {"/c/v": "v"}).collect()] == ["1"]
    assert nested.triples(df.limit(0), "id", "record").count() == 0


def test_tables_keep_every_scalar(spark, tmp_path):
    from lodestrata.plans import records

    record = {
        "constants": {"logEventTypes": {"A": 1}, "trials": [{"trial": "t", "x": {"y": 2}}]},
        "events": [{"type": 5, "params": {"url": "u", "note": None, "l": [{"name": "n", "value": "v"}, {"aliases": ["p", "q"]}]}}],
        "polledData": {"capacity": 9, "pools": [{"name": "s", "groups": {"g": {"pending": 3, "idle": [{"id": 1}]}}}]},
        "more": [{"z": True}],
    }
    text = json.dumps(record)[:-1] + ', "twice": 1, "twice": null, "twice": 2}'
    df = spark.createDataFrame([(1, text), (1, text), (2, None)], "capture_id bigint, record string")
    df.write.parquet(str(tmp_path / "netlog_captures.parquet"))
    tables = [records.p1_events, records.p1_params, records.p1_polled, records.p1_others, records.p1_constants]
    got = set()
    for query in tables:
        for r in query(spark, str(tmp_path)).collect():
            named = {k: v for k, v in r.asDict().items() if k not in ("capture_id", "grp", "node_path", "parent_path", "ordinal", "rest", "n_scalars") and v is not None}
            assert r.n_scalars == len(named) + len(r.rest)
            path = getattr(r, "node_path", "")
            got |= {(path, v) for v in (*named.values(), *r.rest.values())}
            assert query is records.p1_constants or r.grp.replace("*", "0") == path.replace("/1", "/0")
    want = {(n.path, v) for n in nested.parse(text) for f, v, _ in n.fields if f != "/twice"}
    assert got == want | {("", "2")} and len(want) == 15


def test_a_table_for_each_group(spark):
    record = {"v": 1, "id": 7, "e": [{"t": 5, "p": {"l": [{"h": "a", "h-": "b"}, {"h": None}]}}, {}], "big": [{str(k): k for k in range(9)}]}
    df = spark.createDataFrame([(1, json.dumps(record)), (2, json.dumps({"e": [{"t": 6}]})), (3, None)], "id int, record string")
    tables = nested.group_tables(nested.triples(df, "id", "record").cache(), "id", most_fields=4)
    assert tables.keys() == {"", "/e/*", "/e/*/p/l/*", "/big/*"}
    assert [(r.id, r.v, r.value_id) for r in tables[""].collect()] == [(1, "1", "7")]
    assert sorted((r.id, r.node_path, r.t) for r in tables["/e/*"].collect()) == [(1, "/e/0", "5"), (1, "/e/1", None), (2, "/e/0", "6")]
    assert sorted((r.parent_path, r.h, r.h_) for r in tables["/e/*/p/l/*"].collect() if r.h) == [("/e/0", "a", "b")]
    wide = tables["/big/*"].first()
    assert len(wide.rest) == 5 and {wide[c] for c in wide.asDict() if c in "0123"} == {"0", "1", "2", "3"}


def test_stream(spark, tmp_path):
    from lodestrata.streaming import captures

    rows = spark.createDataFrame([(1, '{"a":[{}]}'), (1, '{"a":[{}]}'), (2, '[{"b":[{}]}]'), (1, '{"a":[{},{}]}'), (1, None)], "capture_id bigint, record string").withColumn("received_at", F.current_timestamp())
    rows.write.parquet(str(tmp_path / "in"))
    captures.write(captures.node_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
