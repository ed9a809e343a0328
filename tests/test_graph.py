import itertools

import pytest
from lodestrata.operators import search, traverse
from lodestrata.operators.tables import dense_index, following


def naive(edges, seeds, depth, direction):
    seen, front = dict.fromkeys(seeds, 0), set(seeds)
    for level in range(1, depth + 1):
        front = {y for a, b in edges for x, y in (((a, b),) if direction == "out" else ((b, a),) if direction == "in" else ((a, b), (b, a))) if x in front} - seen.keys()
        seen |= dict.fromkeys(front, level)
    return seen


PAIRS = [(a, b) for a in "012" for b in "012" if a != b]


def test_all_three_node_digraphs_at_once(spark):
    """All 64 digraphs on three nodes side by side, as one graph of 192 nodes."""
    graphs = [[p for k, p in enumerate(PAIRS) if mask >> k & 1] for mask in range(64)]
    rows = [(1, f"{g}:{a}", f"{g}:{b}") for g, es in enumerate(graphs) for a, b in es]
    edges = spark.createDataFrame(rows, "kind int, src string, dst string").cache()
    seeds = spark.createDataFrame([(f"{g}:0",) for g in range(64)], "node_id string")
    for direction, depth in itertools.product(("in", "out", "both"), range(4)):
        want = {(f"{g}:{n}", x) for g, es in enumerate(graphs) for n, x in naive(es, ["0"], depth, direction).items()}
        assert {tuple(r) for r in traverse.distances(edges, seeds, depth, direction).collect()} == want
        if depth == 3:
            turned = edges.selectExpr("kind", "dst as src", "src as dst")
            for most in (10, 70):
                assert {tuple(r) for r in traverse.distances(edges, seeds, depth, direction, None, turned, most).collect()} == want


def test_chain_with_loop(spark):
    edges = spark.createDataFrame([(1, a, b) for a, b in (("0", "1"), ("1", "2"), ("2", "3"), ("3", "4"), ("2", "2"))], "kind int, src string, dst string")
    assert traverse.shortest_path(edges, "0", "4", 8, "out") == list("01234")
    assert traverse.shortest_path(edges, "4", "0", 8, "out") is None
    assert traverse.shortest_path(edges, "0", "4", 3, "out") is None
    assert traverse.shortest_path(edges, "2", "2") == ["2"]
    # the same with frontiers as tables, from the beginning and after a level
    for most in (0, 1):
        assert traverse.shortest_path(edges, "0", "4", 8, "out", most_sent=most) == list("01234")
        assert traverse.shortest_path(edges, "4", "0", 8, "out", most_sent=most) is None
    seeds = spark.createDataFrame([("4",), ("0",), ("4",)], "node_id string")
    reached = traverse.distances(edges, seeds, 1)
    assert {tuple(r)[1:] for r in traverse.expanded_edges(edges, reached, 1).collect()} == {("0", "1"), ("3", "4")}
    with pytest.raises(search.UserError):
        traverse.distances(edges, seeds, 65)


def test_search_order(spark):
    from lodestrata.operators.catalogue import lookup

    rows = [("a" * 32, 6, "Abc", "x::Abc", "f.c", 1), ("b" * 32, 6, "Abcd", "Abcd", "f.c", 1 + 16), ("c" * 32, 3, "zAbc", "zAbc", None, 0), ("d" * 32, 2, "", "", None, 0)]
    nodes = spark.createDataFrame(rows, "node_id string, kind int, name string, qualified_name string, file_path string, flags int")
    keys = lookup(nodes).cache()
    assert search.named(keys, "Abcd") == ["b" * 32] and search.named(keys, "A" * 32) == ["a" * 32]
    assert [r.node_id[0] for r in search.ranked(search.hits(keys.drop("kind", "flags", "path"), "Abc"), nodes).collect()] == ["a", "b", "c"]
    got = search.ranked(search.hits(keys, "Abc"), nodes, 10).collect()
    assert [(r.node_id[0], r.strength, r.target) for r in got] == [("a", 0, 0), ("b", 1, 0), ("c", 2, 0)]
    assert search.hits(keys, "aBC", ignore_case=True).count() == 3
    assert search.resolve(keys, nodes, "B" * 32).first().name == "Abcd"
    for bad in ("", "x" * 4097, "\ud800"):
        with pytest.raises(search.UserError):
            search.hits(keys, bad)


def test_windows(spark):
    df = spark.range(1000).selectExpr("id", "id * 7919 % 1000 as k")
    assert sorted((r.k, r.dense_idx) for r in dense_index(df, ["k"]).collect()) == [(i, i) for i in range(1000)]
    rows = spark.createDataFrame([(1, 1, "n", "Note"), (1, 2, "m", "Note"), (1, 3, "f", "Function"), (1, 9, "z", "Note")], "f int, l int, name string, kind string")
    many = spark.range(60_000).selectExpr("1 as f", "id as l", "cast(id as string) as name", "if(id < 59999, 'Note', 'Function') as kind")
    assert following(many, "f", ["l"], "kind = 'Note'", "name", "l").filter("target = '59999'").count() == 59_999
    assert sorted((r.name, r.target) for r in following(rows, "f", ["l"], "kind = 'Note'", "name", "l").collect()) == [("m", "f"), ("n", "f")]
