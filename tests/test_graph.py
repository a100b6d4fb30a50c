import pytest
from pyspark.sql import functions as F

from causeway.operators import graph

DAG = [("a", "c"), ("b", "c"), ("c", "d"), ("d", "e"), ("b", "f")]


@pytest.fixture(scope="module")
def dag(spark):
    return spark.createDataFrame(DAG, "parent string, child string")


def test_closure(spark, dag):
    got = {tuple(r) for r in graph.descendants(dag).collect()}
    assert ("a", "e") in got and ("a", "f") not in got and len(got) == 10
    again = graph.descendants(spark.createDataFrame(list(got), "parent string, child string"))
    assert {tuple(r) for r in again.collect()} == got


def test_paths_and_cycles(spark, dag):
    more = dag.union(spark.createDataFrame([("a", "d"), ("e", "c")], "parent string, child string"))
    pairs = spark.createDataFrame([("a", "d"), ("e", "f"), ("a", "a")], "start string, end string")
    got = graph.simple_paths(pairs, more).orderBy("start", "end", "path_ord").collect()
    assert [r["path"] for r in got] == [["a"], ["a", "d"], ["a", "c", "d"]]
    assert [r["cycle"] for r in graph.simple_cycles(more).collect()] == [["c", "d", "e"]]
    two = spark.createDataFrame([("x", "y"), ("y", "x"), ("x", "x")], "parent string, child string")
    assert [r["cycle"] for r in graph.simple_cycles(two).collect()] == [["x", "y"]]
    both = more.union(spark.createDataFrame([("d", "c"), ("e", "b")], "parent string, child string"))
    got = {tuple(r["cycle"]) for r in graph.shortest_cycles(both).collect()}
    assert got == {("c", "d"), ("c", "d", "e"), ("b", "c", "d", "e")}
    assert graph.shortest_cycles(dag).isEmpty()


def test_blankets(spark, dag):
    nodes = spark.createDataFrame([(n,) for n in "abcdefg"], "node string")
    mb = {}
    for r in graph.markov_blankets(dag, nodes).collect():
        mb.setdefault(r["center"], set()).add(r["node"])
    assert mb["a"] == {"a", "b", "c"} and mb["c"] == {"a", "b", "c", "d"} and mb["g"] == {"g"}
    assert {r["node"] for r in graph.isolated(nodes, dag).collect()} == {"g"}
    assert {r["node"] for r in graph.orphans(nodes, dag).collect()} == {"a", "b", "g"}


D_CASES = [
    ([], ("a", "c", "d"), True), (["c"], ("a", "c", "d"), False), ([], ("a", "c", "b"), False),
    (["c"], ("a", "c", "b"), True), (["e"], ("a", "c", "b"), True), (["f"], ("a", "c", "b"), False),
    ([], ("c", "b", "f"), True), (["b"], ("c", "b", "f"), False),
]


def test_d_connection(spark, dag):
    obs = spark.createDataFrame([(i, s) for i, (seen, _, _) in enumerate(D_CASES) for s in seen], "query_id int, node string")
    tri = spark.createDataFrame([(i, *t) for i, (_, t, _) in enumerate(D_CASES)], "query_id int, prev string, mid string, next string")
    got = {r["query_id"]: r["connected"] for r in graph.d_connected(tri, dag, obs).collect()}
    assert [got[i] for i in range(len(D_CASES))] == [want for _, _, want in D_CASES]


def test_open_paths(spark, dag):
    def run(cases, hops):
        s = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "query_id int, source string")
        b = spark.createDataFrame([(i, x) for i, c in enumerate(cases) for x in c[1]], "query_id int, node string")
        o = spark.createDataFrame([(i, x) for i, c in enumerate(cases) for x in c[2]], "query_id int, node string")
        got = {r["query_id"]: r["path"] for r in graph.separation_aware_paths(s, b, o, dag, hops, 6).collect()}
        return [got.get(i) for i in range(len(cases))]

    cases = [("a", ["e"], ["a"]), ("a", ["f"], ["a"]), ("a", ["f"], ["a", "e"]), ("a", ["e"], ["a", "d"])]
    assert run(cases, None) == [["a", "c", "d", "e"], None, ["a", "c", "b", "f"], None]
    assert run(cases[:1], 2) == [None]


def test_colliders_and_forced_orientation(spark):
    skel = spark.createDataFrame([("a", "c"), ("b", "c"), ("c", "d")], "a string, b string")
    seps = spark.createDataFrame([("a", "b", []), ("a", "d", ["c"]), ("b", "d", ["c"])], "a string, b string, s array<string>")
    tri = [tuple(r) for r in graph.sepset_colliders(skel, seps).collect()]
    assert tri == [("a", "c", "b")]
    directed = spark.createDataFrame([("a", "c"), ("b", "c")], "parent string, child string")
    rest = spark.createDataFrame([("c", "d")], "a string, b string")
    out, left = graph.meek_orient(directed, rest)
    assert {tuple(r) for r in out.collect()} == {("a", "c"), ("b", "c"), ("c", "d")} and left.isEmpty()
    kite = spark.createDataFrame([("x", "z"), ("y", "z")], "parent string, child string")
    open_ = spark.createDataFrame([("w", "x"), ("w", "y"), ("w", "z")], "a string, b string")
    out, left = graph.meek_orient(kite, open_)
    assert ("w", "z") in {tuple(r) for r in out.collect()}
    assert left.where(F.col("b") == "z").isEmpty()
