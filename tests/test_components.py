"""Strong components against mutual reachability; wide dictionaries against sorted states."""

import random

import pytest
from pyspark.sql import functions as F

from causeway.operators import encode, graph


def mutual(edges):
    nodes = sorted({v for e in edges for v in e})
    ahead = {v: {v} for v in nodes}
    grown = True
    while grown:
        grown = False
        for a, b in edges:
            for v in nodes:
                if a in ahead[v] and b not in ahead[v]:
                    ahead[v].add(b)
                    grown = True
    return {v: min(u for u in ahead[v] if v in ahead[u]) for v in nodes}


@pytest.mark.parametrize("seed, n, m", [(1, 12, 14), (2, 30, 45), (3, 9, 60), (4, 40, 38)])
def test_components(spark, seed, n, m):
    rng = random.Random(seed)
    edges = [(f"v{rng.randrange(n)}", f"v{rng.randrange(n)}") for _ in range(m)]
    df = spark.createDataFrame(edges, "parent string, child string")
    want = mutual(edges)
    got = graph.strong_components(df, spark.createDataFrame([("alone",)], "node string"))
    assert {r.node: r.component for r in got.collect()} == want | {"alone": "alone"}
    cyclic = {(r.parent, r.child) for r in graph.cyclic_edges(df).collect()}
    assert cyclic == {(a, b) for a, b in edges if a != b and want[a] == want[b]}


def test_two_rings_and_a_bridge(spark):
    ring = lambda names: list(zip(names, names[1:] + names[:1]))
    edges = ring(list("cab")) + ring(list("xyz")) + [("a", "x"), ("s", "c"), ("z", "t"), ("q", "q")]
    got = {r.node: r.component for r in graph.strong_components(spark.createDataFrame(edges, "parent string, child string")).collect()}
    assert got == {**dict.fromkeys("abc", "a"), **dict.fromkeys("xyz", "x"), "s": "s", "t": "t", "q": "q"}
    assert graph.strong_components(spark.createDataFrame([], "parent string, child string")).count() == 0


def test_wide_codes(spark):
    rng = random.Random(5)
    rows = [(k, None if k % 50 == 0 else f"s{rng.randrange(10**6)}", "hot" if k % 3 else f"t{k}") for k in range(1500)]
    df = spark.createDataFrame(rows, "k long, a string, b string").repartition(6)
    place = [{s: i for i, s in enumerate(sorted({r[c] or "" for r in rows}))} for c in (1, 2)]
    got = {r.k: (r.a, r.b) for r in encode.encode_wide(df, ["a", "b"], ["k"]).collect()}
    assert got == {k: (place[0][a or ""], place[1][b]) for k, a, b in rows}
    book = {(r["var"], r.state): r.code for r in encode.dictionary(df, ["a", "b"]).collect()}
    assert book == {("a", s): i for s, i in place[0].items()} | {("b", s): i for s, i in place[1].items()}
    assert encode.dictionary(df.where(F.lit(False)), ["a"]).count() == 0
