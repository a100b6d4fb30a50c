import pytest
from pyspark.sql import functions as F

from causeway.operators import assemble, votes

LOG = [
    (0, 0, "a", "b"), (0, 1, "c", "b"), (1, 0, "b", "a"), (1, 1, "a", "d"),
    (2, 0, "a", "d"), (2, 1, "d", "a"), (3, 0, "c", "d"),
]
PLAN = [(0, ["a", "b", "c"]), (1, ["a", "b", "d"]), (2, ["a", "d", "b"]), (3, ["a", "b"])]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(LOG, "sample_id int, edge_ord int, parent string, child string")


@pytest.fixture(scope="module")
def cooc(spark):
    return votes.cooccurrence(spark.createDataFrame(PLAN, "sample_id int, cols array<string>"), ["a", "b", "c", "d"])


def edges(df):
    return {(r["parent"], r["child"]) for r in df.collect()}


def test_counts_stay_below_cooccurrence_and_are_symmetric(log, cooc):
    pairs = {(r["a"], r["b"]): r["n"] for r in cooc.collect()}
    assert all(pairs[b, a] == n for (a, b), n in pairs.items())
    assert pairs["a", "b"] == 4 and ("c", "d") not in pairs


def test_tie_goes_to_the_child_that_appeared_later(log):
    kept = edges(votes.resolve_direction(votes.vote_counts(log)))
    # a-b is tied; b appeared as a child before a did, so b -> a survives
    assert ("b", "a") in kept and ("a", "b") not in kept
    assert ("a", "d") in kept and ("d", "a") not in kept
    bare = votes.resolve_direction(votes.vote_counts(log).drop("first_child"))
    assert ("a", "b") in edges(bare)


def test_direction_is_idempotent(log):
    once = votes.resolve_direction(votes.vote_counts(log))
    assert edges(once) == edges(votes.resolve_direction(once))


def test_cutoff(log, cooc):
    counted = votes.vote_counts(log)
    assert edges(votes.frequency_cutoff(counted, cooc, 0.0)) == edges(counted)
    kept = edges(votes.frequency_cutoff(counted, cooc, 0.5))
    assert ("c", "d") not in kept  # never co-sampled
    assert ("a", "b") not in kept and ("a", "d") in kept and ("c", "b") in kept


def test_node_order_counts_parents(spark, log):
    nodes = spark.createDataFrame([(n,) for n in "abcde"], "node string")
    order = votes.node_order(votes.parent_appearance(votes.vote_counts(log), nodes)).orderBy("position").collect()
    assert [(r["node"], r["total"]) for r in order] == [("a", 3), ("c", 2), ("b", 1), ("d", 1), ("e", 0)]


def ranked(spark, rows):
    return spark.createDataFrame(rows, "run_id int, position int, child string, rank int, parent string")


def test_assembly_counts_only_placed_edges(spark):
    rows = [(0, 1, "b", 1, "a"), (0, 2, "a", 1, "b"), (0, 2, "a", 2, "c"), (0, 2, "a", 3, "d"), (0, 2, "a", 4, "e")]
    got = edges(assemble.assemble(ranked(spark, rows), 2))
    assert got == {("a", "b"), ("c", "a"), ("d", "a")}


def test_runs_are_independent(spark):
    rows = [(r, 1, "b", 1, "a") for r in range(5)] + [(r, 2, "a", 1, "b") for r in range(5)]
    out = assemble.assemble(ranked(spark, rows), 3).groupBy("run_id").count().collect()
    assert sorted((r["run_id"], r["count"]) for r in out) == [(r, 1) for r in range(5)]


ADVICE = "run_id int, new_parent string, new_child string, drops array<struct<parent: string, child: string>>"
LOOP = [(0, 1, "b", 1, "a"), (0, 2, "c", 1, "b"), (0, 3, "a", 1, "c"), (0, 4, "d", 1, "a")]


def test_arbitration_replaces_reverts_and_reports(spark):
    data = ranked(spark, LOOP)
    none = spark.createDataFrame([], ADVICE)
    assert edges(assemble.assemble_advised(data, none, 3)) == {("a", "b"), ("b", "c"), ("a", "d")}
    open_ = assemble.assemble_advised(data, none, 3, conflicts=True).collect()
    assert [(r["parent"], r["child"], [tuple(e) for e in r["edges"]]) for r in open_] == [("c", "a", [("a", "b"), ("b", "c")])]
    good = spark.createDataFrame([(0, "c", "a", [("a", "b")])], ADVICE)
    assert edges(assemble.assemble_advised(data, good, 3)) == {("b", "c"), ("c", "a"), ("a", "d")}
    bad = spark.createDataFrame([(0, "c", "a", [("a", "d")])], ADVICE)
    assert edges(assemble.assemble_advised(data, bad, 3)) == {("a", "b"), ("b", "c"), ("a", "d")}


def test_failed_removal_is_restored(spark):
    rows = LOOP[:2] + [(0, 2, "c", 2, "a"), (0, 3, "a", 1, "c")]
    half = spark.createDataFrame([(0, "c", "a", [("a", "b")])], ADVICE)
    assert edges(assemble.assemble_advised(ranked(spark, rows), half, 3)) == {("a", "b"), ("b", "c"), ("a", "c")}


def test_blocking_edges_are_complete():
    wide = assemble.EdgeList([("s", f"m{i}") for i in range(20)] + [(f"m{i}", "t") for i in range(20)] + [("s", "x"), ("y", "t")])
    assert len(wide.between("s", "t")) == 40 and wide.between("t", "s") == []
    assert wide.reaches("x", "x")


EDGE = "run_id int, edge_ord int, parent string, child string"


def test_refinement_guards(spark):
    have = spark.createDataFrame([(0, 0, "a", "b"), (0, 1, "b", "c"), (0, 2, "d", "e")], EDGE)
    todo = spark.createDataFrame([
        (0, 0, "add", "c", "a"), (0, 1, "delete", "d", "e"), (0, 2, "add", "a", "b"), (0, 3, "add", "x", "a"),
        (0, 4, "add", "a", "c"), (0, 5, "delete", "a", "b"), (0, 6, "terminate", "", ""), (0, 7, "add", "a", "e"),
    ], "run_id int, ord int, action string, parent string, child string")
    got = edges(assemble.refine(have, todo, list("abcde")))
    assert got == {("b", "c"), ("d", "e"), ("a", "c")}


def test_confounders_and_orphans(spark):
    have = spark.createDataFrame([(0, 0, "a", "b"), (0, 1, "c", "b"), (0, 2, "d", "e")], EDGE)
    nodes = spark.createDataFrame([(n,) for n in "abcde"], "node string")
    flags = spark.createDataFrame([
        (0, 0, "a", "b", "c"), (0, 0, "c", "b", "nobody"), (0, 1, "d", "e", "a"), (0, 2, "a", "e", "c"), (0, 3, "c", "b", "c"),
    ], "run_id int, ord int, parent string, child string, confounder string")
    valid = assemble.valid_confounders(flags, have, nodes)
    assert edges(valid) == {("a", "b"), ("d", "e")}
    # dropping either edge would leave one of its ends bare
    assert edges(assemble.drop_confounded(have, valid)) == {("a", "b"), ("c", "b"), ("d", "e")}
    offers = spark.createDataFrame([
        (0, 0, "b", "a"), (0, 1, "d", "a"), (0, 2, "e", "a"), (0, 3, "c", "a"), (0, 0, "a", "b"), (0, 0, "x", "c"),
    ], "run_id int, ord int, parent string, child string")
    got = edges(assemble.adopt_orphans(have, offers, 2, list("abcde")))
    assert got == edges(have) | {("d", "a"), ("e", "a")}  # b would close a cycle and takes no place


def test_advice_order_bypasses_the_cutoff(spark, cooc, log):
    resolved = votes.resolve_direction(votes.vote_counts(log))
    advice = spark.createDataFrame([("d", ["c", "a", "c"])], "child string, names array<string>")
    fallback = votes.rank_parents(votes.frequency_cutoff(resolved, cooc, 0.9))
    got = votes.advice_order(resolved, advice, cooc, 0.9, fallback).where(F.col("child") == "d").orderBy("rank")
    assert [(r["parent"], r["endorsed"]) for r in got.collect()] == [("c", True), ("a", True)]
