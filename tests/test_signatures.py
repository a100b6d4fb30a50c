"""Whole-table prediction by signatures: groups, lookups with and without broadcast, odd tables."""

import pytest
from pyspark.sql import functions as F

from causeway.operators import inference, signatures
from causeway.operators.signatures import Group
from causeway.plans.network import fit_blankets, fit_global

NODES = ["a", "b", "c", "d", "e"]
EDGES = [("a", "c"), ("b", "c"), ("c", "d"), ("b", "e")]
DATA = [("0", "0", "0", "0", "0"), ("0", "1", "1", "1", "1"), ("1", "0", "1", "1", "0"), ("1", "1", "0", "0", "1"),
        ("1", "2", "1", "0", "0"), ("0", "1", "1", "0", "1"), ("0", "1", "0", "1", "1"), ("1", "0", "1", "0", "1")]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(DATA * 3)], ["id", *NODES])


@pytest.fixture(scope="module", params=[fit_global, fit_blankets])
def net(table, request):
    return request.param(table, NODES, EDGES)


def plain(spark, rows, net):
    """The same questions asked one by one of the general elimination."""
    asked = [((i, n), n, {v: x for v, x in zip(NODES, r) if v != n and x is not None}) for i, r in rows for n in NODES]
    frame = spark.createDataFrame([(f"{i}/{n}", t, ev) for (i, n), t, ev in asked], "query_id string, target string, context map<string,string>")
    return {r.query_id: r.dist for r in inference.posterior(frame, net).collect()}


def test_groups(net):
    # a's tables (c's among them) lie inside b's, d's inside c's
    assert signatures.node_groups(net) == [
        Group(("a", "b", "c", "e"), ("b", "a", "e")), Group(("a", "b", "c", "d"), ("c", "d"))]


@pytest.fixture(scope="module")
def want(spark, net):
    return plain(spark, list(enumerate(DATA)), net)


@pytest.mark.parametrize("cells, hot", [(2_000_000, 1000), (0, 4), (0, 1)])
def test_equal_to_single_questions(table, net, want, monkeypatch, cells, hot):
    monkeypatch.setattr(signatures, "BROADCAST_CELLS", cells)
    monkeypatch.setattr(signatures, "HOT", hot)
    out = inference.predict_table(table, ["id"], net).collect()
    assert len(out) == len(DATA) * 3 * 5
    for r in out:
        k = r.id % len(DATA)
        assert r.joint == pytest.approx(want[f"{k}/{r.node}"], abs=1e-12) and r.label == DATA[k][NODES.index(r.node)]


def test_odd_rows(spark, table, net):
    odd = [(1, "0", "1", None, "1", "1"), (1, "0", "1", None, "1", "1"), (2, None, None, None, None, None), (3, "9", "1", "1", "0", "1")]
    rows = spark.createDataFrame(odd, "id int, a string, b string, c string, d string, e string")
    rows = rows.withColumns({"node": F.lit("x"), "values": F.lit(1), "label": F.lit("y"), "signature": F.lit(2)})
    out = inference.predict_table(rows, ["id"], net).collect()
    assert len(out) == 20 and out[0].__fields__ == ["id", "node", "prior", "joint", "label"]
    got = {(r.id, r.node): r for r in out}
    want = plain(spark, [(1, odd[0][1:]), (2, odd[2][1:])], net)
    for key, r in got.items():
        if key[0] < 3:
            assert r.joint == pytest.approx(want[f"{key[0]}/{key[1]}"], abs=1e-12)
        assert r.prior.keys() == {x[NODES.index(r.node)] for x in DATA}
    # a state that training never saw leaves its table's term out
    assert got[3, "a"].label == "9" and sum(got[3, "c"].joint.values()) == pytest.approx(1)
    assert inference.predict_table(rows.limit(0), ["id"], net).count() == 0


def test_lookup_shuffles_do_not_grow_with_children(spark, table, tmp_path):
    table.write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    few = fit_global(rows, NODES, [("a", "b")])
    many = fit_global(rows, NODES, [("a", c) for c in "bcde"])
    plans = [inference.predict_table(rows, ["id"], n)._jdf.queryExecution().executedPlan().toString() for n in (few, many)]
    assert [p.count("Exchange hashpartitioning") for p in plans] == [0, 0]
