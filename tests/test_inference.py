"""Posteriors against brute force over the full joint of a small network."""

from itertools import product

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from causeway.config import ModelConfig
from causeway.operators import generate, inference
from causeway.plans.model import Model
from causeway.plans.network import Network, ParametersNotFitted, fit_blankets, fit_global, topological

NODES = ["a", "b", "c", "d", "e"]
EDGES = [("a", "c"), ("b", "c"), ("c", "d"), ("b", "e")]
STATES = {"a": ["0", "1"], "b": ["0", "1", "2"], "c": ["0", "1"], "d": ["0", "1"], "e": ["0", "1"]}


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    n = 400
    a, b = rng.integers(0, 2, n), rng.integers(0, 3, n)
    c = np.where(rng.random(n) < 0.85, (a + b) % 2, rng.integers(0, 2, n))
    c = np.where((a == 1) & (b == 2), 1, c)
    d = np.where(rng.random(n) < 0.8, c, 1 - c)
    e = np.where(rng.random(n) < 0.7, b % 2, 1 - b % 2)
    keep = ~((a == 0) & (b == 2))  # a parent configuration that never occurs
    return pd.DataFrame({"a": a, "b": b, "c": c, "d": d, "e": e})[keep].astype(str)


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows.assign(id=range(len(rows))))


@pytest.fixture(scope="module")
def net(table):
    return fit_global(table, NODES, EDGES)


@pytest.fixture(scope="module")
def local(table):
    return fit_blankets(table, NODES, EDGES)


def joint(rows, edges=EDGES, nodes=NODES):
    parents = {n: [p for p, c in edges if c == n] for n in nodes}

    def prob(x, n):
        same = rows
        for p in parents[n]:
            same = same[same[p] == x[p]]
        if not len(same):
            return 1 / len(STATES[n])
        return (same[n] == x[n]).mean()

    out = {}
    for combo in product(*[STATES[n] for n in nodes]):
        x = dict(zip(nodes, combo))
        out[combo] = np.prod([prob(x, n) for n in nodes])
    return out


def brute(table, target, ev, nodes=NODES):
    w = {s: 0.0 for s in STATES[target]}
    for combo, p in table.items():
        x = dict(zip(nodes, combo))
        if all(x[k] == v for k, v in ev.items()):
            w[x[target]] += p
    total = sum(w.values())
    return {s: v / total for s, v in w.items()}


def ask(spark, network, cases):
    df = spark.createDataFrame([(i, t, ev) for i, (t, ev) in enumerate(cases)], "query_id int, target string, context map<string,string>")
    got = {r["query_id"]: r["dist"] for r in inference.posterior(df, network).collect()}
    assert len(got) == len(cases)
    return [got[i] for i in range(len(cases))]


def test_posterior_equals_brute_force(spark, rows, net):
    full = joint(rows)
    cases = [("c", {}), ("a", {"d": "1"}), ("b", {"c": "0", "e": "1"}), ("d", {"a": "1"}), ("d", {"a": "0", "b": "2"}),
             ("e", {"d": "0"}), ("a", {"b": "1"}), ("a", {"b": "1", "c": "1", "zzz": "q"}), ("a", {"b": "1"})]
    for (target, ev), dist in zip(cases, ask(spark, net, cases)):
        want = brute(full, target, {k: v for k, v in ev.items() if k in NODES})
        assert dist.keys() == want.keys() and sum(dist.values()) == pytest.approx(1)
        assert all(dist[s] == pytest.approx(want[s], abs=1e-9) for s in want)


def test_unanswerable_queries_give_null(spark, net):
    unknown, unseen, gap = ask(spark, net, [("nobody", {}), ("a", {"b": "9"}), ("c", {"a": None})])
    assert unknown is None and unseen is None and gap is not None


def test_blanket_answers(spark, rows, net, local):
    complete = {"a": "1", "b": "1", "d": "0", "e": "1"}
    both = [ask(spark, n, [("c", complete)])[0] for n in (net, local)]
    assert both[0] == pytest.approx(both[1])
    # e's blanket is {b, e}: distant evidence is ignored
    far, bare = ask(spark, local, [("e", {"d": "1"}), ("e", {})])
    assert far == pytest.approx(bare)
    assert local.members("a") == {"a", "b", "c"} and local.members("e") == {"b", "e"}


def test_predict_table_with_and_without_gaps(spark, rows, table, net):
    full = joint(rows)
    some = table.limit(3).withColumn("id", F.col("id").cast("int"))
    gap = some.withColumn("b", F.lit(None).cast("string")).withColumn("id", F.col("id") + 10_000)
    out = inference.predict_table(some.unionByName(gap), ["id"], net).collect()
    assert len(out) == 6 * 5
    data = {r["id"]: r.asDict() for r in some.unionByName(gap).collect()}
    for r in out:
        row = data[r["id"]]
        ev = {n: row[n] for n in NODES if n != r["node"] and row[n] is not None}
        want = brute(full, r["node"], ev)
        assert r["joint"] == pytest.approx(want, abs=1e-9) and r["label"] == row[r["node"]]
        assert r["prior"] == pytest.approx(brute(full, r["node"], {}), abs=1e-9)


def test_map_state_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([({"b": 0.4, "a": 0.4, "c": 0.2},)], "dist map<string,double>")
    assert df.select(inference.map_state(F.col("dist")).alias("s")).first()["s"] == "a"


def test_propagation(spark, local):
    model = Model("subsample", ModelConfig(backend="blanket"), local)
    df = spark.createDataFrame(
        [(0, "d", {"a": "1"}), (1, "d", {"c": "1"}), (2, "e", {"a": "1"}), (3, "nobody", {}), (4, "a", {"e": "1", "d": "1"})],
        "query_id int, target string, context map<string,string>")
    got = {r["query_id"]: r["dist"] for r in model.predict_propagated(df, draws=30).collect()}
    plain = {r["query_id"]: r["dist"] for r in model.predict(df).collect()}
    assert got[3] is None and got[1] == pytest.approx(plain[1])
    assert all(sum(got[i].values()) == pytest.approx(1) for i in (0, 1, 2, 4))
    assert got[2] == pytest.approx(plain[2])  # a - c - b - e is blocked at the unobserved collider


def test_lifecycle_errors_and_storage(spark, tmp_path, net, local, table):
    bare = Model("ges", ModelConfig(), Network(tuple(NODES), tuple(EDGES)))
    df = spark.createDataFrame([(0, "d", {"c": "1"})], "query_id int, target string, context map<string,string>")
    with pytest.raises(ParametersNotFitted):
        bare.predict(df)
    with pytest.raises(TypeError):
        Model("ges", ModelConfig(), net).predict_propagated(df)
    path = str(tmp_path / "m")
    Model("ges", ModelConfig(backend="blanket"), local).save(spark, path)
    with pytest.raises(TypeError):
        Model.load(spark, path, "pc", ModelConfig())
    back = Model.load(spark, path, "ges", ModelConfig(backend="blanket"))
    assert back.predict(df).first()["dist"] == pytest.approx(ask(spark, local, [("d", {"c": "1"})])[0])
    assert back.supports_propagation


def test_forward_sample_and_questions(spark, net, table):
    ids = spark.range(4000)
    drawn = generate.forward_sample(net, ids, seed=1)
    rate = drawn.agg(F.avg((F.col("c") == F.col("d")).cast("int"))).first()[0]
    want = table.agg(F.avg((F.col("c") == F.col("d")).cast("int"))).first()[0]
    assert abs(rate - want) < 0.04
    assert drawn.exceptAll(generate.forward_sample(net, ids.repartition(3), seed=1)).isEmpty()
    asked = generate.random_questions(net, table, "id", 50, seed=2)
    rows = asked.collect()
    assert len(rows) == 50 and len({r["target_node"] for r in rows}) > 2
    assert all(r["target_node"] not in r["context"] for r in rows)
    assert {len(r["context"]) for r in rows} >= {0, 4}


def test_topological_rejects_cycles():
    with pytest.raises(ValueError):
        topological(["a", "b"], {"a": ["b"], "b": ["a"]})


def test_many_equal_queries_are_not_broadcast(spark, local):
    # 50,000 queries of two cases: their file is smaller than the estimate of the answers
    asked = spark.range(50_000).select(
        F.col("id").cast("string").alias("query_id"), F.lit("c").alias("target"),
        F.create_map(F.lit("a"), (F.col("id") % 2).cast("string")).alias("context"))
    answers = inference.posterior(asked, local)
    known = answers.where(F.col("dist").isNotNull()).select("query_id", "target", "dist")
    plan = known._jdf.queryExecution().executedPlan().toString()
    outer = next(x for x in plan.split("\n") if "Join" in x and "ev_key" in x)
    assert "BuildLeft" not in outer
    assert known.count() == 50_000 and known.select(F.to_json("dist")).distinct().count() == 2
