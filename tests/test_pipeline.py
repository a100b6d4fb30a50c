"""Whole pipelines on a small known network."""

import os

import pytest
from pyspark.sql import functions as F

from causeway.config import AdvisedConfig, AnswerConfig, ConstraintConfig, FullSearchConfig, RequestSettings, SubsampleConfig
from causeway.functions.hashing import hash_unit
from causeway.operators import advice, metrics, sampling, usage
from causeway.operators.encode import encode_table
from causeway.plans.catalog_learners import _responder
from causeway.plans.advised import AdvisedLearner
from causeway.plans.full_table import advised_constraint_search, structure_from_visits
from causeway.plans.model import LEARNERS, fit
from causeway.plans.subsample import learn_subsampled
from causeway.sources import bif, documents, responses, sweep, tables
from causeway.sources.responses import Advisor

TRUE = {frozenset("ac"), frozenset("bc"), frozenset("cd")}
SMALL = {"num_samples": 8, "num_rows_per_sample": 800, "num_columns_per_sample": 4, "max_parents": 3, "random_seed": 1}


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    u = lambda name: hash_unit(F.col("id"), F.lit(name))
    df = spark.range(6000).select("id", (u("a") < 0.5).alias("a"), (u("b") < 0.5).alias("b"), (u("x") < 0.5).alias("x"))
    df = df.withColumn("c", F.when(u("c") < 0.92, F.col("a") & F.col("b")).otherwise(~(F.col("a") & F.col("b"))))
    df = df.withColumn("d", F.when(u("d") < 0.85, F.col("c")).otherwise(~F.col("c")))
    path = str(tmp_path_factory.mktemp("t") / "t")
    df.write.parquet(path)
    return spark.read.parquet(path)


def pairs(edges):
    return {frozenset(e) for e in edges}


@pytest.mark.parametrize("kind,config", [
    ("ges", FullSearchConfig(max_parents=3)), ("pc", ConstraintConfig(alpha=0.001)),
])
def test_full_table_learners_recover_the_graph(table, kind, config):
    model = fit(kind, table, config, key="id")
    assert pairs(model.network.edges) == TRUE and ("a", "c") in model.network.edges
    assert set(model.nodes) == set("abcdx")


def test_subsample_learner_is_reproducible(spark, table, tmp_path):
    path = str(tmp_path / "cand")
    first = learn_subsampled(table, "id", SubsampleConfig(**SMALL, frequency_cutoff=0.5, save_candidates_path=path)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    again = learn_subsampled(table.repartition(5), "id", SubsampleConfig(**SMALL, frequency_cutoff=0.5)).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    key = lambda rows: sorted((r["parent"], r["child"], r["n"], r["cooc"]) for r in rows)
    assert key(first) == key(again)
    reused = learn_subsampled(table, "id", SubsampleConfig(**SMALL, frequency_cutoff=0.5, candidates_path=path)).collect()
    assert key(reused) == key(first)
    assert pairs([(r["parent"], r["child"]) for r in first]) == TRUE
    assert all(r["n"] <= r["cooc"] for r in first)


def test_advised_learner_uses_the_store(spark, table):
    config = AdvisedConfig(**SMALL, parent_ordering=True, cycle_arbitration=True, adaptive_sampling=True,
                           targeted_samples_per_node=1, min_cooccurrence=1, refinement=True, orphan_repair=True, confounder_review=True)
    settings = RequestSettings(model="m")
    one = Advisor(spark, settings, responder=_responder)
    learner = AdvisedLearner(table, "id", config, one)
    got = learner.fit().collect()
    assert TRUE <= pairs([(r["parent"], r["child"]) for r in got])
    assert {r["stage"] for r in learner.digests().collect()} >= {"baseline", "direction", "cutoff", "greedy", "refinement"}
    two = Advisor(spark, settings, store=one.store, responder=_responder, max_calls=1)
    same = AdvisedLearner(table, "id", config, two).fit().collect()
    assert two.made == 0 and sorted(map(tuple, same)) == sorted(map(tuple, got))
    spent = {r["bucket"]: r["calls"] for r in usage.ledger(two.calls).collect()}
    assert spent and all(b.endswith("_cached") for b in spent)


def test_advised_constraint_search(spark, table):
    advisor = Advisor(spark, RequestSettings(model="m"), responder=_responder)
    found = advised_constraint_search(table, ConstraintConfig(alpha=0.001, borderline=0.0005), advisor, key="id")
    assert pairs(found) == TRUE
    with pytest.raises(advice.CallBudgetExceeded):
        tight = Advisor(spark, RequestSettings(model="m"), responder=_responder, max_calls=1)
        advised_constraint_search(table, ConstraintConfig(alpha=0.001), tight, key="id")


def test_visits_follow_the_answers(spark, table):
    says = {"a": "c, b", "b": "c", "c": "d, a", "d": "", "x": "x"}

    def answer(pdf):
        def reply(op, user):
            return "<Answer>a, q</Answer>" if op == "visit_roots" else f"<Answer>{says[user.split()[3]]}</Answer>"

        return _responder(pdf).assign(content=[reply(o, u) for o, u in zip(pdf["op"], pdf["user"])])

    advisor = Advisor(spark, RequestSettings(model="m"), responder=answer)
    edges = fit("visits", table, AnswerConfig(), "id", advisor).network.edges
    assert set(edges) == {("a", "c"), ("a", "b"), ("b", "c"), ("c", "d")}
    assert advisor.made == 5  # the roots, then a, then c and b, then d


def test_answer_structures(spark, table):
    def answer(pdf):
        doc = '{"nodes": [{"node_name": "c", "parents": ["a", "zz", "c"]}, {"node_name": "a", "parents": ["c"]}]}'
        return _responder(pdf).assign(content=doc)

    advisor = Advisor(spark, RequestSettings(model="m"), responder=answer)
    assert fit("document", table, AnswerConfig(), "id", advisor).network.edges == (("a", "c"),)
    loose = fit("document", table, AnswerConfig(enforce_acyclic=False), "id", advisor)
    assert set(loose.network.edges) == {("a", "c"), ("c", "a")}
    visits = spark.createDataFrame([(0, 0, "a", "<Answer>c, b, q</Answer>"), (0, 1, "c", "<Answer>a, d</Answer>"), (0, 2, "d", "none")],
                                   "run_id int, ord int, visited string, content string")
    nodes = spark.createDataFrame([(n,) for n in "abcd"], "node string")
    got = structure_from_visits("<Answer>b</Answer>", visits, nodes, list("abcd")).collect()
    assert {(r["parent"], r["child"]) for r in got} == {("a", "c"), ("c", "d")}
    with pytest.raises(ValueError):
        structure_from_visits("no roots", visits, nodes, list("abcd"))


def test_registry():
    assert len([k for k in LEARNERS if k.startswith("advised_")]) == 13
    with pytest.raises(ValueError):
        fit("nonsense", None, FullSearchConfig(max_parents=1))


def test_samples(spark, table):
    out = sampling.sample_rows(table, ["id"], 5, 300, seed=9)
    sizes = out.groupBy("sample_id").agg(F.count("*").alias("n"), F.count_distinct("id").alias("d")).collect()
    assert [(r["n"], r["d"]) for r in sizes] == [(300, 300)] * 5
    small = sampling.sample_rows(table.limit(50), ["id"], 3, 300, seed=9).groupBy("sample_id").count().collect()
    assert [r["count"] for r in small] == [50] * 3
    shifted = sampling.sample_rows(table, ["id"], 1, 300, seed=10)
    assert 0 < out.where("sample_id = 1").join(shifted, "id").count() < 300
    with pytest.raises(ValueError):
        sampling.sample_plan(spark, 3, [["a"]])
    plan = sampling.sample_plan(spark, 2, [["c", "zz", "a", "b", "x"], []])
    cols = {r["sample_id"]: r["cols"] for r in sampling.sample_columns(plan, list("abcdx"), 3, 1, forced="forced").collect()}
    assert cols[0] == ["c", "a", "b"] and len(set(cols[1])) == 3
    weighted = sampling.sample_columns_weighted(sampling.sample_plan(spark, 400), list("abcdx"), 2, 1, {"a": {"c"}, "c": {"a"}}, 1000.0)
    both = sum({"a", "c"} == set(r["cols"]) for r in weighted.collect())
    assert both > 120  # about two in five start with a or c and then take the other


def test_split_is_exact(table):
    out = sampling.split_exact(table, ["id"], 0.37, seed=1)
    assert out.where("is_train").count() == 2220
    with pytest.raises(ValueError):
        sampling.split_exact(table, ["id"], 1.0, seed=1)


def test_too_many_states(table):
    with pytest.raises(ValueError):
        encode_table(table, ["id"], max_states=100)
    coded = encode_table(table, ["id"])  # long state list: joined, not inlined
    assert coded.codes.agg(F.count_distinct("id")).first()[0] == 6000


def test_csv_keeps_every_cell(spark, tmp_path):
    path = str(tmp_path / "c.csv")
    with open(path, "w") as f:
        f.write('b,a\n,"NA"\n"",None\nnull,1.0\n')
    got = tables.read_csv(spark, path).collect()
    assert [tuple(r) for r in got] == [("", "NA"), ("", "None"), ("null", "1.0")]
    with pytest.raises(Exception):
        tables.write_csv(spark.range(1), path)


BIF = """network unknown {
}
variable rain { type discrete [ 2 ] { yes, no }; }
variable wet {
  type discrete [ 2 ] { dry, wet };
}
probability ( rain ) { table 0.2, 0.8; }
probability ( wet | rain ) {
  (yes) 0.1, 0.9;
  default 0.7, 0.3;
}
"""


def test_network_files(spark, tmp_path):
    (tmp_path / "w.bif").write_text(BIF)
    nets = bif.read_networks(spark, str(tmp_path))
    assert {(r["node"], tuple(r["states"])) for r in bif.network_nodes(nets).collect()} == {("rain", ("yes", "no")), ("wet", ("dry", "wet"))}
    assert [(r["parent"], r["child"]) for r in bif.network_edges(nets).collect()] == [("rain", "wet")]
    cpt = {(r["node"], tuple(r["cfg"]) if r["cfg"] is not None else None, r["state"]): r["p"] for r in bif.network_cpt(nets).collect()}
    assert cpt["rain", (), "no"] == 0.8 and cpt["wet", ("yes",), "wet"] == 0.9 and cpt["wet", None, "dry"] == 0.7
    net = bif.load_network(nets, "w.bif")
    assert net.edges == (("rain", "wet"),) and net.states["rain"] == ["no", "yes"]


def test_store_rules(spark, tmp_path):
    path = str(tmp_path / "store")
    assert responses.read_store(spark, path).isEmpty()
    row = {"prompt_tokens": 1, "cached_prompt_tokens": 0, "completion_tokens": 1, "total_tokens": 2}
    first = spark.createDataFrame([("k", "old", False, row), ("t", "cut", True, row)], advice.ANSWER)
    responses.append_store(first, path, 1)
    responses.append_store(first.withColumn("content", F.lit("new")), path, 2)
    assert [(r["key"], r["content"]) for r in responses.read_store(spark, path).collect()] == [("k", "new")]


def test_sweeps_and_documents(spark, tmp_path):
    (tmp_path / "s.json").write_text(
        '{"name": "s", "defaults": {"models": ["ges", "nope"], "k": "1"}, "datasets": [{"name": "d"}]}')
    with pytest.raises(Exception, match="unknown model"):
        sweep.expand(sweep.read_sweeps(spark, str(tmp_path / "s.json")), LEARNERS).collect()
    kept = sweep.expand(sweep.read_sweeps(spark, str(tmp_path / "s.json")), ["ges", "nope"]).collect()
    assert [(r["model"], r["trial"], r["settings"]["k"]) for r in kept] == [("ges", 0, "1"), ("nope", 0, "1")]
    leaves = dict(documents.numeric_leaves({"a": {"b": 1, "ok": True, "s": "x"}, "l": [{"v": 2.5}, None]}))
    assert leaves == {"a.b": 1.0, "l[0].v": 2.5}
    (tmp_path / "q.json").write_text('[\n{"target_node": "a", "context": {"b": "1"}, "ground_truth_prediction": "x", "synthetic_data_value": "y"}\n]')
    assert documents.read_questions(spark, str(tmp_path / "q.json"), array=True).first()["context"] == {"b": "1"}


def test_metric_rules(spark):
    single = spark.createDataFrame([("a", "a"), ("a", "b")], "truth string, pred string")
    row = metrics.classification_metrics(single).first()
    assert row["accuracy"] == 0.5 and row["precision"] is None and row["note"] and row["n_classes"] == 2
    never = spark.createDataFrame([("a", "a"), ("b", "a")], "truth string, pred string")
    row = metrics.classification_metrics(never).first()
    assert (row["precision"], row["recall"], row["f1"]) == (0.0, 0.0, 0.0)
    macro = spark.createDataFrame([("a", "a"), ("b", "c"), ("b", "b")], "truth string, pred string")
    row = metrics.classification_metrics(macro).first()
    assert row["precision"] == pytest.approx(2 / 3) and row["recall"] == pytest.approx(0.5)
    trials = spark.createDataFrame([("m", 0, 1.0), ("m", 1, 3.0), ("s", 0, 5.0)], "path string, trial int, value double")
    got = {r["path"]: r for r in metrics.across_trials(trials).collect()}
    assert got["m"]["ci_95_high"] == pytest.approx(2 + 12.706204736 * 2**0.5 / 2**0.5)
    assert (got["s"]["std"], got["s"]["ci_95_low"], got["s"]["n_trials"]) == (0.0, 5.0, 1)
    empty = spark.createDataFrame([(0, [], [])], "i int, a array<string>, b array<string>")
    assert empty.select(metrics.jaccard(F.col("a"), F.col("b"))).first()[0] is None


def test_price_tiers_and_dated_names(spark):
    rows = [("gpt-5.4-2026-03-05", n, 0, 0) for n in (272_000, 272_001)] + [("gpt-5.4", 10, 20, 1), ("other", 1, 0, 0)]
    calls = spark.createDataFrame(rows, "model string, prompt_tokens bigint, cached_prompt_tokens bigint, completion_tokens bigint")
    got = [r["cost"] for r in usage.price_calls(calls).orderBy(F.desc("prompt_tokens")).collect()]
    assert got[0] == pytest.approx(272_001 * 5e-6) and got[1] == pytest.approx(272_000 * 2.5e-6)
    assert got[2] == pytest.approx((20 * 0.25 + 15) / 1e6) and got[3] is None


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    from causeway import session

    class Fake:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})()
        sparkContext = type("S", (), {"master": "spark://host:7077"})()

    with pytest.raises(RuntimeError):
        session.shared_dir(Fake())
    assert session.shared_dir(spark)
    monkeypatch.setattr(session, "CHECKPOINT_CONF", "spark.causeway.unset")
    own = session.shared_dir(spark)
    assert os.path.isabs(own) and own == session.shared_dir(spark)
    assert session.durable(spark.range(3)).count() == 3
