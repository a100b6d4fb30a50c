"""Queries on evaluation: graphs, classifications, trials and costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.functions.mathx import t_quantile
from causeway.operators import graph, metrics, usage
from causeway.plans import report, trade
from causeway.plans import workloads as w
from causeway.plans.catalog_inference import EDGES, NODES
from causeway.plans.model import Model
from causeway.config import ModelConfig
from causeway.operators.generate import random_questions
from causeway.plans.network import fit_blankets, fit_global
from causeway.plans.registry import query
from causeway.session import durable

SPLIT = trade.SPLIT
TWO = f"""WITH {trade.LINES_SQL}, {trade.votes_sql('_e', f'sample_id < {SPLIT}')}, {trade.graph_sql('learned', tag='_e')},
{trade.votes_sql('_l', f'sample_id >= {SPLIT}')}, {trade.graph_sql('truth', tag='_l')}"""
REL = f"""{TWO}, rel AS (SELECT a.n_name AS a, b.n_name AS b,
  CASE WHEN EXISTS (SELECT 1 FROM truth t WHERE t.parent = a.n_name AND t.child = b.n_name) THEN 'A->B'
       WHEN EXISTS (SELECT 1 FROM truth t WHERE t.parent = b.n_name AND t.child = a.n_name) THEN 'B->A' ELSE 'none' END AS truth,
  CASE WHEN EXISTS (SELECT 1 FROM learned t WHERE t.parent = a.n_name AND t.child = b.n_name) THEN 'A->B'
       WHEN EXISTS (SELECT 1 FROM learned t WHERE t.parent = b.n_name AND t.child = a.n_name) THEN 'B->A' ELSE 'none' END AS pred
  FROM nation a JOIN nation b ON a.n_name < b.n_name)"""
LAB = """lab AS (SELECT unnest(['A->B', 'B->A', 'none']) AS label),
s AS (SELECT label, count(*) FILTER (truth = label AND pred = label) AS tp,
  count(*) FILTER (truth <> label AND pred = label) AS fp,
  count(*) FILTER (truth = label AND pred <> label) AS fn FROM lab, rel GROUP BY label),
sc AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p, coalesce(tp / nullif(tp + fn, 0), 0) AS r,
  coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f FROM s)"""


def _two(spark, sf):
    return durable(trade.graph(spark, sf, part="early")), durable(trade.graph(spark, sf, part="late"))


@query("pair_relations", f"""{REL}, grid AS (SELECT t.x AS truth, p.x AS pred FROM (SELECT unnest(['A->B', 'B->A', 'none']) AS x) t
CROSS JOIN (SELECT unnest(['A->B', 'B->A', 'none']) AS x) p)
SELECT truth, pred, count(rel.a) AS n FROM grid LEFT JOIN rel USING (truth, pred) GROUP BY truth, pred""")
def pair_relations(spark, sf):
    """How node pairs relate in both graphs; pairs without any edge are counted, not listed."""
    learned, truth = _two(spark, sf)
    return metrics.relation_counts(truth, learned, trade.node_frame(spark, sf))


@query("edge_sets", f"""{TWO}, u AS (SELECT least(parent, child) AS a, greatest(parent, child) AS b, 'l' AS g FROM learned
  UNION ALL SELECT least(parent, child), greatest(parent, child), 't' FROM truth)
SELECT 'correct' AS kind, parent, child FROM learned INTERSECT SELECT 'correct', parent, child FROM truth
UNION ALL SELECT 'reversed', l.parent, l.child FROM learned l JOIN truth t ON l.parent = t.child AND l.child = t.parent
  WHERE NOT EXISTS (SELECT 1 FROM truth x WHERE x.parent = l.parent AND x.child = l.child)
UNION ALL SELECT 'incorrect', parent, child FROM learned WHERE (least(parent, child), greatest(parent, child)) NOT IN (SELECT (a, b) FROM u WHERE g = 't')
UNION ALL SELECT 'missing', parent, child FROM truth WHERE (least(parent, child), greatest(parent, child)) NOT IN (SELECT (a, b) FROM u WHERE g = 'l')""")
def edge_sets(spark, sf):
    learned, truth = _two(spark, sf)
    parts = [("correct", metrics.correct_edges(learned, truth)), ("reversed", metrics.reversed_edges(learned, truth)),
             ("incorrect", metrics.unmatched_edges(learned, truth)), ("missing", metrics.unmatched_edges(truth, learned))]
    frames = [df.select(F.lit(k).alias("kind"), "parent", "child") for k, df in parts]
    return frames[0].union(frames[1]).union(frames[2]).union(frames[3])


@query("edge_bag", f"""{TWO}, bag AS (SELECT * FROM learned UNION ALL SELECT * FROM truth)
SELECT parent, child, count(*) AS n FROM bag GROUP BY ALL""")
def edge_bag(spark, sf):
    """Bag union of both edge lists; shared edges count twice."""
    learned, truth = _two(spark, sf)
    return learned.unionAll(truth).groupBy("parent", "child").agg(F.count("*").alias("n"))


@query("node_union", f"{TWO} SELECT parent AS node FROM learned UNION SELECT child FROM learned UNION SELECT parent FROM truth UNION SELECT child FROM truth")
def node_union(spark, sf):
    ends = [g.select(F.explode(F.array("parent", "child")).alias("node")) for g in _two(spark, sf)]
    return metrics.union_nodes(*ends)


@query("structure_report", f"""{REL}, {LAB}, e AS (SELECT
  (SELECT count(*) FROM learned) AS nl, (SELECT count(*) FROM truth) AS nt,
  (SELECT count(*) FROM learned JOIN truth USING (parent, child)) AS hit,
  (SELECT count(*) FROM learned l JOIN truth t ON l.parent = t.child AND l.child = t.parent) AS rev,
  (SELECT count(*) FROM rel WHERE truth <> 'none' AND pred <> 'none') AS shared,
  (SELECT count(*) FROM rel WHERE pred <> 'none') AS lp, (SELECT count(*) FROM rel WHERE truth <> 'none') AS tp)
SELECT round((SELECT avg(CASE WHEN truth <> pred THEN 1.0 ELSE 0.0 END) FROM rel), 9) AS normalized_hamming_distance,
  round((SELECT avg(f) FROM sc), 9) AS causality_f1_macro, round((SELECT avg(p) FROM sc), 9) AS causality_precision_macro,
  round((SELECT avg(r) FROM sc), 9) AS causality_recall_macro,
  round(coalesce(hit / nullif(nl, 0), 0), 9) AS directed_edge_precision, round(coalesce(hit / nullif(nt, 0), 0), 9) AS directed_edge_recall,
  round(coalesce(2 * (hit / nullif(nl, 0)) * (hit / nullif(nt, 0)) / nullif(hit / nullif(nl, 0) + hit / nullif(nt, 0), 0), 0), 9) AS directed_edge_f1,
  lp - shared AS num_incorrect_edges, tp - shared AS num_missing_edges, rev AS num_reversed_edges,
  nt AS num_gt_edges, nl AS num_learned_edges, (SELECT count(*) FROM nation) AS num_nodes,
  (SELECT count(*) FROM rel) AS num_pairs FROM e""")
def structure_report(spark, sf):
    """The graph of the early days judged by that of the late days."""
    learned, truth = _two(spark, sf)
    nodes = trade.node_frame(spark, sf)
    out = metrics.structure_report(learned, nodes, truth, nodes)
    rounded = [c for c in out.columns if not c.startswith("num_")]
    return out.select(*[F.round(c, 9).alias(c) if c in rounded else F.col(c) for c in out.columns])


MB = "(SELECT n_name AS c, n_name AS m FROM nation UNION SELECT child, parent FROM {g} UNION SELECT parent, child FROM {g} " \
     "UNION SELECT a.parent, b.parent FROM {g} a JOIN {g} b ON a.child = b.child AND a.parent <> b.parent)"


@query("blanket_jaccard", f"""{TWO}, l AS {MB.format(g='learned')}, t AS {MB.format(g='truth')},
per AS (SELECT n_name AS c, (SELECT count(*) FROM l JOIN t USING (c, m) WHERE l.c = n_name) AS inter,
  (SELECT count(*) FROM (SELECT m FROM l WHERE l.c = n_name UNION SELECT m FROM t WHERE t.c = n_name)) AS uni FROM nation)
SELECT round(avg(inter / uni), 9) AS mb_jaccard FROM per""")
def blanket_jaccard(spark, sf):
    nodes = trade.node_frame(spark, sf)
    learned, truth = (graph.markov_blankets(g, nodes) for g in _two(spark, sf))
    return metrics.mean_blanket_jaccard(learned, truth).select(F.round("mb_jaccard", 9).alias("mb_jaccard"))


@query("list_jaccard", """WITH t AS (SELECT l_suppkey, list(DISTINCT p_type) FILTER (l_returnflag = 'R') AS r,
  list(DISTINCT p_type) FILTER (l_returnflag = 'A') AS a FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey)
SELECT l_suppkey, round(len(list_intersect(coalesce(r, []), coalesce(a, []))) /
  nullif(len(list_distinct(list_concat(coalesce(r, []), coalesce(a, [])))), 0), 9) AS jaccard FROM t""")
def list_jaccard(spark, sf):
    """Per supplier: part types returned against part types accepted."""
    lines = w.table(spark, sf, "lineitem").join(w.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    sets = lines.groupBy("l_suppkey").agg(
        F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("p_type"))).alias("r"),
        F.collect_set(F.when(F.col("l_returnflag") == "A", F.col("p_type"))).alias("a"),
    )
    return sets.select("l_suppkey", F.round(metrics.jaccard(F.col("r"), F.col("a")), 9).alias("jaccard"))


PAIRS = """pairs AS (SELECT CAST(quality AS VARCHAR) AS truth, CASE WHEN n_chars > 400 THEN '1' ELSE '0' END AS pred,
  CAST(toxic AS VARCHAR) AS observed, lang, source, doc_id FROM labels JOIN documents USING (doc_id))"""


def _label_pairs(spark, sf):
    docs = w.table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    return w.table(spark, sf, "labels").join(docs, "doc_id").select(
        "doc_id", "lang", "source", F.col("quality").cast("string").alias("truth"),
        F.when(F.col("n_chars") > 400, "1").otherwise("0").alias("pred"), F.col("toxic").cast("string").alias("observed"),
    )


BINARY = """SELECT {k} count(*) AS n_samples, len(list_distinct(list_concat(list(truth), list(pred)))) AS n_classes,
  avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END) AS accuracy, count(DISTINCT truth) AS tc,
  count(*) FILTER (truth = pos AND pred = pos) AS tp, count(*) FILTER (truth <> pos AND pred = pos) AS fp,
  count(*) FILTER (truth = pos AND pred <> pos) AS fn FROM (SELECT *, '1' AS pos FROM {t}) {g}"""
FINISH = """SELECT {k} n_samples, n_classes, round(accuracy, 9) AS accuracy,
  CASE WHEN tc > 1 THEN round(coalesce(tp / nullif(tp + fp, 0), 0), 9) END AS "precision",
  CASE WHEN tc > 1 THEN round(coalesce(tp / nullif(tp + fn, 0), 0), 9) END AS recall,
  CASE WHEN tc > 1 THEN round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) END AS f1,
  CASE WHEN tc < 2 THEN 'Only one class present in true labels' END AS note FROM b"""


def _rounded(df):
    out = df
    for c in ("accuracy", "precision", "recall", "f1"):
        out = out.withColumn(c, F.round(c, 9))
    return out


@query("binary_classification", f"WITH {PAIRS}, b AS ({BINARY.format(k='', t='pairs', g='')}) {FINISH.format(k='')}")
def binary_classification(spark, sf):
    return _rounded(metrics.classification_metrics(_label_pairs(spark, sf)))


@query("macro_classification", """WITH t AS (SELECT sn.r_name AS truth, cn.r_name AS pred FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation a ON s_nationkey = a.n_nationkey JOIN region sn ON a.n_regionkey = sn.r_regionkey
  JOIN nation c ON c_nationkey = c.n_nationkey JOIN region cn ON c.n_regionkey = cn.r_regionkey),
lab AS (SELECT truth AS label FROM t UNION SELECT pred FROM t),
s AS (SELECT label, count(*) FILTER (truth = label AND pred = label) AS tp, count(*) FILTER (truth <> label AND pred = label) AS fp,
  count(*) FILTER (truth = label AND pred <> label) AS fn FROM t, lab GROUP BY label)
SELECT (SELECT count(*) FROM t) AS n_samples, count(*) AS n_classes,
  round((SELECT avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END) FROM t), 9) AS accuracy,
  round(avg(coalesce(tp / nullif(tp + fp, 0), 0)), 9) AS "precision", round(avg(coalesce(tp / nullif(tp + fn, 0), 0)), 9) AS recall,
  round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)), 9) AS f1, CAST(NULL AS VARCHAR) AS note FROM s""")
def macro_classification(spark, sf):
    """The supplier's region predicted by the customer's, over all lines."""
    nation, region = w.table(spark, sf, "nation"), w.table(spark, sf, "region")
    named = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    lines = (
        w.table(spark, sf, "lineitem").join(w.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(w.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(w.table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(named.select(F.col("n_nationkey").alias("s_nationkey"), F.col("r_name").alias("truth")), "s_nationkey")
        .join(named.select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("pred")), "c_nationkey")
    )
    return _rounded(metrics.classification_metrics(lines.select("truth", "pred")))


@query("grouped_classification", f"""WITH {PAIRS}, b AS ({BINARY.format(k='lang,', t='pairs', g='GROUP BY lang')})
{FINISH.format(k='lang,')}""")
def grouped_classification(spark, sf):
    return _rounded(metrics.classification_metrics(_label_pairs(spark, sf), ["lang"]))


@query("question_alignment", f"""WITH {PAIRS} SELECT CAST(doc_id AS VARCHAR) AS query_id, truth, observed,
  CASE WHEN doc_id % 7 = 0 THEN '__unknown__' ELSE pred END AS pred FROM pairs""")
def question_alignment(spark, sf):
    return metrics.align_predictions(*_questions(spark, sf))


def _questions(spark, sf):
    pairs = _label_pairs(spark, sf).withColumn("query_id", F.col("doc_id").cast("string"))
    asked = pairs.select("query_id", F.col("truth").alias("ground_truth_prediction"),
                         F.col("observed").alias("synthetic_data_value"))
    return asked, pairs.select("query_id", F.when(F.col("doc_id") % 7 != 0, F.col("pred")).alias("pred"))


THREE = "SELECT '{n}' AS comparison, {t} AS truth, {p} AS pred FROM pairs"


@query("question_report", f"""WITH {PAIRS}, long AS ({THREE.format(n='model_vs_ground_truth', t='truth', p='pred')}
UNION ALL {THREE.format(n='model_vs_synthetic_data', t='observed', p='pred')}
UNION ALL {THREE.format(n='ground_truth_vs_synthetic_data', t='observed', p='truth')}),
b AS ({BINARY.format(k='comparison,', t='long', g='GROUP BY comparison')}) {FINISH.format(k='comparison,')}""")
def question_report(spark, sf):
    pairs = _label_pairs(spark, sf)
    return _rounded(metrics.question_report(pairs))


T_VALUES = ", ".join(f"({n}, {t_quantile(n - 1)!r})" for n in range(2, 40))


@query("across_trials", f"""WITH m AS (SELECT c_mktsegment AS path, year(o_orderdate) AS trial, avg(o_totalprice) AS v
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL
  UNION ALL SELECT 'single', year(min(o_orderdate)), avg(o_totalprice) FROM orders),
s AS (SELECT path, avg(v) AS mean, stddev_samp(v) AS sd, count(*) AS n,
  string_agg(CAST(CAST(round(v) AS BIGINT) AS VARCHAR), ',' ORDER BY trial) AS vals FROM m GROUP BY path)
SELECT path, round(mean, 4) AS mean, round(coalesce(sd, 0), 4) AS std,
  round(mean - coalesce(t * sd / sqrt(n), 0), 3) AS ci_95_low, round(mean + coalesce(t * sd / sqrt(n), 0), 3) AS ci_95_high,
  n AS n_trials, vals AS "values" FROM s LEFT JOIN (VALUES {T_VALUES}) q(k, t) ON k = n""")
def across_trials(spark, sf):
    """Average order value per segment, each order year as a trial, and one metric with a single trial."""
    orders = w.table(spark, sf, "orders").join(w.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    m = orders.groupBy(F.col("c_mktsegment").alias("path"), F.year("o_orderdate").alias("trial")).agg(F.avg("o_totalprice").alias("value"))
    one = w.table(spark, sf, "orders").agg(F.year(F.min("o_orderdate")).alias("trial"), F.avg("o_totalprice").alias("value"))
    out = metrics.across_trials(m.unionByName(one.select(F.lit("single").alias("path"), "trial", "value")))
    return out.select("path", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
                      F.round("ci_95_low", 3).alias("ci_95_low"), F.round("ci_95_high", 3).alias("ci_95_high"), "n_trials",
                      F.array_join(F.transform("values", lambda v: F.round(v).cast("bigint").cast("string")), ",").alias("values"))


MODELS = ["gpt-5.4-2026-03-05", "gemini-3.1-pro-preview", "accounts/fireworks/models/qwen3p6-plus"]


def _calls(spark, sf, unpriced=False):
    """Each conversation turn as a call, sized by its text."""
    size = F.length("text").cast("bigint")
    model = F.array(*[F.lit(m) for m in MODELS])[(F.col("conv_id") % 3).cast("int")]
    if unpriced:
        model = F.when(F.col("role") == "system", F.lit("unpriced")).otherwise(model)
    return w.table(spark, sf, "conversations").select(
        F.col("role").alias("op"), model.alias("model"), (F.col("turn") % 3 == 0).alias("cached"),
        (size * 500).alias("prompt_tokens"), (size * 100).alias("cached_prompt_tokens"), (size * 7).alias("completion_tokens"),
        (size * 507).alias("total_tokens"), ((F.col("turn") % 3 != 0) & (size > 600)).alias("truncated"),
    )


CALLS = """calls AS (SELECT role AS op, CASE WHEN {u} THEN 'unpriced' WHEN conv_id % 3 = 0 THEN 'gpt-5.4'
  WHEN conv_id % 3 = 1 THEN 'gemini-3.1-pro-preview' ELSE 'accounts/fireworks/models/qwen3p6-plus' END AS model,
  turn % 3 = 0 AS cached, length(text) * 500 AS pt, length(text) * 100 AS ct, length(text) * 7 AS ot, length(text) * 507 AS tt,
  turn % 3 <> 0 AND length(text) > 600 AS truncated FROM conversations),
priced AS (SELECT *, CASE WHEN model = 'gpt-5.4' AND pt <= 272000 THEN (greatest(pt - ct, 0) * 2.5 + ct * 0.25 + ot * 15) / 1e6
  WHEN model = 'gpt-5.4' THEN (greatest(pt - ct, 0) * 5.0 + ct * 0.5 + ot * 22.5) / 1e6
  WHEN model = 'gemini-3.1-pro-preview' AND pt <= 200000 THEN (greatest(pt - ct, 0) * 2.0 + ct * 0.2 + ot * 12) / 1e6
  WHEN model = 'gemini-3.1-pro-preview' THEN (greatest(pt - ct, 0) * 4.0 + ct * 0.4 + ot * 18) / 1e6
  WHEN model = 'unpriced' THEN NULL ELSE (greatest(pt - ct, 0) * 0.5 + ct * 0.1 + ot * 3.0) / 1e6 END AS cost FROM calls)"""
SUMMARY = """SELECT {b} AS bucket, count(*) AS calls, count(*) FILTER (NOT cached) AS billed_calls,
  count(*) FILTER (cached) AS cached_calls, CAST(sum(pt) AS BIGINT) AS prompt_tokens, CAST(sum(ct) AS BIGINT) AS cached_prompt_tokens,
  CAST(sum(ot) AS BIGINT) AS completion_tokens, CAST(sum(tt) AS BIGINT) AS total_tokens, count(*) FILTER (truncated) AS truncated,
  round(100.0 * count(*) FILTER (truncated) / nullif(count(*) FILTER (NOT cached), 0), 4) AS truncation_pct,
  CASE WHEN count(*) = count(cost) THEN round(sum(cost), 4) END AS cost_without_store,
  CASE WHEN count(*) = count(cost) THEN round(coalesce(sum(cost) FILTER (NOT cached), 0), 4) END AS cost_with_store,
  CASE WHEN count(*) = count(cost) THEN round(coalesce(sum(cost) FILTER (cached), 0), 4) END AS saved FROM priced {g}"""
BUCKET = "CASE WHEN cached THEN op || '_cached' ELSE op END"


@query("call_ledger", f"""WITH {CALLS.format(u='FALSE')} SELECT {BUCKET} AS bucket, count(*) AS calls, CAST(sum(pt) AS BIGINT) AS prompt_tokens,
CAST(sum(ct) AS BIGINT) AS cached_prompt_tokens, CAST(sum(ot) AS BIGINT) AS completion_tokens, CAST(sum(tt) AS BIGINT) AS total_tokens,
count(*) FILTER (truncated) AS truncated FROM calls GROUP BY bucket""")
def call_ledger(spark, sf):
    return usage.ledger(_calls(spark, sf))


@query("call_costs", f"WITH {CALLS.format(u='FALSE')} SELECT op, cached, pt AS prompt_tokens, round(cost, 9) AS cost FROM priced")
def call_costs(spark, sf):
    """Tiered price of every call."""
    return usage.price_calls(_calls(spark, sf)).select("op", "cached", "prompt_tokens", F.round("cost", 9).alias("cost"))


def _summary(df):
    out = df
    for c in ("truncation_pct", "cost_without_store", "cost_with_store", "saved"):
        out = out.withColumn(c, F.round(c, 4))
    return out


@query("usage_summary", f"""WITH {CALLS.format(u='FALSE')} {SUMMARY.format(b=BUCKET, g='GROUP BY bucket')}
UNION ALL {SUMMARY.format(b='NULL', g='')}""")
def usage_summary(spark, sf):
    return _summary(usage.usage_summary(_calls(spark, sf)))


@query("usage_unpriced", f"""WITH {CALLS.format(u="role = 'system'")} {SUMMARY.format(b=BUCKET, g='GROUP BY bucket')}
UNION ALL {SUMMARY.format(b='NULL', g='')}""")
def usage_unpriced(spark, sf):
    """With an unpriced model among the calls, its buckets and the total have no cost."""
    return _summary(usage.usage_summary(_calls(spark, sf, unpriced=True)))


@query("model_evaluation")
def model_evaluation(spark, sf):
    """All metrics of a fitted model on its questions, test rows and a true graph."""
    star = durable(w.star(spark, sf).select("row_id", *NODES))
    net = fit_blankets(star, NODES, EDGES)
    model = Model("subsample", ModelConfig(backend="blanket"), net)
    questions = durable(random_questions(fit_global(star, NODES, EDGES), star, "row_id",
                                         w.table(spark, sf, "supplier").count(), seed=3))
    truth = (NODES, [*EDGES[:2], ("linestatus", "late")])
    out = report.evaluate(model, star, questions, truth, propagated=True)
    return out.select("path", F.round("value", 6).alias("value"))
