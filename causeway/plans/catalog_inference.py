"""Queries on posteriors, predictions, generation and propagation."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.operators import generate, inference
from causeway.plans import workloads as w
from causeway.plans.model import Model
from causeway.config import ModelConfig
from causeway.plans.network import Network, fit_blankets, fit_global
from causeway.plans.registry import query
from causeway.session import durable

# The structure behind the derived columns of the star table.
NODES = ["late", "orderyear", "shipyear", "linestatus", "returnflag"]
EDGES = [("orderyear", "late"), ("shipyear", "late"), ("late", "linestatus"), ("linestatus", "returnflag")]
STAR = f"WITH star AS ({w.STAR_SQL})"


def _states(var: str) -> str:
    return f"(SELECT DISTINCT {var} FROM star)"


def _cpt_cte(node: str, parents: list[str], name: str) -> str:
    """Complete table: uniform where the parents' configuration never occurs."""
    pa = ", ".join(parents)
    if not parents:
        return f"{name} AS (SELECT {node}, count(*) / (SELECT count(*) FROM star) AS p FROM star GROUP BY {node})"
    full = " CROSS JOIN ".join(_states(v) for v in [*parents, node])
    same = " AND ".join(f"{{}}.{v} = g.{v}" for v in parents)
    return f"""{name} AS (SELECT {', '.join('g.' + v for v in [*parents, node])},
  CASE WHEN t.total IS NULL THEN 1.0 / (SELECT count(*) FROM {_states(node)}) ELSE coalesce(c.n, 0) / t.total END AS p
  FROM (SELECT * FROM {full}) g
  LEFT JOIN (SELECT {pa}, count(*) AS total FROM star GROUP BY {pa}) t ON {same.format(*['t'] * len(parents))}
  LEFT JOIN (SELECT {pa}, {node}, count(*) AS n FROM star GROUP BY {pa}, {node}) c
    ON {same.format(*['c'] * len(parents))} AND c.{node} = g.{node})"""


JOINT = f"""{STAR}, {_cpt_cte('orderyear', [], 'f1')}, {_cpt_cte('shipyear', [], 'f2')},
{_cpt_cte('late', ['orderyear', 'shipyear'], 'f3')}, {_cpt_cte('linestatus', ['late'], 'f4')},
{_cpt_cte('returnflag', ['linestatus'], 'f5')},
joint AS (SELECT late, orderyear, shipyear, linestatus, returnflag, f1.p * f2.p * f3.p * f4.p * f5.p AS p
  FROM f3 JOIN f1 USING (orderyear) JOIN f2 USING (shipyear) JOIN f4 USING (late) JOIN f5 USING (linestatus))"""


def _network(spark, sf) -> Network:
    return fit_global(w.star(spark, sf), NODES, EDGES)


def _local(spark, sf) -> Network:
    return fit_blankets(w.star(spark, sf), NODES, EDGES)


def _rounded(answers):
    out = inference.distribution_rows(answers)
    return out.select("query_id", "target", "state", F.round("p", 7).alias("p"))


@query("priors", f"{JOINT} " + " UNION ALL ".join(
    f"SELECT '{v}' AS target, {v} AS state, round(sum(p), 7) AS p FROM joint GROUP BY {v}" for v in NODES))
def priors(spark, sf):
    out = inference.priors(_network(spark, sf), spark)
    return out.select("target", F.explode("dist").alias("state", "p")).withColumn("p", F.round("p", 7))


def _orders_asked(spark, sf):
    """One query per distinct (order status, order year): is the line late, given year and return flag?"""
    star = w.star(spark, sf)
    asked = star.groupBy("orderyear", "returnflag").agg(F.count("*").alias("n"))
    return asked.select(
        F.concat_ws("/", "orderyear", "returnflag").alias("query_id"), F.lit("late").alias("target"),
        F.create_map(F.lit("orderyear"), F.col("orderyear"), F.lit("returnflag"), F.col("returnflag"),
                     F.lit("segment"), F.lit("ignored")).alias("context"),
    )


@query("posterior", f"""{JOINT}, m AS (SELECT orderyear, returnflag, late, sum(p) AS p FROM joint GROUP BY ALL)
SELECT orderyear || '/' || returnflag AS query_id, 'late' AS target, late AS state,
  round(p / sum(p) OVER (PARTITION BY orderyear, returnflag), 7) AS p FROM m""")
def posterior(spark, sf):
    """P(late | order year, return flag) by elimination over the whole graph."""
    return _rounded(inference.posterior(_orders_asked(spark, sf), _network(spark, sf)))


@query("posterior_all_targets", f"{JOINT} " + " UNION ALL ".join(
    f"""SELECT late || '/{v}' AS query_id, '{v}' AS target, state, round(p / sum(p) OVER (PARTITION BY late), 7) AS p
    FROM (SELECT late, {v} AS state, sum(p) AS p FROM joint GROUP BY ALL)""" for v in NODES if v != "late"))
def posterior_all_targets(spark, sf):
    """Every node given each value of ``late``."""
    late = w.star(spark, sf).select("late").distinct()
    asked = late.select("late", F.explode(F.array(*[F.lit(v) for v in NODES if v != "late"])).alias("target"))
    asked = asked.select(F.concat_ws("/", "late", "target").alias("query_id"), "target",
                         F.create_map(F.lit("late"), F.col("late")).alias("context"))
    return _rounded(inference.posterior(asked, _network(spark, sf)))


# All fifteen columns: four parts without a path between them, the first with undirected cycles.
WIDE = {
    "years": (["orderyear", "shipyear", "late", "linestatus", "orderstatus", "returnflag"], [
        ("orderyear", "shipyear"), ("orderyear", "late"), ("shipyear", "late"), ("late", "linestatus"), ("shipyear", "linestatus"),
        ("linestatus", "returnflag"), ("linestatus", "orderstatus"), ("orderyear", "orderstatus")]),
    "goods": (["ptype", "brand", "unitprice", "quantity", "price"], [
        ("ptype", "brand"), ("brand", "unitprice"), ("unitprice", "price"), ("quantity", "price")]),
    "terms": (["discount", "tax"], [("discount", "tax")]),
    "buyer": (["priority", "segment"], [("priority", "segment")]),
}
SEEN = {"years": "shipyear", "goods": "price"}


def _wide_sql() -> str:
    ctes, out = [], []
    for part, (nodes, edges) in WIDE.items():
        parents = {v: sorted(p for p, c in edges if c == v) for v in nodes}
        ctes += [_cpt_cte(v, parents[v], f"w_{v}") for v in nodes]
        done: list[str] = []
        joins = ""
        for v in nodes:  # parents come before children
            using = f" USING ({', '.join(parents[v])})" if parents[v] else ""
            joins += f" JOIN w_{v}{using}" if parents[v] else (f" CROSS JOIN w_{v}" if done else f"w_{v}")
            done.append(v)
        ctes.append(f"j_{part} AS (SELECT {', '.join(nodes)}, {' * '.join(f'w_{v}.p' for v in nodes)} AS p FROM {joins})")
        seen = SEEN.get(part)
        for v in nodes:
            if seen is None or seen == v:
                ctes.append(f"m_{v} AS (SELECT {v} AS state, sum(p) AS p FROM j_{part} GROUP BY {v})")
                ctes.append(f"q_{v} AS (SELECT shipyear, price, state, p FROM asked, m_{v})")
            else:
                ctes.append(f"m_{v} AS (SELECT {seen}, {v} AS state, sum(p) AS p FROM j_{part} GROUP BY ALL)")
                ctes.append(f"q_{v} AS (SELECT asked.shipyear, asked.price, state, p FROM asked JOIN m_{v} USING ({seen}))")
            out.append(f"SELECT shipyear || '/' || price || '/{v}' AS query_id, '{v}' AS target, state,"
                       f" round(p / sum(p) OVER (PARTITION BY shipyear, price), 7) AS p FROM q_{v}")
    return f"{STAR}, asked AS (SELECT DISTINCT shipyear, price FROM star), {', '.join(ctes)} " + " UNION ALL ".join(out)


@query("posterior_all_nodes", _wide_sql())
def posterior_all_nodes(spark, sf):
    """Every node of a network over all columns, given ship year and price of every pair that occurs."""
    star = durable(w.star(spark, sf))
    net = fit_global(star, w.STAR_COLUMNS, [e for _, edges in WIDE.values() for e in edges])
    pairs = star.select("shipyear", "price").distinct()
    asked = pairs.select("shipyear", "price", F.explode(F.array(*[F.lit(v) for v in w.STAR_COLUMNS])).alias("target"))
    asked = asked.select(
        F.concat_ws("/", "shipyear", "price", "target").alias("query_id"), "target",
        F.create_map(F.lit("shipyear"), F.col("shipyear"), F.lit("price"), F.col("price")).alias("context"))
    return _rounded(inference.posterior(asked, net))


@query("blanket_posterior", f"""{STAR}, {_cpt_cte('late', [], 'g1')}, {_cpt_cte('linestatus', ['late'], 'g2')},
{_cpt_cte('returnflag', ['linestatus'], 'g3')},
m AS (SELECT linestatus, late, returnflag, g1.p * g2.p * g3.p AS p FROM g1 JOIN g2 USING (late) JOIN g3 USING (linestatus)),
e AS (SELECT returnflag, linestatus, sum(p) AS p FROM m GROUP BY ALL)
SELECT returnflag AS query_id, 'linestatus' AS target, linestatus AS state,
  round(p / sum(p) OVER (PARTITION BY returnflag), 7) AS p FROM e""")
def blanket_posterior(spark, sf):
    """P(line status | return flag) on the blanket's own tables, where ``late`` has no parents."""
    flags = w.star(spark, sf).select("returnflag").distinct()
    asked = flags.select(F.col("returnflag").alias("query_id"), F.lit("linestatus").alias("target"),
                         F.create_map(F.lit("returnflag"), F.col("returnflag"), F.lit("orderyear"), F.lit("1996")).alias("context"))
    return _rounded(inference.posterior(asked, _local(spark, sf)))


@query("map_state", f"""{JOINT}, m AS (SELECT orderyear, returnflag, late, sum(p) AS p FROM joint GROUP BY ALL)
SELECT orderyear || '/' || returnflag AS query_id, 'late' AS target,
  first(late ORDER BY p DESC, late) AS pred FROM m GROUP BY orderyear, returnflag""")
def map_state(spark, sf):
    answers = inference.posterior(_orders_asked(spark, sf), _network(spark, sf))
    return answers.select("query_id", "target", inference.map_state(F.col("dist")).alias("pred"))


@query("unanswerable", """SELECT c_mktsegment AS query_id, c_mktsegment AS target, TRUE AS no_answer
FROM customer GROUP BY c_mktsegment UNION ALL SELECT 'year ' || c_mktsegment, 'late', TRUE FROM customer GROUP BY c_mktsegment""")
def unanswerable(spark, sf):
    """Unknown targets, and evidence with a state never seen in training."""
    seg = w.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("s")).distinct()
    asked = seg.select(F.col("s").alias("query_id"), F.col("s").alias("target"),
                       F.create_map(F.lit("late"), F.lit("y")).alias("context")).union(
        seg.select(F.concat(F.lit("year "), "s"), F.lit("late"), F.create_map(F.lit("orderyear"), F.col("s"))))
    answers = inference.posterior(asked, _network(spark, sf))
    return answers.select("query_id", "target", F.col("dist").isNull().alias("no_answer"))


@query("unanswerable_only", "SELECT CAST(c_custkey AS VARCHAR) AS query_id, c_name AS target, TRUE AS no_answer FROM customer")
def unanswerable_only(spark, sf):
    """One question per customer, none about a node of the network."""
    asked = w.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("query_id"), F.col("c_name").alias("target"),
        F.create_map(F.lit("late"), F.lit("y")).alias("context"))
    answers = inference.posterior(asked, _network(spark, sf))
    return answers.select("query_id", "target", F.col("dist").isNull().alias("no_answer"))


@query("predict_table", f"""{JOINT}, j AS (SELECT s.orderyear, s.shipyear, s.linestatus, s.returnflag, s.late AS label, j.late AS state, count(*) AS n, min(j.p) AS p
  FROM star s JOIN joint j USING (orderyear, shipyear, linestatus, returnflag) GROUP BY ALL),
c AS (SELECT *, p / sum(p) OVER (PARTITION BY orderyear, shipyear, linestatus, returnflag, label) AS q FROM j),
prior AS (SELECT late AS state, sum(p) AS p FROM joint GROUP BY late)
SELECT label, state, round(sum(n * q), 4) AS mass, CAST(sum(n) AS BIGINT) AS rows, round(min(prior.p), 7) AS prior
FROM c JOIN prior USING (state) GROUP BY label, state""")
def predict_table(spark, sf):
    """All rows, all nodes; here the summed posterior of ``late`` per actual value."""
    star = durable(w.star(spark, sf).select("row_id", *NODES))
    rows = inference.predict_table(star, ["row_id"], fit_global(star.drop("row_id"), NODES, EDGES))
    late = rows.where(F.col("node") == "late").select("label", "prior", F.explode("joint").alias("state", "p"))
    return late.groupBy("label", "state").agg(
        F.round(F.sum("p"), 4).alias("mass"), F.count("*").alias("rows"),
        F.round(F.min(F.col("prior")[F.col("state")]), 7).alias("prior"),
    )


@query("forward_sample")
def forward_sample(spark, sf):
    """One synthetic row per order, summarised."""
    ids = w.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    rows = generate.forward_sample(_network(spark, sf), ids, seed=11)
    return rows.groupBy(*NODES).agg(F.count("*").alias("n"))


@query("random_questions")
def random_questions(spark, sf):
    """As many questions as there are customers."""
    star = durable(w.star(spark, sf).select("row_id", *NODES))
    num = w.table(spark, sf, "customer").count()
    return generate.random_questions(fit_global(star, NODES, EDGES), star, "row_id", num, seed=5)


@query("propagation")
def propagation(spark, sf):
    """P(return flag | order year, ship year): the years lie outside the target's blanket."""
    model = Model("subsample", ModelConfig(backend="blanket"), _local(spark, sf))
    years = w.star(spark, sf).groupBy("orderyear", "shipyear").agg(F.count("*").alias("n"))
    asked = years.select(F.concat_ws("/", "orderyear", "shipyear").alias("query_id"), F.lit("returnflag").alias("target"),
                         F.create_map(F.lit("orderyear"), F.col("orderyear"), F.lit("shipyear"), F.col("shipyear")).alias("context"))
    answers = model.predict_propagated(asked, max_hops=3, draws=20)
    return answers.select("query_id", "target", F.explode("dist").alias("state", "p"))
