"""Posteriors by joining and aggregating factor tables, for many queries at once."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.operators import signatures
from causeway.operators.clique_tree import OPEN, Tree
from causeway.operators.encode import evidence
from causeway.plans.network import Network, Scope
from causeway.session import broadcast_if_small, by_shuffle, collect_bounded, durable, is_scan, local_frame

SEP = "\u0001"
BROADCAST_STATES = 500_000  # probabilities with the names of their states that are looked up by broadcast


def evidence_key(context: Column) -> Column:
    """Canonical text of a context map."""
    entries = F.array_sort(F.map_entries(context))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), SEP)


def _elimination_order(scopes: list[set[str]], keep: str) -> list[str]:
    """Min-fill order of all variables but ``keep`` on the graph joining each scope."""
    adj: dict[str, set[str]] = {}
    for scope in scopes:
        for v in scope:
            adj.setdefault(v, set()).update(scope - {v})
    order = []
    while len(adj) > 1 or (adj and keep not in adj):
        def fill(v: str) -> int:
            return sum(1 for a, b in combinations(adj[v], 2) if b not in adj[a])

        v = min((v for v in adj if v != keep), key=lambda v: (fill(v), len(adj[v]), v))
        for a in adj[v]:
            adj[a] |= adj[v] - {a}
            adj[a].discard(v)
        del adj[v]
        order.append(v)
    return order


def _ancestors(parents: dict[str, list[str]], seeds: set[str]) -> set[str]:
    out, todo = set(), list(seeds)
    while todo:
        node = todo.pop()
        if node not in out:
            out.add(node)
            todo += parents[node]
    return out


def _weighted(frame: DataFrame, scope: Scope, node: str, cards: dict[str, int]) -> DataFrame:
    """Multiply one node's table into ``w``; unseen parent configurations are uniform."""
    key = F.array(*[F.col(f"v_{p}") for p in scope.parents[node]], F.col(f"v_{node}"))
    factor = scope.factor(node).withColumnsRenamed({"key": "f_key", "p": "f_p"})
    return (
        frame.join(factor, key == F.col("f_key"), "left")
        .withColumn("w", F.col("w") * F.coalesce("f_p", F.lit(1.0 / cards[node])))
        .drop("f_key", "f_p")
    )


def _eliminate(cases: DataFrame, used: set[str], target: str, scope: Scope,
               states: dict[str, list[str]]) -> DataFrame:
    """(ev_key, state, w) unnormalised, for cases (ev_key, ev) about one target.

    Bucket elimination: each variable in turn multiplies every factor that mentions it and
    is summed out. All evidence patterns share the plan, because an observed variable is
    simply one with a single allowed state. Every join and sum has ``ev_key`` among its keys.
    """
    parents = scope.parents
    relevant = _ancestors(parents, {target} | (used & parents.keys()))
    cards = {n: len(states[n]) for n in relevant}
    pending: dict[str, set[str]] = {n: {n, *parents[n]} for n in relevant}
    messages: list[tuple[set[str], DataFrame]] = []
    base = cases.select("ev_key", "ev")

    def allowed(v: str) -> Column:
        every = F.array(*[F.lit(s) for s in states[v]])
        if v == target or v not in used:
            return every
        seen = F.col("ev")[v]
        return F.when(seen.isNotNull(), F.array(seen)).otherwise(every)

    def product(names: list[str], incoming: list[tuple[set[str], DataFrame]]) -> tuple[set, DataFrame]:
        have: set[str] = set()
        frame = base
        for i, (vars_, msg) in enumerate(incoming):
            shared = sorted(have & vars_)
            msg = msg.withColumnRenamed("w", f"w{i}")
            frame = frame.join(msg, ["ev_key", *[f"v_{v}" for v in shared]])
            have |= vars_
        weight = reduce(lambda a, b: a * b, [F.col(f"w{i}") for i in range(len(incoming))], F.lit(1.0))
        for v in sorted(set().union(*[pending[n] for n in names]) - have if names else set()):
            frame = frame.withColumn(f"v_{v}", F.explode(allowed(v)))
            have.add(v)
        frame = frame.select("ev_key", *[f"v_{v}" for v in sorted(have)], weight.alias("w"))
        for n in sorted(names):
            frame = _weighted(frame, scope, n, cards)
        return have, frame

    for v in _elimination_order(list(pending.values()), target):
        names = [n for n, s in pending.items() if v in s]
        incoming = [m for m in messages if v in m[0]]
        messages = [m for m in messages if v not in m[0]]
        have, frame = product(names, incoming)
        for n in names:
            del pending[n]
        rest = have - {v}
        summed = frame.where(F.col("w") > 0).groupBy("ev_key", *[f"v_{u}" for u in sorted(rest)]).agg(
            F.sum("w").alias("w")
        )
        messages.append((rest, summed))
    _, frame = product(list(pending), messages)
    return frame.select("ev_key", F.col(f"v_{target}").alias("state"), "w")


def _by_tree(cases: DataFrame, network: Network) -> DataFrame:
    """(target, ev_key, state, w) of all targets from one clique tree over the whole graph."""
    spark, nodes = cases.sparkSession, sorted(network.nodes)
    tree = Tree(spark, network.parents, network.states, network.rows.select("node", "key", "p"))
    place = [F.coalesce(F.array_position(F.array(*[F.lit(s) for s in network.states[v]]), F.col("ev")[v]) - 1, F.lit(OPEN)).cast("int")
             for v in nodes]
    evidence_cases = durable(cases.groupBy("ev_key").agg(F.first("ev").alias("ev")).select("ev_key", F.array(*place).alias("obs")))
    found = tree.posteriors(evidence_cases, cases.select("target", "ev_key"))
    catalogue = F.create_map(*[x for n in nodes for x in (F.lit(n), F.array(*[F.lit(s) for s in network.states[n]]))])
    return found.select("target", "ev_key", F.get(catalogue[F.col("target")], F.col("state")).alias("state"), "w")


def posterior(queries: DataFrame, network: Network, id_col: str = "query_id") -> DataFrame:
    """(query_id, target, dist) for queries (query_id, target, context map).

    ``dist`` maps every state to its probability. It is NULL for an unknown target, for
    evidence outside the training states, and for evidence of probability zero. Equal
    (target, evidence) pairs are computed once.
    """
    network.require_parameters()
    spark = queries.sparkSession
    members = F.create_map(*[
        x for n in network.nodes
        for x in (F.lit(n), F.array(*[F.lit(m) for m in sorted(network.members(n))]))
    ])
    ev = evidence(F.col("context"), members[F.col("target")], F.col("target"))
    keyed = queries.where(F.col("target").isin(list(network.nodes))).withColumn("ev", ev).withColumn(
        "ev_key", evidence_key(F.col("ev"))
    )
    keyed = durable(keyed.select(id_col, "target", "ev", "ev_key"))
    cases = durable(keyed.groupBy("target", "ev_key").agg(F.first("ev").alias("ev")))
    catalogue = F.create_map(*[
        x for n in network.nodes
        for x in (F.lit(n), F.array(*[F.lit(s) for s in network.states[n]]))
    ])
    known = F.forall(
        F.map_entries("ev"), lambda e: F.array_contains(F.element_at(catalogue, e["key"]), e["value"])
    )
    answerable = cases.where(known)
    about = collect_bounded(
        cases.select("target", F.posexplode_outer(F.map_keys("ev")).alias("at", "name")).groupBy("target").agg(
            F.collect_set("name").alias("names"), F.count_if(F.coalesce("at", F.lit(0)) == 0).alias("cases")),
        "evidence names",
    )
    used = {r["target"]: set(r["names"] or []) for r in about}
    size = sum(r["cases"] * len(network.states[r["target"]]) for r in about)
    if network.local is None and len(used) > 1:
        parts = [_by_tree(answerable, network)]
    else:  # a single target, or a graph of its own for each
        parts = [
            _eliminate(answerable.where(F.col("target") == target), used[target], target, network.scope(target), network.states)
            .withColumn("target", F.lit(target))
            for target in sorted(used)
        ]
    lost = queries.where(~F.col("target").isin(list(network.nodes)) | F.col("target").isNull()).select(
        id_col, "target", F.lit(None).cast("map<string,double>").alias("dist")
    )
    if not parts:  # no query, or none that names a node of the network
        return lost
    weights = reduce(DataFrame.unionByName, parts)
    total = weights.groupBy("target", "ev_key").agg(
        F.map_from_entries(F.collect_list(F.struct("state", "w"))).alias("w"),
        F.sum("w").alias("total"),
    )
    # impossible states left no rows; they belong in the answer with probability zero
    every = F.element_at(catalogue, F.col("target"))
    share = F.transform(every, lambda s: F.coalesce(F.col("w")[s], F.lit(0.0)) / F.col("total"))
    dist = F.when(F.col("total") > 0, F.map_from_arrays(every, share))
    answers = total.select("target", "ev_key", dist.alias("dist"))
    # the queries grow with the rows, the cases often do not
    answers = F.broadcast(answers) if size <= BROADCAST_STATES else by_shuffle(answers)
    found = keyed.join(answers, ["target", "ev_key"], "left").select(id_col, "target", "dist")
    return found.unionByName(lost)


def distribution_rows(answers: DataFrame, id_col: str = "query_id") -> DataFrame:
    """Answers as long rows (query_id, target, state, p)."""
    return answers.select(id_col, "target", F.explode("dist").alias("state", "p"))


def map_state(dist: Column) -> Column:
    """Most probable state; the first in state order among equals."""
    entries = F.transform(
        F.map_entries(dist), lambda e: F.struct((-e["value"]).alias("np"), e["key"].alias("state"))
    )
    return F.array_min(entries)["state"]


def priors(network: Network, spark) -> DataFrame:
    """(target, dist) without evidence, once per node."""
    asked = spark.createDataFrame([(n, n) for n in network.nodes], "query_id string, target string")
    asked = asked.withColumn("context", F.create_map().cast("map<string,string>"))
    return posterior(asked, network).select("target", "dist")


def predict_table(df: DataFrame, key: Sequence[str], network: Network) -> DataFrame:
    """(key.., node, prior, joint, label) for every row and node.

    Rows are grouped by the signatures of node groups (see ``signatures``): the posteriors of a signature
    are computed once, and a row joins them once per group. While the signatures can be broadcast, no row
    is shuffled for its answers. Rows with NULLs go through the general elimination.
    """
    network.require_parameters()
    nodes = list(network.nodes)
    if not set(nodes) <= set(df.columns):
        raise ValueError("the table lacks columns of the network")
    spark = df.sparkSession
    rows = df.select(F.struct(*key).alias("row"), F.array(*[F.col(n).cast("string") for n in nodes]).alias("values"))
    if not is_scan(df):
        rows = durable(rows)
    groups = signatures.node_groups(network)
    found = durable(signatures.signatures(rows.select("values"), groups, nodes).groupBy("group_id", "signature").agg(
        F.count("*").alias("n")))
    done = signatures.predict(rows, network, groups, found)
    prior = durable(priors(network, spark))
    names = local_frame(spark, [(i, n, network.states[n]) for i, n in enumerate(nodes)], "number int, target string, states array<string>")
    about = broadcast_if_small(names.join(prior, "target").select(
        F.col("number").alias("node"), F.col("target").alias("name"), "states", F.col("dist").alias("prior")))
    keys = [F.col("row")[k].alias(k) for k in key]
    whole = done.join(about, "node").select(
        *keys, F.col("name").alias("node"), "prior", F.map_from_arrays("states", "vec").alias("joint"), "label")
    if found.where(F.col("group_id") == signatures.PARTIAL).isEmpty():
        return whole
    gaps = rows.where(F.exists("values", lambda v: v.isNull()))
    text = gaps.select(*keys, *[F.col("values")[i].alias(n) for i, n in enumerate(nodes)])
    by_name = about.select(F.col("name").alias("node"), "prior")
    partial = _predict_partial(text, key, nodes, network).join(broadcast_if_small(by_name), "node")
    return whole.unionByName(partial.select(*key, "node", "prior", "joint", "label"))


def _predict_partial(rows: DataFrame, key: Sequence[str], nodes: list[str],
                     network: Network) -> DataFrame:
    context = F.create_map(*[x for n in nodes for x in (F.lit(n), F.col(n))])
    asked = rows.select(
        F.struct(*key).alias("row"), context.alias("context"),
        F.explode(F.array(*[F.lit(n) for n in nodes])).alias("target"),
    )
    # the answer's id carries the row and its label, so repeated rows stay rows of their own
    asked = asked.withColumn("query_id", F.struct("row", F.col("context")[F.col("target")].alias("label")))
    answers = posterior(asked.select("query_id", "target", "context"), network)
    return answers.select(
        *[F.col("query_id.row")[k].alias(k) for k in key], F.col("target").alias("node"),
        F.col("query_id.label").alias("label"), F.col("dist").alias("joint"),
    )
