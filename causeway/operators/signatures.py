"""Whole-table posteriors through the signatures of node groups.

With a complete row a node's posterior depends only on its blanket. Nodes whose blankets lie inside
another node's blanket share its group, and a row's values on the group's variables are its signature.
Each distinct signature is computed once, and a row looks its answers up once per group, however many
children or states its nodes have.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.plans.network import Network
from causeway.session import broadcast_if_small, durable, local_frame

BROADCAST_CELLS = 2_000_000  # numbers of a table that is looked up by broadcast (8 bytes each)
HOT = 1000  # keys with more than this part of all rows are fewer than this
PARTIAL = -1  # group of the rows with NULLs


class Group(NamedTuple):
    """``names`` are the variables of the signature, ``members`` the nodes answered by it."""

    names: tuple[str, ...]
    members: tuple[str, ...]


def factors(network: Network, node: str) -> list[tuple[str, tuple[str, ...]]]:
    """(variable, its table's key) of the tables that mention a node: its own and its children's."""
    parents = network.scope(node).parents
    children = [c for c, ps in parents.items() if node in ps]
    return [(v, (*parents[v], v)) for v in (node, *children)]


def node_groups(network: Network) -> list[Group]:
    """Every node in the first group, largest first, that holds all variables of its tables."""
    closed = {n: {v for _, key in factors(network, n) for v in key} for n in network.nodes}
    groups: list[tuple[set[str], list[str]]] = []
    for n in sorted(closed, key=lambda n: (-len(closed[n]), n)):
        home = next((members for names, members in groups if closed[n] <= names), None)
        if home is None:
            groups.append((closed[n], [n]))
        else:
            home.append(n)
    return [Group(tuple(sorted(names)), tuple(members)) for names, members in groups]


def signatures(rows: DataFrame, groups: Sequence[Group], nodes: Sequence[str]) -> DataFrame:
    """Rows (.., values) with one row per group: (.., group_id, signature); one of group ``PARTIAL`` at NULLs."""
    at = {n: i for i, n in enumerate(nodes)}
    entries = [
        F.struct(F.lit(g).alias("group_id"), F.array(*[F.col("values")[at[v]] for v in group.names]).alias("signature"))
        for g, group in enumerate(groups)
    ]
    none = F.struct(F.lit(PARTIAL).alias("group_id"), F.array().cast("array<string>").alias("signature"))
    whole = F.forall("values", lambda v: v.isNotNull())
    found = F.explode(F.when(whole, F.array(*entries)).otherwise(F.array(none))).alias("e")
    kept = [c for c in rows.columns if c != "values"]
    return rows.select(*kept, found).select(*kept, "e.*")


def lookup(rows: DataFrame, table: DataFrame, on: list[str], limit: int, counts: DataFrame | None = None) -> DataFrame:
    """Every row with the one row of a written table that has its key, or NULLs.

    A table of at most ``limit`` rows is broadcast. Otherwise keys that hold more than one row in ``HOT``
    are (there are fewer than ``HOT``), and only the rows of the other keys are shuffled.
    """
    if table.limit(limit + 1).count() <= limit:
        return rows.join(F.broadcast(table), on, "left")
    if counts is None:
        counts = durable(rows.groupBy(*on).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(durable(counts.where(F.col("n") * HOT > total).select(*on)))
    often = rows.join(hot, on, "left_semi").join(F.broadcast(table.join(hot, on, "left_semi")), on, "left")
    return often.unionByName(rows.join(hot, on, "left_anti").join(table, on, "left"))


def _likelihoods(network: Network, groups: Sequence[Group]) -> tuple[DataFrame, DataFrame]:
    """(group_id, uses) and (node, factor, key, vec): which tables a group's nodes use, and all these tables.

    ``vec`` is P(variable's state | parents) as a vector over the states of ``node``; ``key`` holds the other
    entries of the table's key, which ``uses`` picks from a signature.
    """
    spark = network.rows.sparkSession
    number = {n: i for i, n in enumerate(network.nodes)}
    uses, tables = [], []
    for g, group in enumerate(groups):
        place = {v: i for i, v in enumerate(group.names)}
        own = []
        for m, node in enumerate(group.members):
            for f, (variable, key) in enumerate(factors(network, node)):
                own.append((m, number[node], f, [place[v] for v in key if v != node], len(network.states[node])))
                family = network.owners[node][variable] if network.local is not None else None
                tables.append((number[node], f, variable, family, key.index(node), 1.0 / len(network.states[variable]), network.states[node]))
        uses.append((g, own))
    use = "struct<member:int,node:int,factor:int,at:array<int>,states:int>"
    uses = local_frame(spark, uses, f"group_id int, uses array<{use}>")
    wanted = local_frame(spark, tables, "number int, factor int, node string, family_id int, at int, miss double, states array<string>")
    by_name = network.local is None
    wanted = wanted.drop("family_id") if by_name else wanted.drop("node")
    entries = network.rows.select("node" if by_name else "family_id", F.col("key").alias("full"), "p").join(
        broadcast_if_small(wanted), "node" if by_name else "family_id")
    entries = entries.select(
        F.col("number").alias("node"), "factor", "miss", "states", F.get("full", F.col("at")).alias("state"), "p",
        F.filter("full", lambda _, i: i != F.col("at")).alias("key"))
    grouped = entries.groupBy("node", "factor", "key").agg(
        F.map_from_entries(F.collect_list(F.struct("state", "p"))).alias("by_state"),
        F.first("miss").alias("miss"), F.first("states").alias("states"))
    vec = F.transform("states", lambda s: F.coalesce(F.col("by_state")[s], F.col("miss")))
    return uses, durable(grouped.select("node", "factor", "key", vec.alias("vec")))


def answers(found: DataFrame, network: Network, groups: Sequence[Group]) -> DataFrame:
    """(group_id, signature, vecs): normalised posteriors of the group's members; NULL where all states are impossible."""
    uses, tables = _likelihoods(network, groups)
    asked = found.where(F.col("group_id") != PARTIAL).join(broadcast_if_small(uses), "group_id")
    asked = asked.select("group_id", "signature", F.explode("uses").alias("u")).select(
        "group_id", "signature", "u.member", "u.node", "u.factor", "u.states",
        F.transform("u.at", lambda i: F.get("signature", i)).alias("key"))
    widest = max((len(s) for s in network.states.values()), default=1)
    terms = lookup(asked, tables, ["node", "factor", "key"], BROADCAST_CELLS // max(1, widest))
    # a configuration or state that training never saw says nothing
    vec = F.coalesce("vec", F.array_repeat(F.lit(1.0), F.col("states")))
    listed = terms.groupBy("group_id", "signature").agg(
        F.array_sort(F.collect_list(F.struct("member", "factor", vec.alias("vec")))).alias("terms"))

    def member(m):
        own = F.filter("terms", lambda t: t["member"] == m)
        product = F.aggregate(
            F.slice(own, 2, F.size("terms")), own[0]["vec"], lambda a, t: F.zip_with(a, t["vec"], lambda x, y: x * y))
        total = F.aggregate(product, F.lit(0.0), lambda a, x: a + x)
        return F.when(total > 0, F.transform(product, lambda x: x / total))

    last = F.element_at("terms", -1)["member"]
    return listed.select("group_id", "signature", F.transform(F.sequence(F.lit(0), last), member).alias("vecs"))


def predict(rows: DataFrame, network: Network, groups: Sequence[Group], found: DataFrame) -> DataFrame:
    """(.., node, label, vec) of all complete rows (.., values); ``found`` are their written, counted signatures."""
    nodes = network.nodes
    table = durable(answers(found, network, groups))
    size = max((sum(len(network.states[m]) for m in g.members) + len(g.names) for g in groups), default=1)
    kept = [c for c in rows.columns if c != "values"]
    long = signatures(rows, groups, nodes).where(F.col("group_id") != PARTIAL)
    counts = found.where(F.col("group_id") != PARTIAL)
    got = lookup(long, table, ["group_id", "signature"], BROADCAST_CELLS // size, counts)
    listed = [
        (g, [(nodes.index(m), group.names.index(m)) for m in group.members]) for g, group in enumerate(groups)
    ]
    members = local_frame(rows.sparkSession, listed, "group_id int, members array<struct<node:int,at:int>>")
    got = got.join(broadcast_if_small(members), "group_id")
    each = got.select(*kept, "signature", F.explode(F.arrays_zip("members", "vecs")).alias("e"))
    return each.select(*kept, F.col("e.members.node").alias("node"),
                       F.get("signature", F.col("e.members.at")).alias("label"), F.col("e.vecs").alias("vec"))
