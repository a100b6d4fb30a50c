"""Synthetic tables and prediction questions from a fitted network."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.hashing import hash_bits, hash_unit
from causeway.operators.inference import map_state, posterior
from causeway.operators.sampling import sample_rows
from causeway.plans.network import Network, topological
from causeway.session import by_shuffle, durable


def forward_sample(network: Network, ids: DataFrame, seed: int, id_col: str = "id") -> DataFrame:
    """One drawn row per id: (id, node columns).

    Nodes in topological order; each looks up its cumulative distribution by the parents'
    states and picks by a draw hashed from id and node. While the tables can be broadcast,
    rows are never shuffled.
    """
    network.require_parameters()
    out = ids.select(id_col)
    parents = network.parents
    for node in topological(network.nodes, parents):
        states = network.states[node]
        cum = F.transform(
            F.sequence(F.lit(1), F.lit(len(states))),
            lambda i: F.aggregate(F.slice("probs", F.lit(1), i), F.lit(0.0), lambda a, x: a + x),
        )
        table = network.cpts.where(F.col("node") == node).select(
            F.col("cfg").alias("t_cfg"), cum.alias("t_cum")
        )
        key = F.array(*[F.col(p) for p in parents[node]]).cast("array<string>")
        even = F.array(*[F.lit((i + 1) / len(states)) for i in range(len(states))])
        u = hash_unit(F.col(id_col), node, seed)
        below = F.size(F.filter(F.coalesce("t_cum", even), lambda c: c <= u))
        at = F.least(below, F.lit(len(states) - 1)) + 1
        out = out.join(table, key == F.col("t_cfg"), "left").withColumn(
            node, F.element_at(F.array(*[F.lit(s) for s in states]), at)
        ).drop("t_cfg", "t_cum")
    return out


def random_questions(network: Network, df: DataFrame, key: str, num: int, seed: int) -> DataFrame:
    """(query_id, target_node, context, ground_truth_prediction, synthetic_data_value).

    Rows are drawn by hash; the target is uniform, the context size uniform from none to
    all other nodes. The truth is the network's most probable state; questions the network
    cannot answer are dropped.
    """
    network.require_parameters()
    nodes = sorted(set(network.nodes) & set(df.columns))
    total = df.count()
    passes = math.ceil(num / total)
    drawn = sample_rows(df.select(key, *nodes), [key], passes, min(total, math.ceil(num / passes)), seed, total)
    drawn = drawn.where(F.col("sample_id") * math.ceil(num / passes) + F.col("pick") <= num)
    draw = [F.col(key), F.col("sample_id"), seed]
    listed = F.array(*[F.lit(n) for n in nodes])
    drawn = drawn.select(
        F.concat_ws(":", F.col("sample_id").cast("string"), F.col(key).cast("string")).alias("query_id"),
        F.create_map(*[x for n in nodes for x in (F.lit(n), F.col(n))]).alias("row"),
        listed[(hash_bits(*draw, "target") % len(nodes)).cast("int")].alias("target"),
        (hash_bits(*draw, "size") % len(nodes)).cast("int").alias("m"), *[c for c in (key, "sample_id")],
    )
    keyed = F.transform(
        F.array_remove(listed, F.col("target")),
        lambda n: F.struct(hash_bits(F.col(key), F.col("sample_id"), n, seed).alias("h"), n.alias("n")),
    )
    chosen = F.slice(F.transform(F.array_sort(keyed), lambda s: s["n"]), F.lit(1), F.col("m"))
    asked = drawn.withColumn("chosen", chosen)
    asked = durable(asked.select(
        "query_id", "target", F.map_from_arrays("chosen", F.transform("chosen", lambda n: F.col("row")[n])).alias("context"),
        F.col("row")[F.col("target")].alias("value"),
    ))
    answers = posterior(asked.select("query_id", "target", "context"), network)
    return asked.join(by_shuffle(answers.select("query_id", "dist")), "query_id").where(F.col("dist").isNotNull()).select(
        "query_id", F.col("target").alias("target_node"), "context",
        map_state(F.col("dist")).alias("ground_truth_prediction"), F.col("value").alias("synthetic_data_value"),
    )
