"""Evidence from outside the target's blanket, carried along open paths by sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.functions.hashing import hash_unit
from causeway.operators.graph import separation_aware_paths
from causeway.operators.inference import posterior
from causeway.plans.network import Network
from causeway.session import by_shuffle, durable, local_frame

TEXT_MAP = "map<string,string>"


def pick_state(dist: Column, u: Column) -> Column:
    """State at position ``u`` of the cumulative distribution, states in name order."""
    entries = F.array_sort(F.map_entries(dist))
    last = F.element_at(entries, -1)["key"]
    walk = F.aggregate(
        entries,
        F.struct(F.lit(0.0).alias("cum"), F.lit(None).cast("string").alias("hit")),
        lambda a, e: F.struct(
            (a["cum"] + e["value"]).alias("cum"),
            F.when(a["hit"].isNull() & (u < a["cum"] + e["value"]), e["key"]).otherwise(a["hit"]).alias("hit"),
        ),
        lambda a: a["hit"],
    )
    return F.coalesce(walk, last)


def propagate(queries: DataFrame, network: Network, max_hops: int | None = 3, draws: int = 50,
              seed: int = 0) -> DataFrame:
    """(query_id, target, dist): posterior averaged over draws of the entry nodes' states.

    Each distant observation looks for its shortest open path into the target's blanket.
    Per draw the states along the path are sampled from the blanket-local posteriors; if
    several paths end in one entry node, one of their samples is taken at random. Queries
    without such a path get the blanket-local posterior. Equal (node, evidence) cases of
    all queries and draws are computed once.
    """
    if draws <= 0:
        raise ValueError("draws must be positive")
    spark = queries.sparkSession
    nodes = list(network.nodes)
    members = F.create_map(*[
        x for n in nodes for x in (F.lit(n), F.array(*[F.lit(m) for m in sorted(network.members(n))]))
    ])
    asked = durable(queries.select("query_id", "target", F.col("context").cast(TEXT_MAP).alias("context")))
    known = asked.where(F.col("target").isin(nodes)).withColumn("blanket", members[F.col("target")])
    names = F.filter(F.map_keys("context"), lambda k: k != F.col("target"))
    known = durable(known.withColumn("distant", F.filter(
        F.array_intersect(names, F.array(*[F.lit(n) for n in nodes])),
        lambda k: ~F.array_contains(F.col("blanket"), k),
    )))
    sources = known.select("query_id", F.explode("distant").alias("source"))
    goals = known.select("query_id", F.explode(F.array_remove("blanket", F.col("target"))).alias("node"))
    observed = known.select("query_id", F.explode(F.map_keys("context")).alias("node"))
    dag = local_frame(spark, list(network.edges), "parent string, child string")
    paths = separation_aware_paths(sources, goals, observed, dag, max_hops, len(nodes))
    paths = durable(paths.withColumn("entry", F.element_at("path", -1)))
    open_ = paths.join(by_shuffle(known.select("query_id", "context")), "query_id").where(
        ~F.map_contains_key("context", F.col("entry"))
    )
    walks = durable(open_.select(
        "query_id", "source", "path", "entry", "context",
        F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"),
        F.create_map("source", F.col("context")[F.col("source")]).alias("sampled"),
    ))
    ends = walks.limit(0).select("query_id", "draw", "source", "entry", F.lit("").alias("state"))
    hop = 1
    while not walks.isEmpty():
        walks = durable(_step(walks, network, hop, seed))
        at_end = F.size("path") == hop + 1
        ends = ends.unionByName(walks.where(at_end).select(
            "query_id", "draw", "source", "entry", F.col("sampled")[F.col("entry")].alias("state")
        ))
        walks = walks.where(~at_end)
        hop += 1
    lot = hash_unit(F.col("query_id"), F.col("draw"), F.col("entry"), F.col("source"), seed)
    entered = durable(ends).groupBy("query_id", "draw", "entry").agg(F.min_by("state", lot).alias("state"))
    added = entered.groupBy("query_id", "draw").agg(
        F.map_from_entries(F.collect_list(F.struct("entry", "state"))).alias("added")
    )
    with_path = by_shuffle(open_.select("query_id").distinct())
    every = known.join(with_path, "query_id").select(
        "query_id", "target", "context", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")
    )
    drawn = every.join(by_shuffle(added), ["query_id", "draw"], "left").select(
        F.struct("query_id", "draw").alias("query_id"), "target",
        F.when(F.col("added").isNull(), F.col("context"))
        .otherwise(F.map_concat("context", F.col("added"))).alias("context"),
    )
    plain = asked.join(with_path, "query_id", "left_anti").select(
        F.struct("query_id", F.lit(0).alias("draw")).alias("query_id"), "target", "context"
    )
    answers = posterior(drawn.unionByName(plain), network)
    long = answers.select(F.col("query_id.query_id").alias("query_id"), F.explode("dist").alias("state", "p"))
    averaged = long.groupBy("query_id", "state").agg(F.avg("p").alias("p")).groupBy("query_id").agg(
        F.map_from_entries(F.collect_list(F.struct("state", "p"))).alias("dist")
    )
    return asked.select("query_id", "target").join(by_shuffle(averaged), "query_id", "left")


def _step(walks: DataFrame, network: Network, hop: int, seed: int) -> DataFrame:
    """Sample the node at position ``hop`` of every walk; walks that cannot are dropped.

    Entry nodes are never observed, but nodes before them may be: those keep their value.
    """
    walks = walks.withColumn("node", F.get("path", hop))
    hard = walks.where(F.map_contains_key("context", F.col("node"))).withColumn(
        "state", F.col("context")[F.col("node")]
    )
    soft = walks.where(~F.map_contains_key("context", F.col("node")))
    new = F.map_filter("sampled", lambda k, v: ~F.map_contains_key("context", k))
    members = F.create_map(*[
        x for n in network.nodes
        for x in (F.lit(n), F.array(*[F.lit(m) for m in sorted(network.members(n))]))
    ])
    asked = soft.select(
        F.struct("query_id", "draw", "source").alias("query_id"), F.col("node").alias("target"),
        F.map_concat("context", new).alias("context"),
    )
    useful = F.exists(F.map_keys("context"), lambda k: F.array_contains(members[F.col("target")], k))
    answers = posterior(asked.where(useful), network)
    u = hash_unit(F.col("query_id.query_id"), F.col("query_id.draw"), F.col("query_id.source"), hop, seed)
    picked = answers.where(F.col("dist").isNotNull()).withColumn("u", u)
    picked = picked.withColumn("state", pick_state(F.col("dist"), F.col("u"))).select("query_id.*", "state")
    soft = soft.join(by_shuffle(picked), ["query_id", "draw", "source"])
    moved = hard.unionByName(soft.select(hard.columns))
    merged = F.map_concat(
        F.map_filter("sampled", lambda k, v: k != F.col("node")), F.create_map("node", "state")
    )
    return moved.withColumn("sampled", merged).drop("node", "state")
