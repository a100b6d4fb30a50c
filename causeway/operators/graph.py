"""Graph operators over edge tables (parent, child); sizes depend on variables only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.session import by_shuffle, durable


def flip(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("child").alias("parent"), F.col("parent").alias("child"))


def descendants(dag: DataFrame) -> DataFrame:
    """(node, descendant): transitive closure by doubling the path length each round."""
    closure = durable(dag.select(F.col("parent").alias("node"), F.col("child").alias("descendant")).distinct())
    size = closure.count()
    while True:
        onward = closure.select(F.col("node").alias("descendant"), F.col("descendant").alias("far"))
        longer = closure.join(onward, "descendant").select("node", F.col("far").alias("descendant"))
        closure = durable(closure.union(longer).distinct())
        grown = closure.count()
        if grown == size:
            return closure
        size = grown


def reachable(pairs: DataFrame, dag: DataFrame) -> DataFrame:
    """Add ``reaches`` to (start, end); a node reaches itself."""
    closure = descendants(dag).select(
        F.col("node").alias("start"), F.col("descendant").alias("end"), F.lit(True).alias("hit")
    )
    return pairs.join(closure, ["start", "end"], "left").select(
        *pairs.columns, (F.coalesce("hit", F.lit(False)) | (F.col("start") == F.col("end"))).alias("reaches")
    )


def _unsettled(edges: DataFrame) -> DataFrame:
    """Edges left after trimming: nodes without a way in or a way out lie on no cycle."""
    size = edges.count()
    while True:
        entered = edges.select(F.col("child").alias("parent")).distinct()
        left = edges.select(F.col("parent").alias("child")).distinct()
        edges = durable(edges.join(entered, "parent", "left_semi").join(left, "child", "left_semi").select("parent", "child"))
        kept = edges.count()
        if kept == size:
            return edges
        size = kept


def strong_components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, component): strongly connected components, named by their smallest node.

    Rounds of trimming and colouring. Each node takes the largest name that reaches it; a node that keeps
    its own name is the root of a component, which is what leads back to it within its colour. Edges
    between colours, and settled nodes, leave the next round. Every round is written, so lineage stays
    short; only counts come to the driver.
    """
    edges = durable(edges.select("parent", "child").distinct())
    every = edges.select(F.explode(F.array("parent", "child")).alias("node"))
    if nodes is not None:
        every = every.unionByName(nodes.select("node"))
    every = durable(every.distinct())
    live = _unsettled(edges.where(F.col("parent") != F.col("child")))
    found: DataFrame | None = None
    while not live.isEmpty():
        colour = durable(live.select(F.explode(F.array("parent", "child")).alias("node")).distinct().withColumn("colour", F.col("node")))
        while True:
            passed = live.join(colour.withColumnRenamed("node", "parent"), "parent").select(F.col("child").alias("node"), "colour")
            grown = passed.groupBy("node").agg(F.max("colour").alias("heard"))
            new = durable(colour.join(grown, "node", "left").select(
                "node", F.greatest("colour", "heard").alias("colour"), (F.col("heard") > F.col("colour")).alias("moved")))
            colour = new.drop("moved")
            if new.where("moved").isEmpty():
                break
        ends = colour.withColumnsRenamed({"node": "parent", "colour": "p_colour"})
        own = live.join(ends, "parent").join(colour.withColumnRenamed("node", "child"), "child").where(F.col("p_colour") == F.col("colour"))
        own = durable(own.select("parent", "child", "colour"))
        settled = durable(colour.where(F.col("node") == F.col("colour")))
        frontier = settled
        while not frontier.isEmpty():
            back = own.join(frontier.select(F.col("node").alias("child")), "child").select(F.col("parent").alias("node"), "colour").distinct()
            frontier = durable(back.join(settled, ["node", "colour"], "left_anti"))
            settled = durable(settled.unionByName(frontier))
        found = settled if found is None else durable(found.unionByName(settled))
        gone = settled.select("node")
        rest = own.join(gone.withColumnRenamed("node", "parent"), "parent", "left_anti").join(
            gone.withColumnRenamed("node", "child"), "child", "left_anti")
        live = _unsettled(durable(rest.select("parent", "child")))
    if found is None:
        return every.select("node", F.col("node").alias("component"))
    names = found.groupBy("colour").agg(F.min("node").alias("component"))
    found = found.join(names, "colour").select("node", "component")
    return every.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """(parent, child): the edges that lie on a directed cycle, loops left out."""
    steps = durable(edges.where(F.col("parent") != F.col("child")).select("parent", "child").distinct())
    inside = durable(strong_components(steps))
    ends = inside.select(F.col("node").alias("parent"), F.col("component").alias("_from"))
    return steps.join(ends, "parent").join(inside.select(F.col("node").alias("child"), "component"), "child").where(
        F.col("_from") == F.col("component")).select("parent", "child")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    touched = edges.select(F.explode(F.array("parent", "child")).alias("node")).distinct()
    return nodes.select("node").distinct().join(touched, "node", "left_anti")


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an incoming edge."""
    return nodes.select("node").distinct().join(
        edges.select(F.col("child").alias("node")).distinct(), "node", "left_anti"
    )


def markov_blankets(dag: DataFrame, nodes: DataFrame) -> DataFrame:
    """(center, node): the node itself, its parents, children and their other parents."""
    kids = dag.select("parent", "child")
    spouses = kids.alias("a").join(kids.alias("b"), F.col("a.child") == F.col("b.child")).where(
        F.col("a.parent") != F.col("b.parent")
    ).select(F.col("a.parent").alias("center"), F.col("b.parent").alias("node"))
    return (
        nodes.select(F.col("node").alias("center"), "node")
        .union(kids.select(F.col("child").alias("center"), F.col("parent").alias("node")))
        .union(kids.select(F.col("parent").alias("center"), F.col("child").alias("node")))
        .union(spouses).distinct()
    )


def induced_edges(blankets: DataFrame, dag: DataFrame) -> DataFrame:
    """(center, parent, child): edges whose two ends lie in the same blanket."""
    members = blankets.select("center", F.col("node").alias("parent"))
    ends = blankets.select("center", F.col("node").alias("child"))
    return dag.select("parent", "child").join(members, "parent").join(
        ends, ["center", "child"], "left_semi"
    ).select("center", "parent", "child")


def simple_paths(pairs: DataFrame, dag: DataFrame) -> DataFrame:
    """(start, end, path, path_ord): all simple directed paths of (start, end), shortest first.

    The number of paths can grow exponentially with the edges; decisions that only need to know
    which edges lie on a path use reachability instead.
    """
    steps = durable(dag.select("parent", "child"))
    frontier = durable(pairs.select("start", "end", F.array("start").alias("path")))
    found = frontier.where(F.col("start") == F.col("end"))
    frontier = frontier.where(F.col("start") != F.col("end"))
    order = Window.partitionBy("start", "end").orderBy(F.size("path"), F.array_join("path", "\u0001"))
    while not frontier.isEmpty():
        grown = durable(frontier.join(steps, F.element_at("path", -1) == F.col("parent")).where(
            ~F.array_contains("path", F.col("child"))
        ).select("start", "end", F.concat("path", F.array("child")).alias("path")))
        done = F.element_at("path", -1) == F.col("end")
        found = found.unionByName(grown.where(done))
        frontier = grown.where(~done)
    return found.withColumn("path_ord", F.row_number().over(order))


def simple_cycles(edges: DataFrame) -> DataFrame:
    """(cycle): all simple directed cycles of length >= 2, starting at their smallest node."""
    steps = durable(cyclic_edges(edges))
    frontier = durable(
        steps.where(F.col("parent") < F.col("child")).select(F.array("parent", "child").alias("path"))
    )
    found = frontier.limit(0).select(F.col("path").alias("cycle"))
    while not frontier.isEmpty():
        grown = durable(
            frontier.join(steps, F.element_at("path", -1) == F.col("parent"))
            .where(F.col("child") >= F.col("path")[0])
            .select("path", "child")
        )
        closing = F.col("child") == F.col("path")[0]
        found = found.union(grown.where(closing).select("path"))
        frontier = grown.where(~F.array_contains("path", F.col("child"))).select(
            F.concat("path", F.array("child")).alias("path")
        )
    return found


def shortest_cycles(edges: DataFrame) -> DataFrame:
    """(cycle): for each edge on a cycle its shortest one, starting at the smallest node, without repeats.

    A breadth-first walk from every edge keeps one path per node reached, so the work is bounded by
    edges times nodes of strongly connected components, and every edge on any cycle is covered.
    """
    steps = durable(cyclic_edges(edges))
    frontier = durable(steps.select(
        F.col("parent").alias("root"), F.col("child").alias("node"), F.array("parent", "child").alias("path"),
        F.concat_ws("\u0001", "parent", "child").alias("edge"),
    ))
    seen = frontier.select("edge", "node")
    closed = frontier.limit(0).select("edge", F.col("path").alias("cycle"))
    while not frontier.isEmpty():
        grown = durable(frontier.join(steps, F.col("node") == F.col("parent")).select("root", "edge", "child", "path"))
        back = grown.where(F.col("child") == F.col("root")).groupBy("edge").agg(F.min("path").alias("cycle"))
        closed = durable(closed.unionByName(back))
        ahead = grown.where(F.col("child") != F.col("root")).groupBy("root", "edge", F.col("child").alias("node")).agg(
            F.min("path").alias("path"))
        frontier = durable(
            ahead.join(closed, "edge", "left_anti").join(seen, ["edge", "node"], "left_anti")
            .select("root", "node", F.concat("path", F.array("node")).alias("path"), "edge")
        )
        seen = durable(seen.unionByName(frontier.select("edge", "node")))
    first = F.array_position("cycle", F.array_min("cycle")).cast("int")
    turned = F.concat(F.slice("cycle", first, F.size("cycle")), F.slice("cycle", F.lit(1), first - 1))
    return closed.select(turned.alias("cycle")).distinct()


def v_structures(dag: DataFrame) -> DataFrame:
    """(a, mid, b), a < b: two parents of one node that are not adjacent themselves."""
    left = dag.select(F.col("parent").alias("a"), F.col("child").alias("mid"))
    right = dag.select(F.col("parent").alias("b"), F.col("child").alias("mid"))
    linked = dag.select(F.least("parent", "child").alias("a"), F.greatest("parent", "child").alias("b"))
    return left.join(right, "mid").where(F.col("a") < F.col("b")).join(
        linked.distinct(), ["a", "b"], "left_anti"
    ).select("a", "mid", "b")


def sepset_colliders(skeleton: DataFrame, sepsets: DataFrame) -> DataFrame:
    """(a, mid, b), a < b: unshielded triples whose middle separates nothing.

    ``skeleton`` is (a, b) with a < b; ``sepsets`` is (a, b, s) with a < b.
    """
    both = skeleton.union(skeleton.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = both.select("a", F.col("b").alias("mid"))
    right = both.select(F.col("a").alias("b"), F.col("b").alias("mid"))
    return (
        left.join(right, "mid").where(F.col("a") < F.col("b"))
        .join(skeleton, ["a", "b"], "left_anti")
        .join(sepsets, ["a", "b"])
        .where(~F.array_contains("s", F.col("mid")))
        .select("a", "mid", "b")
    )


def meek_orient(directed: DataFrame, undirected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Orient (a, b) pairs (a < b) that every extension orients alike, to a fixpoint.

    Each round joins the three rules against the current graph; a round that orients
    nothing ends the loop.
    """
    directed, undirected = durable(directed.select("parent", "child")), durable(undirected.select("a", "b"))
    while True:
        links = undirected.union(undirected.select(F.col("b"), F.col("a"))).toDF("b", "c")
        near = links.toDF("x", "y").union(directed.toDF("x", "y")).union(flip(directed).toDF("x", "y"))
        into = directed.toDF("a", "b")
        chain = into.join(links, "b").where(F.col("a") != F.col("c")).join(
            near.toDF("a", "c"), ["a", "c"], "left_anti"
        ).select("b", "c")
        cycle = links.join(directed.toDF("b", "a"), "b").join(directed.toDF("a", "c"), ["a", "c"]).select("b", "c")
        fork = links.join(links.toDF("b", "d"), "b").join(directed.toDF("d", "c"), ["d", "c"])
        kite = fork.join(fork.withColumnRenamed("d", "e"), ["b", "c"]).where(F.col("d") < F.col("e")).join(
            near.toDF("d", "e"), ["d", "e"], "left_anti"
        ).select("b", "c")
        forced = durable(chain.union(cycle).union(kite).distinct())
        if forced.isEmpty():
            return directed, undirected
        # a pair forced both ways keeps the direction from its smaller node
        pair = forced.select(F.least("b", "c").alias("a"), F.greatest("b", "c").alias("z"), "b", "c")
        one = pair.groupBy("a", "z").agg(F.min(F.struct("b", "c")).alias("e"))
        directed = durable(directed.union(one.select("e.b", "e.c")))
        undirected = durable(
            undirected.join(one.select("a", F.col("z").alias("b")), ["a", "b"], "left_anti")
        )


def open_triple(prev: Column, mid: Column, nxt: Column, collider: Column, mid_seen: Column,
                below_seen: Column) -> Column:
    """Information flows: colliders need an observation at or below, the rest none at all."""
    return F.when(collider, mid_seen | below_seen).otherwise(~mid_seen)


def observed_below(dag: DataFrame, observed: DataFrame, closure: DataFrame | None = None) -> DataFrame:
    """(query_id, node) of nodes with an observed descendant."""
    closure = descendants(dag) if closure is None else closure
    return observed.select("query_id", F.col("node").alias("descendant")).join(
        closure, "descendant"
    ).select("query_id", "node").distinct()


def d_connected(triples: DataFrame, dag: DataFrame, observed: DataFrame,
                closure: DataFrame | None = None) -> DataFrame:
    """Add ``connected`` to (query_id, prev, mid, next), given observed (query_id, node)."""
    one = F.lit(True)
    prev_in = dag.select(F.col("parent").alias("prev"), F.col("child").alias("mid"), one.alias("prev_in"))
    next_in = dag.select(F.col("parent").alias("next"), F.col("child").alias("mid"), one.alias("next_in"))
    seen = observed.select("query_id", F.col("node").alias("mid"), one.alias("seen")).distinct()
    below = observed_below(dag, observed, closure).select("query_id", F.col("node").alias("mid"), one.alias("below"))
    joined = (
        triples.join(prev_in, ["prev", "mid"], "left").join(next_in, ["next", "mid"], "left")
        .join(by_shuffle(seen), ["query_id", "mid"], "left").join(by_shuffle(below), ["query_id", "mid"], "left")
    )
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    ok = open_triple(F.col("prev"), F.col("mid"), F.col("next"), flag("prev_in") & flag("next_in"),
                     flag("seen"), flag("below"))
    return joined.select(*triples.columns, ok.alias("connected"))


def separation_aware_paths(sources: DataFrame, blanket: DataFrame, observed: DataFrame,
                           dag: DataFrame, max_hops: int | None = 3,
                           num_nodes: int | None = None) -> DataFrame:
    """(query_id, source, path): shortest open path from a source into a blanket.

    ``sources`` (query_id, source), ``blanket`` (query_id, node), ``observed`` (query_id,
    node). A breadth-first frontier keyed by (source, node, previous node) grows one hop
    per round; among equally short paths parents come before children, then by name.
    """
    dag = durable(dag.select("parent", "child"))
    closure = descendants(dag)
    steps = durable(
        dag.select(F.col("child").alias("at"), F.col("parent").alias("to"), F.concat(F.lit("0"), "parent").alias("tag"))
        .union(dag.select(F.col("parent"), F.col("child"), F.concat(F.lit("1"), "child")))
    )
    goal = blanket.select("query_id", F.col("node").alias("at"), F.lit(True).alias("goal"))
    keys = ["query_id", "source"]
    frontier = durable(sources.select(
        *keys, F.col("source").alias("at"), F.lit(None).cast("string").alias("prev"),
        F.array("source").alias("path"), F.array().cast("array<string>").alias("trail"),
    ))
    visited = frontier.select(*keys, "at", "prev").limit(0)
    found = frontier.limit(0).select(*keys, "path")
    hops = max_hops if max_hops is not None else (num_nodes or 1_000_000)
    for _ in range(hops):
        grown = frontier.join(steps, "at")
        ends = grown.select(*keys, "path", F.concat("trail", F.array("tag")).alias("trail"),
                            F.col("prev").alias("before"), F.col("at").alias("prev"), F.col("to").alias("at"))
        first = ends.where(F.col("before").isNull())
        later = ends.where(F.col("before").isNotNull())
        triples = later.select(*keys, "path", "trail", F.col("before").alias("prev"),
                               F.col("prev").alias("mid"), F.col("at").alias("next"))
        open_ = d_connected(triples, dag, observed, closure).where("connected")
        later = open_.select(*keys, "path", "trail", F.col("prev").alias("before"),
                             F.col("mid").alias("prev"), F.col("next").alias("at"))
        moved = first.unionByName(later).drop("before")
        moved = moved.join(by_shuffle(visited), [*keys, "at", "prev"], "left_anti")
        moved = moved.groupBy(*keys, "at", "prev").agg(F.min(F.struct("trail", "path")).alias("m")).select(
            *keys, "at", "prev", F.concat("m.path", F.array("at")).alias("path"), F.col("m.trail").alias("trail")
        )
        moved = durable(moved.join(by_shuffle(goal), ["query_id", "at"], "left"))
        hit = moved.where(F.col("goal") & (F.col("at") != F.col("source")))
        hit = hit.groupBy(*keys).agg(F.min(F.struct("trail", "path")).alias("m")).select(*keys, "m.path")
        found = durable(found.unionByName(hit))
        visited = visited.unionByName(moved.select(*keys, "at", "prev"))
        frontier = durable(moved.drop("goal").join(by_shuffle(found.select(*keys)), keys, "left_anti"))
        if frontier.isEmpty():
            break
    return found
