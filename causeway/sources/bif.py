"""Network files in the Bayesian interchange format, one row per file.

Files are parsed with built-in string functions, so a folder of networks parses in
parallel and nothing is gathered on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.session import collect_bounded

# The blocks of the format.
VARIABLE = r"(?s)variable\s+(\S+)\s*\{\s*type\s+discrete\s*\[\s*\d+\s*\]\s*\{([^}]*)\}"
PROBABILITY = r"(?s)probability\s*\(\s*([^)]*?)\s*\)\s*\{([^}]*)\}"
TABLE = r"(?s)\btable\s+([^;]*);"
DEFAULT = r"(?s)\bdefault\s+([^;]*);"
ROW = r"\(([^)]*)\)\s*([^;]*);"


def _list(text) -> F.Column:
    return F.transform(F.split(F.trim(text), r"\s*,\s*"), lambda s: F.trim(s))


def read_networks(spark: SparkSession, path: str) -> DataFrame:
    """(network, text): whole files."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("network"), F.col("value").alias("text")
    )


def network_nodes(networks: DataFrame) -> DataFrame:
    """(network, node_ord, node, states)."""
    names = F.regexp_extract_all("text", F.lit(VARIABLE), F.lit(1))
    states = F.regexp_extract_all("text", F.lit(VARIABLE), F.lit(2))
    pairs = F.zip_with(names, states, lambda n, s: F.struct(n.alias("node"), _list(s).alias("states")))
    return networks.select("network", F.posexplode(pairs).alias("node_ord", "v")).select(
        "network", "node_ord", "v.node", "v.states"
    )


def network_blocks(networks: DataFrame) -> DataFrame:
    """(network, node, parents, body) of each probability block."""
    heads = F.regexp_extract_all("text", F.lit(PROBABILITY), F.lit(1))
    bodies = F.regexp_extract_all("text", F.lit(PROBABILITY), F.lit(2))
    blocks = F.zip_with(heads, bodies, lambda h, b: F.struct(h.alias("head"), b.alias("body")))
    listed = networks.select("network", F.explode(blocks).alias("b"))
    head = F.split(F.col("b.head"), r"\s*\|\s*")
    parents = F.when(F.size(head) > 1, _list(head[1])).otherwise(F.array().cast("array<string>"))
    return listed.select("network", F.trim(head[0]).alias("node"), parents.alias("parents"),
                         F.col("b.body").alias("body"))


def network_edges(networks: DataFrame) -> DataFrame:
    """(network, parent, child)."""
    return network_blocks(networks).select("network", F.explode("parents").alias("parent"), F.col("node").alias("child"))


def network_cpt(networks: DataFrame) -> DataFrame:
    """(network, node, parents, cfg, state, p); parents in file order.

    ``cfg`` is NULL for a default row. A plain table over parents is not split up.
    """
    rows = F.zip_with(
        F.regexp_extract_all("body", F.lit(ROW), F.lit(1)), F.regexp_extract_all("body", F.lit(ROW), F.lit(2)),
        lambda c, p: F.struct(_list(c).alias("cfg"), _list(p).alias("probs")),
    )
    def single(pattern: str, cfg) -> F.Column:
        found = F.regexp_extract("body", pattern, 1)
        one = F.array(F.struct(cfg.alias("cfg"), _list(found).alias("probs")))
        return F.when(found != "", one).otherwise(F.array().cast("array<struct<cfg:array<string>,probs:array<string>>>"))

    none = F.array().cast("array<string>")
    all_rows = F.concat(rows, single(TABLE, none), single(DEFAULT, F.lit(None).cast("array<string>")))
    blocks = network_blocks(networks).join(network_nodes(networks).select("network", "node", "states"), ["network", "node"])
    long = blocks.select("network", "node", "parents", "states", F.explode(all_rows).alias("r"))
    return long.select(
        "network", "node", "parents", F.col("r.cfg").alias("cfg"),
        F.explode(F.arrays_zip("states", F.col("r.probs").alias("probs"))).alias("z"),
    ).select("network", "node", "parents", "cfg", F.col("z.states").alias("state"), F.col("z.probs").cast("double").alias("p"))


def network_text(nodes: DataFrame, cpt: DataFrame) -> DataFrame:
    """(network, text): the format's text from (network, node_ord, node, states) and
    (network, node, parents, cfg, states, probs)."""
    variable = F.concat(
        F.lit("variable "), "node", F.lit(" {\n  type discrete [ "), F.size("states").cast("string"),
        F.lit(" ] { "), F.array_join("states", ", "), F.lit(" };\n}\n"),
    )
    numbers = F.array_join(F.transform("probs", lambda p: p.cast("string")), ", ")
    line = F.when(F.size("cfg") == 0, F.concat(F.lit("  table "), numbers, F.lit(";\n"))).otherwise(
        F.concat(F.lit("  ("), F.array_join("cfg", ", "), F.lit(") "), numbers, F.lit(";\n"))
    )
    bodies = cpt.groupBy("network", "node", "parents").agg(
        F.array_join(F.array_sort(F.collect_list(line)), "").alias("body")
    )
    head = F.when(F.size("parents") == 0, F.col("node")).otherwise(
        F.concat("node", F.lit(" | "), F.array_join("parents", ", "))
    )
    joined = nodes.join(bodies, ["network", "node"]).select(
        "network", "node_ord", variable.alias("variable"),
        F.concat(F.lit("probability ( "), head, F.lit(" ) {\n"), "body", F.lit("}\n")).alias("block"),
    )
    parts = joined.groupBy("network").agg(F.array_sort(F.collect_list(F.struct("node_ord", "variable", "block"))).alias("p"))
    return parts.select("network", F.concat(
        F.lit("network unknown {\n}\n"),
        F.array_join(F.transform("p", lambda s: s["variable"]), ""),
        F.array_join(F.transform("p", lambda s: s["block"]), ""),
    ).alias("text"))


def write_networks(texts: DataFrame, path: str) -> None:
    """One folder per network; an existing path is an error."""
    texts.write.partitionBy("network").option("lineSep", "\n").text(path)


def load_network(networks: DataFrame, name: str):
    """A fitted network from one parsed file, ready for queries and sampling."""
    from causeway.plans.network import Network
    from causeway.session import durable

    mine = networks.where(F.col("network") == name)
    nodes = collect_bounded(network_nodes(mine).orderBy("node_ord"), "nodes")
    edges = tuple(sorted((r["parent"], r["child"]) for r in collect_bounded(network_edges(mine), "edges")))
    states = {r["node"]: sorted(r["states"]) for r in nodes}
    # parents by name and states in order, as everywhere else
    order = F.array_sort(F.zip_with("parents", "cfg", lambda p, c: F.struct(p.alias("p"), c.alias("c"))))
    long = network_cpt(mine).where(F.col("cfg").isNotNull()).select(
        "node", F.transform(order, lambda s: s["c"]).alias("cfg"), "state", "p"
    )
    names = [r["node"] for r in nodes]
    ids = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    grouped = long.groupBy("node", "cfg").agg(F.array_sort(F.collect_list(F.struct("state", "p"))).alias("z"))
    cpts = durable(grouped.select(
        ids[F.col("node")].alias("family_id"), "node", "cfg",
        F.transform("z", lambda s: s["state"]).alias("states"), F.transform("z", lambda s: s["p"]).alias("probs"),
    ))
    rows = cpts.select("family_id", "node", "cfg", F.explode(F.arrays_zip("states", "probs")).alias("z")).select(
        "family_id", "node", F.concat("cfg", F.array("z.states")).alias("key"), F.col("z.probs").alias("p")
    )
    return Network(tuple(names), edges, states, cpts, durable(rows))


def rank_rows(df: DataFrame) -> DataFrame:
    """Number nodes of each network by name: (network, node_ord, ..)."""
    return df.withColumn("node_ord", F.row_number().over(Window.partitionBy("network").orderBy("node")))
