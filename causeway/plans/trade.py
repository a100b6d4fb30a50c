"""Vote log and graphs over nations, derived from every line item.

Each order day is a sample. The nations seen that day, as a customer's or a supplier's,
are its columns; a net flow of lines from one nation's suppliers to another's customers
is a voted edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.operators import votes
from causeway.plans.workloads import table
from causeway.session import collect_bounded, spread

CUTOFF = 0.05
SPLIT = 1277  # days before and after 1998-07-01


def daily_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(sample_id, s, c, n): lines per day, supplier nation and customer nation."""
    nation = table(spark, sf, "nation")
    lines = spread(table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey"))
    return (
        lines.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy(F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).alias("sample_id"),
                 "s_nationkey", "c_nationkey")
        .agg(F.count("*").alias("n"))
        .join(nation.select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("s")), "s_nationkey")
        .join(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("c")), "c_nationkey")
        .select("sample_id", "s", "c", "n")
    )


def vote_log(lines: DataFrame) -> DataFrame:
    """(sample_id, edge_ord, parent, child)."""
    back = lines.select("sample_id", F.col("c").alias("s"), F.col("s").alias("c"), F.col("n").alias("m"))
    net = lines.where(F.col("s") != F.col("c")).join(back, ["sample_id", "s", "c"], "left").where(
        F.col("n") > F.coalesce("m", F.lit(0))
    )
    order = Window.partitionBy("sample_id").orderBy("s", "c")
    return net.select("sample_id", F.row_number().over(order).alias("edge_ord"),
                      F.col("s").alias("parent"), F.col("c").alias("child"))


def day_plan(lines: DataFrame) -> DataFrame:
    """(sample_id, cols): nations of each day."""
    return lines.select("sample_id", F.explode(F.array("s", "c")).alias("x")).groupBy("sample_id").agg(
        F.collect_set("x").alias("cols")
    )


def nations(spark: SparkSession, sf: str) -> list[str]:
    return sorted(r["n_name"] for r in collect_bounded(table(spark, sf, "nation"), "nations"))


def node_frame(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(F.col("n_name").alias("node"))


def best_parents(resolved: DataFrame, k: int, acyclic: bool) -> DataFrame:
    """Up to k most voted parents per child; with ``acyclic`` only smaller names."""
    kept = resolved.where(F.col("parent") < F.col("child")) if acyclic else resolved
    return votes.rank_parents(kept).where(F.col("rank") <= k).select("parent", "child")


def graph(spark: SparkSession, sf: str, k: int = 2, acyclic: bool = True,
          part: str | None = None) -> DataFrame:
    """Edges (parent, child) of all days, or of those before / after the split day."""
    lines = daily_lines(spark, sf)
    if part is not None:
        early = F.col("sample_id") < SPLIT
        lines = lines.where(early if part == "early" else ~early)
    resolved = votes.resolve_direction(votes.vote_counts(vote_log(lines)))
    return best_parents(resolved, k, acyclic)


LINES_SQL = """lines AS (
  SELECT date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS sample_id,
         sn.n_name AS s, cn.n_name AS c, count(*) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey
  JOIN nation cn ON c_nationkey = cn.n_nationkey GROUP BY ALL)"""


def votes_sql(tag: str = "", where: str = "TRUE") -> str:
    """CTEs log, voted and resolved (with a suffix) over the days that pass ``where``."""
    return f"""log{tag} AS (
  SELECT a.sample_id, row_number() OVER (PARTITION BY a.sample_id ORDER BY a.s, a.c) AS edge_ord,
         a.s AS parent, a.c AS child
  FROM lines a LEFT JOIN lines b ON a.sample_id = b.sample_id AND a.s = b.c AND a.c = b.s
  WHERE a.s <> a.c AND a.n > coalesce(b.n, 0) AND a.{where}),
voted{tag} AS (
  SELECT child, parent, count(*) AS n, min(min((sample_id, edge_ord))) OVER (PARTITION BY child) AS fc
  FROM log{tag} GROUP BY child, parent),
resolved{tag} AS (
  SELECT a.* FROM voted{tag} a LEFT JOIN voted{tag} b ON a.parent = b.child AND a.child = b.parent
  WHERE a.n > coalesce(b.n, 0) OR (a.n = b.n AND a.fc > b.fc))""".replace("a.TRUE", "TRUE")


COOC_SQL = """seen AS (SELECT DISTINCT sample_id, s AS x FROM lines UNION SELECT DISTINCT sample_id, c FROM lines),
cooc AS (SELECT p.x AS a, q.x AS b, count(*) AS n FROM seen p JOIN seen q
  ON p.sample_id = q.sample_id AND p.x <> q.x GROUP BY ALL)"""


def graph_sql(name: str, k: int = 2, acyclic: bool = True, tag: str = "") -> str:
    """CTE with the edges of ``best_parents`` over resolved<tag>."""
    keep = "WHERE parent < child" if acyclic else ""
    return f"""{name} AS (SELECT parent, child FROM (SELECT *, row_number() OVER (
  PARTITION BY child ORDER BY n DESC, parent) AS rk FROM resolved{tag} {keep}) WHERE rk <= {k})"""


DAG_SQL = f"WITH RECURSIVE {LINES_SQL}, {votes_sql()}, {graph_sql('dag')}"
CYCLIC_SQL = f"WITH RECURSIVE {LINES_SQL}, {votes_sql()}, {graph_sql('dag', acyclic=False)}"
