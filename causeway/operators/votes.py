"""Edge votes of many sub-searches: counting, filtering, direction and ranking."""

from __future__ import annotations

from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.mathx import bernoulli_entropy
from causeway.operators.ranks import global_rank

DENSE_VARIABLES = 2048


def vote_counts(edges: DataFrame, run: Sequence[str] = ()) -> DataFrame:
    """(run.., child, parent, n, first_child) from edges (sample_id, edge_ord, parent, child).

    ``first_child`` is where the child first appears as a child; it breaks direction ties.
    """
    votes = edges.groupBy(*run, "child", "parent").agg(
        F.count("*").alias("n"), F.min(F.struct("sample_id", "edge_ord")).alias("first")
    )
    by_child = Window.partitionBy(*run, "child")
    return votes.withColumn("first_child", F.min("first").over(by_child)).drop("first")


def cooccurrence(plan: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, n): in how many samples both columns took part, whether or not joined by an edge.

    ``plan`` has one row per sample with its ``cols``. Each task multiplies its own 0/1
    incidence matrix with its transpose; only the resulting counts are shuffled.
    """
    columns = list(columns)
    index = {c: i for i, c in enumerate(columns)}
    p = len(columns)

    def dense(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((p, p), dtype=np.int64)
        for pdf in batches:
            x = np.zeros((len(pdf), p), dtype=np.float32)
            for i, cols in enumerate(pdf["cols"]):
                x[i, [index[c] for c in cols if c in index]] = 1
            total += np.rint(x.T @ x).astype(np.int64)
        np.fill_diagonal(total, 0)
        a, b = np.nonzero(total)
        yield pd.DataFrame({"i": a, "j": b, "n": total[a, b]})

    def sparse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cells = []
            for cols in pdf["cols"]:
                ids = np.unique([index[c] for c in cols if c in index]).astype(np.int64)
                cells.append((ids[:, None] * p + ids[None, :]).ravel())
            if cells:
                cell, n = np.unique(np.concatenate(cells), return_counts=True)
                yield pd.DataFrame({"i": cell // p, "j": cell % p, "n": n})

    names = F.array(*[F.lit(c) for c in columns])
    return (
        plan.select("cols")
        .mapInPandas(dense if p <= DENSE_VARIABLES else sparse, "i int, j int, n bigint")
        .where(F.col("i") != F.col("j"))
        .groupBy("i", "j").agg(F.sum("n").alias("n"))
        .select(names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), "n")
    )


def accumulate(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Sum counts of several passes."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy(*keys).agg(F.sum("n").alias("n"))


def with_support(votes: DataFrame, cooc: DataFrame) -> DataFrame:
    """Attach co-occurrence ``cooc`` (0 if absent) and ``freq`` (NULL without any)."""
    pairs = cooc.select(F.col("a").alias("child"), F.col("b").alias("parent"), F.col("n").alias("cooc"))
    return votes.join(pairs, ["child", "parent"], "left").withColumn(
        "cooc", F.coalesce("cooc", F.lit(0).cast("bigint"))
    ).withColumn("freq", F.try_divide(F.col("n"), F.col("cooc")))


def frequency_cutoff(votes: DataFrame, cooc: DataFrame, cutoff: float) -> DataFrame:
    """Drop votes below the cutoff rate or never co-sampled; cutoff 0 keeps everything."""
    if not cutoff:
        return votes
    return with_support(votes, cooc).where(F.col("freq") >= cutoff).drop("cooc", "freq")


def resolve_direction(votes: DataFrame) -> DataFrame:
    """Keep the direction with more votes.

    On a tie the edge survives whose child first appeared later as a child; without
    ordinals the smaller parent name wins.
    """
    other = votes.select(
        F.col("parent").alias("child"), F.col("child").alias("parent"), F.col("n").alias("m"),
        *([F.col("first_child").alias("other_first")] if "first_child" in votes.columns else []),
    )
    joined = votes.join(other, ["child", "parent"], "left")
    if "first_child" in votes.columns:
        tie = F.col("first_child") > F.col("other_first")
        joined_keep = (F.col("n") > F.coalesce("m", F.lit(0))) | ((F.col("n") == F.col("m")) & tie)
    else:
        joined_keep = (F.col("n") > F.coalesce("m", F.lit(0))) | (
            (F.col("n") == F.col("m")) & (F.col("parent") < F.col("child"))
        )
    return joined.where(joined_keep & (F.col("n") > 0)).select(votes.columns)


def rank_parents(votes: DataFrame, corr: DataFrame | None = None) -> DataFrame:
    """Add ``rank`` per child: by signed correlation if given, else by votes; then name."""
    ranked = votes
    if corr is not None:
        ranked = votes.join(
            corr.select(F.col("a").alias("child"), F.col("b").alias("parent"), "corr"),
            ["child", "parent"], "left",
        )
    score = F.col("corr").desc_nulls_last() if corr is not None else F.col("n").desc()
    order = Window.partitionBy("child").orderBy(score, "parent")
    return ranked.withColumn("rank", F.row_number().over(order))


def parent_appearance(votes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, total): votes a node collected as a parent; zero for the others."""
    totals = votes.groupBy(F.col("parent").alias("node")).agg(F.sum("n").alias("total"))
    return nodes.select("node").distinct().join(totals, "node", "left").select(
        "node", F.coalesce("total", F.lit(0).cast("bigint")).alias("total")
    )


def node_order(appearance: DataFrame) -> DataFrame:
    """Add ``position``: frequent parents first, then by name (one row per variable)."""
    ranked = global_rank(appearance, [F.desc("total"), F.asc("node")], "position")
    return ranked.withColumn("position", (F.col("position") + 1).cast("int"))


def uncertain_edges(votes: DataFrame, cooc: DataFrame, threshold: float,
                    min_cooc: int) -> DataFrame:
    """Edges whose rate has an entropy above the threshold, with both orderings.

    ``edge_rank`` orders a node's edges, ``node_rank`` the nodes by their top entropy.
    """
    rated = (
        with_support(votes, cooc)
        .where((F.col("n") > 0) & (F.col("cooc") >= min_cooc))
        .withColumn("entropy", bernoulli_entropy(F.col("freq")))
        .where(F.col("entropy") > threshold)
    )
    by_child = Window.partitionBy("child")
    top = rated.withColumn("top", F.max("entropy").over(by_child)).withColumn(
        "edge_rank", F.row_number().over(by_child.orderBy(F.desc("entropy"), "parent"))
    )
    nodes = rated.groupBy("child").agg(F.max("entropy").alias("_top"))
    nodes = global_rank(nodes, [F.desc("_top"), F.asc("child")], "_rank")
    return top.join(nodes.select("child", (F.col("_rank") + 1).cast("int").alias("node_rank")), "child")


def trigger_entropy(uncertain: DataFrame) -> DataFrame:
    """(a, b, entropy): highest entropy seen per unordered pair, a < b."""
    return uncertain.groupBy(
        F.least("parent", "child").alias("a"), F.greatest("parent", "child").alias("b")
    ).agg(F.max("entropy").alias("entropy"))


def trajectory(votes: DataFrame, cooc: DataFrame, pre_votes: DataFrame, pre_cooc: DataFrame,
               trigger: DataFrame) -> DataFrame:
    """Evidence of each candidate before and after targeted sampling."""
    zero = F.lit(0).cast("bigint")
    keys = ["child", "parent"]
    pre = pre_votes.select(*keys, F.col("n").alias("pre_n"))
    pre_c = pre_cooc.select(F.col("a").alias("child"), F.col("b").alias("parent"),
                            F.col("n").alias("pre_cooc"))
    joined = (
        with_support(votes.select(*keys, "n"), cooc)
        .join(pre, keys, "left").join(pre_c, keys, "left")
        .withColumn("a", F.least(*keys)).withColumn("b", F.greatest(*keys))
        .join(trigger, ["a", "b"], "left")
    )
    pre_n, pre_k = F.coalesce("pre_n", zero), F.coalesce("pre_cooc", zero)
    return joined.select(
        *keys, "n", "cooc", "freq", "entropy", pre_n.alias("pre_n"), pre_k.alias("pre_cooc"),
        F.greatest(zero, F.col("n") - pre_n).alias("post_n"),
        F.greatest(zero, F.col("cooc") - pre_k).alias("post_cooc"),
    )


def advice_order(votes: DataFrame, advice: DataFrame, cooc: DataFrame, cutoff: float,
                 fallback: DataFrame) -> DataFrame:
    """Ranked parents: advised ones first in advised order, the rest by votes.

    ``advice`` is (child, names array); a child whose answer had no list has no row there
    and takes its ranks from ``fallback``. The cutoff applies only to the unadvised rest.
    """
    named = advice.select("child", F.posexplode("names").alias("advised", "parent")).groupBy(
        "child", "parent"
    ).agg(F.min("advised").alias("advised"))
    supported = with_support(votes.where(F.col("n") > 0), cooc)
    joined = supported.join(advice.select("child").distinct(), "child", "left_semi").join(
        named, ["child", "parent"], "left"
    )
    if cutoff > 0:
        joined = joined.where(F.col("advised").isNotNull() | (F.col("freq") >= cutoff))
    order = Window.partitionBy("child").orderBy(
        F.col("advised").asc_nulls_last(), F.desc("n"), "parent"
    )
    ranked = joined.select(
        "child", "parent", "n", F.col("advised").isNotNull().alias("endorsed"),
        F.row_number().over(order).alias("rank"),
    )
    rest = fallback.join(advice.select("child").distinct(), "child", "left_anti").select(
        "child", "parent", "n", F.lit(True).alias("endorsed"), "rank"
    )
    return ranked.unionByName(rest)


def ordering_summary(ranked: DataFrame) -> DataFrame:
    """Children, children with an unendorsed tail, tail size in total and on average."""
    per_child = ranked.groupBy("child").agg(F.count_if(~F.col("endorsed")).alias("tail"))
    return per_child.agg(
        F.count("*").alias("children"),
        F.count_if(F.col("tail") > 0).alias("children_with_tail"),
        F.coalesce(F.sum("tail"), F.lit(0)).alias("tail_total"),
        F.try_divide(F.sum("tail"), F.count("*")).alias("tail_per_child"),
    )


def near_miss(ranked: DataFrame, dag: DataFrame, cooc: DataFrame) -> DataFrame:
    """Ranked edges that were not placed, with support and display order."""
    missed = ranked.join(dag.select("parent", "child"), ["parent", "child"], "left_anti")
    rated = with_support(missed.select("child", "parent", "n"), cooc).withColumn(
        "support", F.coalesce("freq", F.lit(0.0))
    )
    placed = global_rank(rated.drop("freq"), [F.desc("support"), F.asc("parent"), F.asc("child")], "position")
    return placed.withColumn("position", (F.col("position") + 1).cast("int"))


def support_text(n: Column, cooc: Column) -> Column:
    """Edge support for display."""
    shown = F.format_string("%.2f (%d/%d co-sampled searches)", n / F.nullif(cooc, F.lit(0)), n, cooc)
    return F.when(cooc > 0, shown).otherwise(F.lit("never co-sampled"))


def percent_text(n: Column, d: Column) -> Column:
    shown = F.format_string("%.1f%%", n * 100.0 / F.nullif(d, F.lit(0)))
    return F.when(d > 0, shown).otherwise(F.lit("n/a"))


def edge_digest(edges: DataFrame, stage: str) -> DataFrame:
    """(stage, edges, digest): size and short sha256 of the sorted unique edge list.

    The list holds variables' edges only (at most p squared).
    """
    pairs = edges.select(stage, F.array("parent", "child").alias("pair")).distinct()
    text = F.to_json(F.array_sort(F.collect_list("pair")))
    return pairs.groupBy(stage).agg(
        F.count("*").alias("edges"), F.substring(F.sha2(text, 256), 1, 10).alias("digest")
    )


def symmetric_pairs(pairs: DataFrame) -> DataFrame:
    """Distinct pairs in both orders, without self pairs."""
    return (
        pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .where(F.col("a") != F.col("b")).distinct()
    )
