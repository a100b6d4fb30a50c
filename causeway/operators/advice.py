"""Requests to an outside advisor and its answers, as tables.

A request is rendered in Spark, keyed by a hash of everything that determines the answer
and joined with the stored responses. Only misses go to a responder, if there is one.
"""

from __future__ import annotations

from typing import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.config import RequestSettings
from causeway.operators.votes import percent_text, support_text
from causeway.plans.prompts import system_text

Responder = Callable[[pd.DataFrame], pd.DataFrame]
USAGE = "struct<prompt_tokens: bigint, cached_prompt_tokens: bigint, completion_tokens: bigint, total_tokens: bigint>"
ANSWER = f"key string, content string, truncated boolean, usage {USAGE}"
NL = "\n"


class CallBudgetExceeded(RuntimeError):
    """More unanswered requests than the budget allows."""


def request_key(settings: RequestSettings, system: Column, user: Column) -> Column:
    """sha256 of the canonical JSON of the request; fields in name order."""
    payload = F.struct(
        F.lit(settings.effort).cast("string").alias("effort"),
        F.lit(settings.max_tokens).alias("max_tokens"),
        F.array(
            F.struct(system.alias("content"), F.lit("system").alias("role")),
            F.struct(user.alias("content"), F.lit("user").alias("role")),
        ).alias("messages"),
        F.lit(settings.model).alias("model"),
        F.lit(settings.temperature).cast("double").alias("temperature"),
    )
    return F.sha2(F.to_json(payload, {"ignoreNullFields": "false"}), 256)


def as_requests(rendered: DataFrame, op: str, settings: RequestSettings) -> DataFrame:
    """Add op, system text and key to rendered (.., user) rows."""
    system = F.lit(system_text(op))
    return rendered.withColumn("op", F.lit(op)).withColumn("system", system).withColumn(
        "key", request_key(settings, F.col("system"), F.col("user"))
    )


def split_requests(requests: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits with content and usage, misses): one look-up join on the key."""
    hits = requests.join(store.select("key", "content", "usage"), "key")
    return hits, requests.join(store.select("key"), "key", "left_anti")


def check_budget(misses: DataFrame, made: int, max_calls: int) -> int:
    """Calls after these misses; equal requests count once. Raises beyond the budget."""
    total = made + misses.select("key").distinct().count()
    if total > max_calls:
        raise CallBudgetExceeded(f"{total} calls, but only {max_calls} are allowed")
    return total


def ask(misses: DataFrame, responder: Responder) -> DataFrame:
    """Answers of a responder to distinct requests, batch by batch on the executors."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield responder(pdf)

    return misses.select("key", "op", "system", "user").dropDuplicates(["key"]).mapInPandas(run, ANSWER)


def storable(answers: DataFrame) -> DataFrame:
    """Truncated answers are used but never stored."""
    return answers.where(~F.coalesce("truncated", F.lit(False))).select("key", "content", "usage")


def upsert(store: DataFrame, fresh: DataFrame, order: str = "seq") -> DataFrame:
    """Union of two response tables with the latest row per key."""
    latest = store.unionByName(fresh).groupBy("key").agg(
        F.max_by(F.struct(*[c for c in store.columns if c != "key"]), order).alias("r")
    )
    return latest.select("key", "r.*")


def description_block(items: DataFrame, key: str, names: str, dictionary: DataFrame) -> DataFrame:
    """(key, block): sorted descriptions of the described variables in ``names``."""
    listed = items.select(key, F.explode(F.array_distinct(names)).alias("var")).join(
        dictionary.select("var", "description"), "var"
    )
    line = F.struct("var", F.concat(F.lit("- "), "var", F.lit(": "), "description").alias("line"))
    lines = listed.groupBy(key).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    text = F.concat(F.lit("Variables:\n"), F.array_join(F.transform("lines", lambda s: s["line"]), NL), F.lit(NL))
    return items.select(key).distinct().join(lines, key, "left").select(
        key, F.coalesce(text, F.lit("")).alias("block")
    )


def text(*parts: Column | str) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def _ordered_lines(df: DataFrame, key: str, order: list, line: Column) -> DataFrame:
    """(key, lines): one text of lines per key; a key has at most one line per variable."""
    item = F.struct(*order, line.alias("line"))
    return df.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items")).select(
        key, F.array_join(F.transform("items", lambda s: s["line"]), NL).alias("lines")
    )


def render_grouping(blocks: DataFrame) -> DataFrame:
    """(node, user) from (node, block)."""
    return blocks.select("node", text(F.col("block"), "Target: ", F.col("node")).alias("user"))


def render_sampling(uncertain: DataFrame, blocks: DataFrame, shown: int = 20) -> DataFrame:
    """Uncertain candidates of each node with rate and entropy."""
    line = F.format_string("- %s: rate %.2f, entropy %.2f bits", "parent", "freq", "entropy")
    lines = _ordered_lines(uncertain.where(F.col("edge_rank") <= shown), "child", [F.col("edge_rank")], line)
    return lines.join(blocks.withColumnRenamed("node", "child"), "child").select(
        F.col("child").alias("node"),
        text(F.col("block"), "Target: ", F.col("child"), "\nUncertain causes:\n", F.col("lines")).alias("user"),
    )


def candidate_line(with_counts: bool) -> Column:
    """A candidate, with its support and, if it was targeted, the evidence before and after."""
    if not with_counts:
        return text("- ", F.col("parent"))
    base = text(F.col("parent"), ": ", percent_text(F.col("n"), F.col("cooc")),
                F.format_string(" (%d/%d)", "n", "cooc"))
    story = text(
        base, "\n  before: ", percent_text(F.col("pre_n"), F.col("pre_cooc")),
        F.format_string(" (%d/%d), entropy %.2f", "pre_n", "pre_cooc", "entropy"),
        "\n  after: ", percent_text(F.col("post_n"), F.col("post_cooc")),
        F.format_string(" (%d/%d)", "post_n", "post_cooc"),
    )
    return F.when(F.col("entropy").isNull(), base).otherwise(story)


def render_ordering(candidates: DataFrame, blocks: DataFrame, with_counts: bool = True) -> DataFrame:
    """Candidates per child, most voted first; needs the columns of ``votes.trajectory``."""
    lines = _ordered_lines(candidates.where(F.col("n") > 0), "child",
                           [(-F.col("n")).alias("o"), F.col("parent")], candidate_line(with_counts))
    return lines.join(blocks.withColumnRenamed("node", "child"), "child").select(
        "child", text(F.col("block"), "Target: ", F.col("child"), "\nCandidates:\n", F.col("lines")).alias("user")
    )


def render_cycle(conflicts: DataFrame) -> DataFrame:
    """(run_id, parent, child, edges, user): a new edge and the numbered edges that block it."""
    options = F.array_join(F.transform(
        "edges", lambda e, i: F.concat((i + 1).cast("string"), F.lit(". "), e["parent"], F.lit(" -> "), e["child"])
    ), NL)
    return conflicts.select(
        "run_id", "parent", "child", "edges",
        text("New edge: ", F.col("parent"), " -> ", F.col("child"), "\nEdges on the way back:\n", options).alias("user"),
    )


def chosen_edges(numbers: Column, edges: Column) -> Column:
    """Edges picked by number; numbers out of range are ignored, no answer picks nothing."""
    valid = F.filter(F.coalesce(numbers, F.array().cast("array<int>")), lambda i: (i >= 1) & (i <= F.size(edges)))
    return F.transform(valid, lambda i: F.element_at(edges, i))


def edge_lines(edges: DataFrame, with_support: bool) -> DataFrame:
    """(run_id, lines) of edges in name order, with their support (n, cooc) if asked."""
    arrow = text(F.col("parent"), " -> ", F.col("child"))
    line = text(arrow, "  (", support_text(F.col("n"), F.col("cooc")), ")") if with_support else arrow
    return _ordered_lines(edges, "run_id", [F.col("parent"), F.col("child")], line)


def render_refinement(edges: DataFrame, missed: DataFrame | None, block: str) -> DataFrame:
    """(run_id, user): current edges and, with support, the best edges left out."""
    plain = missed is None
    current = edge_lines(edges, not plain)
    if plain:
        return current.select("run_id", text(block, "Edges:\n", F.col("lines")).alias("user"))
    line = text(F.col("parent"), " -> ", F.col("child"), "  (", support_text(F.col("n"), F.col("cooc")), ")")
    left = _ordered_lines(missed, "run_id", [F.col("position")], line).withColumnRenamed("lines", "left")
    return current.join(left, "run_id", "left").select(
        "run_id", text(block, "Edges:\n", F.col("lines"), "\nLeft out:\n",
                       F.coalesce("left", F.lit("(none)"))).alias("user"),
    )


def render_confounders(edges: DataFrame, block: str) -> DataFrame:
    """(child, user): incoming edges of each child with support."""
    line = text("- ", F.col("parent"), " (", support_text(F.col("n"), F.col("cooc")), ")")
    return _ordered_lines(edges, "child", [F.col("parent")], line).select(
        "child", text(block, "Target: ", F.col("child"), "\nIts causes:\n", F.col("lines")).alias("user")
    )


def render_orphans(orphans: DataFrame, block: str, max_parents: int) -> DataFrame:
    return orphans.select("node", text(block, "Target: ", F.col("node"), f"\nAt most {max_parents} names.").alias("user"))


def render_independence(tests: DataFrame) -> DataFrame:
    """Borderline tests (test_id, x, y, s)."""
    given = F.when(F.size("s") > 0, F.array_join("s", ", ")).otherwise("nothing")
    return tests.select("test_id", text("Are ", F.col("x"), " and ", F.col("y"), " independent given ",
                                        given, "?").alias("user"))


def render_edge_check(edges: DataFrame) -> DataFrame:
    return edges.select("parent", "child", text("Does ", F.col("parent"), " cause ", F.col("child"),
                                                "? KEEP it, FLIP it, or REMOVE it.").alias("user"))


def render_orientation(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b", text("Which way: ", F.col("a"), " causes ", F.col("b"), " (1) or ",
                                       F.col("b"), " causes ", F.col("a"), " (0)?").alias("user"))


def render_cycle_edit(cycles: DataFrame) -> DataFrame:
    ring = F.concat(F.col("cycle"), F.slice("cycle", 1, 1))
    return cycles.select("cycle", text("Cycle: ", F.array_join(ring, " -> ")).alias("user"))


def render_variables(catalogue: DataFrame, dictionary: DataFrame) -> DataFrame:
    """One row (user): table of all variables with description and states."""
    line = text("| ", F.col("var"), " | ", F.coalesce("description", F.lit("")), " | ",
                F.array_join("states", ", "), " |")
    listed = catalogue.join(dictionary.select("var", "description"), "var", "left").withColumn("run_id", F.lit(0))
    return _ordered_lines(listed, "run_id", [F.col("var")], line).select("run_id", F.col("lines").alias("user"))


def render_followup(visits: DataFrame, corr: DataFrame | None) -> DataFrame:
    """(node, user): ask for effects of a node, with its correlations if given."""
    asked = visits.select("node", text("Which variables does ", F.col("node"), " cause directly?").alias("user"))
    if corr is None:
        return asked
    line = F.format_string("%s: %.2f", "b", "corr")
    lines = _ordered_lines(corr.where((F.col("a") != F.col("b")) & F.col("corr").isNotNull()), "a", [F.col("b")], line)
    return asked.join(lines.withColumnRenamed("a", "node"), "node", "left").select(
        "node", text(F.col("user"), "\nCorrelations:\n", F.coalesce("lines", F.lit(""))).alias("user")
    )


def answer_network(answers: DataFrame, nodes: DataFrame, parsed: Column) -> DataFrame:
    """(run_id, edge_ord, parent, child) from parsed node lists, cleaned against ``nodes``."""
    listed = answers.select("run_id", F.posexplode(parsed).alias("i", "node"))
    edges = listed.select("run_id", "i", F.col("node.node_name").alias("child"),
                          F.posexplode("node.parents").alias("j", "parent"))
    known = [nodes.select(F.col("node").alias(c)).distinct() for c in ("parent", "child")]
    return (
        edges.where(F.col("parent") != F.col("child"))
        .join(known[0], "parent", "left_semi").join(known[1], "child", "left_semi")
        .groupBy("run_id", "parent", "child").agg(F.min(F.struct("i", "j")).alias("ord"))
        .withColumn("edge_ord", F.row_number().over(Window.partitionBy("run_id").orderBy("ord")))
        .select("run_id", "edge_ord", "parent", "child")
    )


def answer_children(answers: DataFrame, roots: Sequence[str], nodes: DataFrame, names: Column) -> DataFrame:
    """Edges from (run_id, ord, visited, ..) answers that list the effects of a visited node.

    Unknown names, the node itself and roots are passed over; order of visit is kept.
    """
    listed = answers.select("run_id", "ord", F.col("visited").alias("parent"), F.posexplode(names).alias("j", "child"))
    edges = listed.where((F.col("child") != F.col("parent")) & ~F.col("child").isin(list(roots)))
    return (
        edges.join(nodes.select(F.col("node").alias("child")).distinct(), "child", "left_semi")
        .groupBy("run_id", "parent", "child").agg(F.min(F.struct("ord", "j")).alias("o"))
        .withColumn("edge_ord", F.row_number().over(Window.partitionBy("run_id").orderBy("o")))
        .select("run_id", "edge_ord", "parent", "child")
    )


def revise_edges(directed: DataFrame, verdicts: DataFrame) -> DataFrame:
    """KEEP / FLIP / REMOVE applied to a fixed snapshot; edges without a verdict stay."""
    v = F.coalesce("verdict", F.lit("KEEP"))
    joined = directed.join(verdicts, ["parent", "child"], "left").where(v != "REMOVE")
    return joined.select(
        F.when(v == "FLIP", F.col("child")).otherwise(F.col("parent")).alias("parent"),
        F.when(v == "FLIP", F.col("parent")).otherwise(F.col("child")).alias("child"),
    ).distinct()


def orient_pairs(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """Undirected (a, b) with bit 1 become a -> b, with 0 b -> a; without an answer they go."""
    joined = pairs.join(bits, ["a", "b"]).where(F.col("bit").isNotNull())
    return joined.select(
        F.when(F.col("bit") == 1, F.col("a")).otherwise(F.col("b")).alias("parent"),
        F.when(F.col("bit") == 1, F.col("b")).otherwise(F.col("a")).alias("child"),
    )
