"""Learners over the whole table: greedy equivalence search and constraint-based search."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.config import AnswerConfig, ConstraintConfig, FullSearchConfig
from causeway.functions import text
from causeway.operators import advice, assemble, citest, cube, graph, scores
from causeway.operators.counts import Family, covariance_matrix, distinct_rows
from causeway.operators.encode import Encoded, encode_table, numeric_or_code, state_catalogue
from causeway.plans.search import Pattern, dag_edges, equivalence_search, extend_to_dag
from causeway.session import collect_bounded, durable, local_frame
from causeway.sources.responses import Advisor

Edge = tuple[str, str]
# Families scored by one counting job.
BATCH = 2000
# Tables with at most so many combinations of states are searched by their distinct rows.
GROUPED_SPACE = 1 << 24


def _prepared(df: DataFrame, key: str | None, config) -> tuple[DataFrame, list[str]]:
    columns = [c for c in df.columns if c != key and c not in config.ignore_columns]
    return df.select(*columns), columns


def _few_combinations(encoded: Encoded) -> bool:
    return cube.space(encoded.columns, encoded.cards) <= GROUPED_SPACE


def greedy_search(df: DataFrame, config: FullSearchConfig, key: str | None = None) -> list[Edge]:
    """Greedy equivalence search; every step scores its new families in one Spark job.

    Discrete scores count families over the written code table, or over its distinct rows while the
    states leave few of them, so that a step does not read all rows. Gaussian scores need one
    covariance job, after which all families follow from the p-by-p matrix.
    """
    df, columns = _prepared(df, key, config)
    settings = config.search
    params = settings.parameters
    if settings.score == "bdeu":
        encoded = encode_table(df, columns, pin=False)
        few = _few_combinations(encoded)
        weight = next(f"rows{k}" for k in range(len(columns) + 1) if f"rows{k}" not in columns) if few else None
        codes = distinct_rows(encoded.codes, columns, weight) if few else durable(encoded.codes)
        encoded = replace(encoded, codes=codes)
        ess = float(params.get("ess", 1.0))

        def score(keys):
            out: dict[int, float] = {}
            for start in range(0, len(keys), BATCH):
                families = [
                    Family(i, columns[c], tuple(columns[v] for v in sorted(pa)))
                    for i, (c, pa) in enumerate(keys[start:start + BATCH], start)
                ]
                scored = scores.bdeu_scores(encoded, families, ess, weight).select("family_id", "score")
                out.update({r["family_id"]: r["score"] for r in collect_bounded(scored, "scores")})
            return [out[i] for i in range(len(keys))]

    else:
        cov, n = covariance_matrix(numeric_or_code(df, columns), columns)
        eps = params.get("det_epsilon") if settings.score == "bic_det" else None
        lam = params["lambda_value"]
        forced: list[tuple[str, list[str]]] = []
        if settings.algorithm == "dges":
            forced = scores.linear_dependencies(cov, columns, float(params.get("det_threshold", 1e-5)))

        def score(keys):
            return [scores.gaussian_bic(cov, n, c, sorted(pa), lam, eps) for c, pa in keys]

        # a score that tolerates deterministic relations replaces the plain one for them
        if forced and eps is None:
            plain, hard = score, {columns.index(name) for name, _ in forced}

            def score(keys):  # noqa: F811
                return [
                    scores.gaussian_bic(cov, n, c, sorted(pa), lam, 0.01) if c in hard else v
                    for (c, pa), v in zip(keys, plain(keys))
                ]

    return dag_edges(equivalence_search(len(columns), score, config.max_parents), columns)


def _orient(spark, skeleton: citest.Skeleton) -> tuple[DataFrame, DataFrame]:
    """Colliders from separating sets, then forced orientations: (directed, undirected)."""
    pairs = durable(local_frame(spark, sorted(skeleton.edges), "a string, b string"))
    sets = local_frame(spark, [(a, b, list(s)) for (a, b), s in skeleton.sepsets.items()],
                       "a string, b string, s array<string>")
    triples = graph.sepset_colliders(pairs, sets)
    arrows = triples.select(F.col("a").alias("parent"), F.col("mid").alias("child")).union(
        triples.select("b", "mid")
    ).distinct()
    both = arrows.withColumn("a", F.least("parent", "child")).withColumn("b", F.greatest("parent", "child"))
    # a pair claimed from both ends keeps the arrow from its smaller node
    arrows = durable(both.groupBy("a", "b").agg(F.min(F.struct("parent", "child")).alias("e")).select("a", "b", "e.*"))
    rest = pairs.join(arrows, ["a", "b"], "left_anti")
    return graph.meek_orient(arrows.select("parent", "child"), rest)


def constraint_search(df: DataFrame, config: ConstraintConfig, key: str | None = None) -> list[Edge]:
    """Skeleton by levels, colliders, forced orientations, then one consistent extension."""
    df, columns = _prepared(df, key, config)
    encoded = encode_table(df, columns)
    found = citest.skeleton(encoded, config.alpha, union_sets=False)
    directed, undirected = _orient(df.sparkSession, found)
    names = sorted(columns)
    at = {c: i for i, c in enumerate(names)}
    pattern = Pattern(len(names))
    for row in collect_bounded(directed, "directed edges"):
        pattern.pa[at[row["child"]]].add(at[row["parent"]])
    for row in collect_bounded(undirected, "undirected edges"):
        pattern.nb[at[row["a"]]].add(at[row["b"]])
        pattern.nb[at[row["b"]]].add(at[row["a"]])
    parents = extend_to_dag(pattern)
    if parents is None:
        # no consistent extension: keep directed edges and add the rest in name order
        listed = directed.withColumn("first", F.lit(0)).union(undirected.withColumn("first", F.lit(1)))
        ordered = listed.select(F.lit(0).alias("run_id"), F.concat("first", "parent", "child").alias("edge_ord"),
                                "parent", "child")
        kept = assemble.acyclic_filter(ordered)
        return sorted((r["parent"], r["child"]) for r in collect_bounded(kept, "edges"))
    return dag_edges(parents, names)


def _independence_advisor(advisor: Advisor):
    def scores_of(tests: DataFrame) -> DataFrame:
        answers = advisor.answer(advice.render_independence(tests), "ci_borderline")
        return durable(answers.select("test_id", text.parse_number(F.col("content")).alias("score")))

    return scores_of


def resolve_cycles(edges: DataFrame, advisor: Advisor) -> DataFrame:
    """Up to three rounds of one advised edit per cycle; then each cycle loses its closing edge.

    The cycles asked about are the shortest one through each edge, so none of the edges on a cycle is
    left out and there are no more cycles than edges.
    """
    def numbered(df: DataFrame) -> DataFrame:
        return df.select(F.lit(0).alias("run_id"), F.concat_ws(">", "parent", "child").alias("edge_ord"),
                         "parent", "child")

    for _ in range(3):
        cycles = durable(graph.shortest_cycles(edges))
        if cycles.isEmpty():
            return edges
        answers = advisor.answer(advice.render_cycle_edit(cycles), "cycle_resolve")
        edits = answers.select("cycle", text.parse_cycle_edit(F.col("content"), F.col("cycle")).alias("e")).where(
            F.col("e").isNotNull()
        ).select(F.lit(0).alias("run_id"), F.concat(F.lpad(F.size("cycle").cast("string"), 6, "0"),
                                                     F.array_join("cycle", ">")).alias("ord"),
                 "e.action", F.col("e.a").alias("parent"), F.col("e.b").alias("child"))
        if edits.isEmpty():
            break
        edges = durable(assemble.cycle_edits(numbered(edges), edits).select("parent", "child"))
    while True:
        left = durable(graph.shortest_cycles(edges))
        if left.isEmpty():
            return edges
        closing = left.select(F.element_at("cycle", -1).alias("parent"), F.col("cycle")[0].alias("child"))
        edges = durable(edges.join(closing.distinct(), ["parent", "child"], "left_anti"))


def advised_constraint_search(df: DataFrame, config: ConstraintConfig, advisor: Advisor,
                              key: str | None = None) -> list[Edge]:
    """Constraint-based search that asks about borderline tests, edges, directions and cycles."""
    df, columns = _prepared(df, key, config)
    encoded = encode_table(df, columns)
    edges: DataFrame | None = None
    for _ in range(config.max_iterations):
        found = citest.skeleton(encoded, config.alpha, config.borderline,
                                _independence_advisor(advisor))
        directed, undirected = _orient(df.sparkSession, found)
        checks = advisor.answer(advice.render_edge_check(directed), "edge_check")
        verdicts = checks.select("parent", "child", text.parse_verdict(F.col("content")).alias("verdict"))
        kept = advice.revise_edges(directed, verdicts)
        turns = advisor.answer(advice.render_orientation(undirected), "edge_orient")
        bits = turns.select("a", "b", text.parse_bit(F.col("content")).alias("bit"))
        edges = durable(kept.union(advice.orient_pairs(undirected, bits)).distinct())
        edges = resolve_cycles(edges, advisor)
    return sorted((r["parent"], r["child"]) for r in collect_bounded(edges, "edges"))


def structure_from_document(answers: DataFrame, nodes: DataFrame, config: AnswerConfig) -> DataFrame:
    """(run_id, edge_ord, parent, child) from one JSON answer (run_id, content) per run."""
    edges = advice.answer_network(answers, nodes, text.parse_network(F.col("content")))
    return assemble.acyclic_filter(edges) if config.enforce_acyclic else edges


def visit_search(df: DataFrame, config: AnswerConfig, advisor: Advisor, key: str | None = None,
                 dictionary: DataFrame | None = None) -> list[Edge]:
    """Ask for the roots, then for the effects of every node reached, one batch of requests per level."""
    columns = [c for c in df.columns if c != key and c not in config.ignore_columns]
    spark = df.sparkSession
    known = dictionary if dictionary is not None else local_frame(spark, [], "var string, description string")
    nodes = local_frame(spark, [(c,) for c in columns], "node string")
    asked = advice.render_variables(state_catalogue(df, columns), known)
    root_answer = advisor.answer(asked, "visit_roots").first()["content"] or ""
    level = _named_roots(root_answer, columns)
    visits: list[tuple[int, int, str, str | None]] = []
    met = set(level)
    while level:
        answers = advisor.answer(advice.render_followup(local_frame(spark, [(n,) for n in level], "node string"), None), "visit_effects")
        answers = durable(answers.select("node", "content", text.parse_tagged(F.col("content")).alias("names")))
        got = {r["node"]: r for r in collect_bounded(answers, "answers")}
        order = [n for n in level if n in got]
        visits += [(0, len(visits) + i, n, got[n]["content"]) for i, n in enumerate(order)]
        level = [c for c in dict.fromkeys(c for n in order for c in got[n]["names"] or []) if c in columns and c not in met]
        met.update(level)
    rows = local_frame(spark, visits, "run_id int, ord int, visited string, content string")
    found = structure_from_visits(root_answer, rows, nodes, columns)
    return [(r["parent"], r["child"]) for r in collect_bounded(found, "edges")]


def _named_roots(answer: str, known: list[str]) -> list[str]:
    inner = answer.partition("<Answer>")[2].partition("</Answer>")
    roots = [n.strip() for n in inner[0].split(",") if n.strip() in known] if inner[1] else []
    if not roots:
        raise ValueError("the answer names no known root")
    return roots


def structure_from_visits(root_answer: str, visits: DataFrame, nodes: DataFrame,
                          known: list[str]) -> DataFrame:
    """Edges from one answer naming the roots and one answer per visited node.

    ``visits`` is (run_id, ord, visited, content).
    """
    names = text.parse_tagged(F.col("content"))
    return assemble.acyclic_filter(advice.answer_children(visits, _named_roots(root_answer, known), nodes, names))
