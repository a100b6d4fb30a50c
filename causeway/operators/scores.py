"""Decomposable scores over family counts and covariances."""

from __future__ import annotations

from itertools import combinations
from typing import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.functions.mathx import lgamma
from causeway.operators import cube
from causeway.operators.counts import Family, family_counts, family_frame
from causeway.operators.encode import Encoded
from causeway.session import collect_bounded


def bdeu_from_counts(counts: DataFrame, meta: DataFrame, ess: float = 1.0) -> DataFrame:
    """(family_id, score): BDeu local scores.

    ``q`` counts all parent configurations, occurring or not; cells without rows cancel.
    """
    alpha = F.lit(float(ess)) / F.col("q")
    beta = alpha / F.col("r")
    cells = counts.join(F.broadcast(meta.select("family_id", "r", "q")), "family_id")
    per_config = cells.groupBy(
        "family_id", "r", "q", F.expr("cell div r").alias("config")
    ).agg(
        F.sum("n").alias("nij"),
        F.sum(lgamma(F.col("n") + beta) - lgamma(beta)).alias("gain"),
    )
    return per_config.groupBy("family_id").agg(
        F.sum(F.col("gain") + lgamma(alpha) - lgamma(alpha + F.col("nij"))).alias("score")
    )


def bdeu_scores(encoded: Encoded, families: Sequence[Family], ess: float = 1.0,
                weight: str | None = None) -> DataFrame:
    """BDeu of many families in one counting job: (family_id, node, parents, score).

    With ``weight``, a column of the codes, a row counts so many times.
    """
    spark = encoded.codes.sparkSession
    meta = family_frame(spark, families, encoded.states)
    counts = family_counts(encoded.codes, families, encoded.cards, weight)
    scores = bdeu_from_counts(counts, meta, ess)
    return scores.join(F.broadcast(meta.select("family_id", "node", "parents")), "family_id")


def network_bdeu(encoded: Encoded, nodes: Sequence[str], edges: Sequence[tuple[str, str]],
                 ess: float = 1.0) -> DataFrame:
    """One row (score): nodes without a column, and parents without one, are left out."""
    have = set(encoded.columns)
    families = [
        Family(i, n, tuple(sorted(p for p, c in edges if c == n and p in have)))
        for i, n in enumerate(sorted(set(nodes) & have))
    ]
    return bdeu_scores(encoded, families, ess).agg(F.sum("score").alias("score"))


def gaussian_bic(cov: np.ndarray, n: int, child: int, parents: Sequence[int],
                 lambda_value: float = 0.5, det_epsilon: float | None = None) -> float:
    """BIC of a linear Gaussian family from the covariance matrix.

    With ``det_epsilon`` the score tolerates deterministic relations: a vanishing
    residual counts as zero and the logarithm is taken of residual + epsilon.
    """
    residual = float(cov[child, child])
    pa = list(parents)
    if pa:
        xy = cov[pa, child]
        xx = cov[np.ix_(pa, pa)]
        try:
            weights = np.linalg.solve(xx, xy)
        except np.linalg.LinAlgError:
            weights = np.linalg.pinv(xx) @ xy
        residual -= float(xy @ weights)
    if det_epsilon is None:
        log_var = np.log(residual if residual > 0 else np.finfo(float).eps)
    else:
        log_var = np.log(max(residual, 0.0) + det_epsilon)
    return float(-0.5 * n * (1 + log_var) - lambda_value * (len(pa) + 1) * np.log(n))


def bic_scores(families: DataFrame, cov: np.ndarray, n: int, columns: Sequence[str],
               lambda_value: float = 0.5, det_epsilon: float | None = None) -> DataFrame:
    """Score a table of families (family_id, node, parents) against one covariance."""
    index = {c: i for i, c in enumerate(columns)}

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            score = [
                gaussian_bic(cov, n, index[node], [index[p] for p in parents],
                             lambda_value, det_epsilon)
                for node, parents in zip(pdf["node"], pdf["parents"])
            ]
            yield pdf.assign(score=score)

    return families.select("family_id", "node", "parents").mapInPandas(
        solve, "family_id int, node string, parents array<string>, score double"
    )


def functional_dependencies(encoded: Encoded) -> DataFrame:
    """(determinant, dependent): pairs where each state of one fixes the other's state."""
    names = list(encoded.columns)
    pairs = [(a, b) for a in names for b in names if a != b]
    families = [Family(i, b, (a,)) for i, (a, b) in enumerate(pairs)]
    spark = encoded.codes.sparkSession
    meta = family_frame(spark, families, encoded.states).select(
        "family_id", F.col("parents")[0].alias("determinant"), F.col("node").alias("dependent"),
        F.col("q").cast("bigint").alias("q"),
    )
    cells = family_counts(encoded.codes, families, encoded.cards).groupBy("family_id").agg(
        F.count("*").alias("cells")
    )
    return cells.join(F.broadcast(meta), "family_id").where(F.col("cells") == F.col("q")).select(
        "determinant", "dependent"
    )


def minimal_dependencies(encoded: Encoded, max_size: int = 3) -> list[tuple[tuple[str, ...], str]]:
    """(determinant, dependent): all smallest sets of up to ``max_size`` columns that fix another column.

    Level by level: a set fixes a column if adding it makes no more combinations of states. The
    combinations of a level are counted by one cube over one scan; only these counts come to the driver.
    Sets with a member that the others fix (such sets are never counted), and sets that hold a determinant
    of the column already, are not asked about. A constant column is fixed by the empty set.
    """
    names = sorted(encoded.columns)
    sizes: dict[tuple[str, ...], int] = {(): 1}
    found: dict[str, list[set[str]]] = {y: [] for y in names}
    out = []
    for k in range(max_size + 1):
        free = [s for s in combinations(names, k) if s in sizes and all(sizes.get(t) != sizes[s] for t in combinations(s, k - 1))] if k else [()]
        open_ = [(s, y) for s in free for y in names if y not in s and not any(d <= set(s) for d in found[y])]
        asked = sorted({tuple(sorted((*s, y))) for s, y in open_} - sizes.keys())
        if asked:
            counted = cube.build(encoded, set(asked))
            rows = collect_bounded(cube.occupied(counted, asked, encoded.cards), "combinations of columns")
            sizes |= {asked[r["family_id"]]: r["cells"] for r in rows}
        for s, y in open_:
            if sizes.get(tuple(sorted((*s, y)))) == sizes[s]:
                found[y].append(set(s))
                out.append((s, y))
    return out


def linear_dependencies(cov: np.ndarray, columns: Sequence[str],
                        threshold: float = 1e-5) -> list[tuple[str, list[str]]]:
    """Columns whose relative residual variance given all others falls below a threshold."""
    out = []
    for i, name in enumerate(columns):
        others = [j for j in range(len(columns)) if j != i]
        if cov[i, i] <= 0 or not others:
            continue
        xx = cov[np.ix_(others, others)]
        weights = np.linalg.pinv(xx) @ cov[others, i]
        if (cov[i, i] - cov[others, i] @ weights) / cov[i, i] < threshold:
            out.append((name, [columns[j] for j, w in zip(others, weights) if abs(w) > threshold]))
    return out


def linear_relations(cov: np.ndarray, columns: Sequence[str],
                     threshold: float = 1e-5) -> tuple[list[str], list[tuple[str, str, float]]]:
    """Independent columns in order of their choice, and (dependent, basis, weight) of all other columns.

    Rank-revealing: on the correlations, the column with most variance left by those chosen so far (the first by
    name among equals) is swept in until no column keeps ``threshold`` of its own. What is left are exact
    sums of chosen columns, and the sweeps have left their weights. Constant columns are in neither list.
    """
    names = sorted(c for i, c in enumerate(columns) if cov[i, i] > 0)
    at = [columns.index(c) for c in names]
    scale = np.sqrt(np.diag(cov)[at])
    left = cov[np.ix_(at, at)] / np.outer(scale, scale)
    np.fill_diagonal(left, 1.0)
    chosen: list[int] = []
    while len(chosen) < len(names):
        k = int(np.argmax(np.round(np.diag(left), 9)))
        pivot = left[k, k]
        if pivot <= threshold:
            break
        row = left[k] / pivot
        column = left[:, k] / pivot
        left = left - np.outer(column, row) * pivot
        left[k], left[:, k], left[k, k] = row, column, -1.0 / pivot
        chosen.append(k)
    relations = [
        (names[j], names[k], float(left[k, j] * scale[j] / scale[k]))
        for j in range(len(names)) if j not in chosen for k in chosen if abs(left[k, j]) > threshold
    ]
    return [names[k] for k in chosen], relations
