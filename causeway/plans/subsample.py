"""Structure learning by many searches on row-and-column subsamples."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.config import SearchSettings, SubsampleConfig
from causeway.operators import assemble as asm
from causeway.operators import sampling, votes
from causeway.operators.counts import correlation
from causeway.operators.encode import encode_table, numeric_columns, numeric_or_code
from causeway.operators.scores import gaussian_bic
from causeway.plans.search import bdeu_scorer, dag_edges, equivalence_search
from causeway.session import BROADCAST_ROWS, collect_bounded, durable, local_frame

# Parents a node may have inside one subsample search, whatever the final cap is.
EDGES = "sample_id int, edge_ord int, parent string, child string"

Learner = Callable[[pd.DataFrame], Sequence[tuple[str, str]]]


def discrete_learner(settings: SearchSettings, max_parents: int) -> Learner:
    ess = float(settings.parameters.get("ess", 1.0))

    def learn(pdf: pd.DataFrame) -> list[tuple[str, str]]:
        names = list(pdf.columns)
        coded = [np.unique(pdf[c].to_numpy(), return_inverse=True) for c in names]
        data = np.column_stack([inverse for _, inverse in coded])
        scorer = bdeu_scorer(data, [len(states) for states, _ in coded], ess)
        return dag_edges(equivalence_search(len(names), scorer, max_parents), names)

    return learn


def gaussian_learner(settings: SearchSettings, max_parents: int) -> Learner:
    params = settings.parameters
    eps = params.get("det_epsilon") if settings.score == "bic_det" else None

    def learn(pdf: pd.DataFrame) -> list[tuple[str, str]]:
        names = list(pdf.columns)
        cov = np.atleast_2d(np.cov(pdf.to_numpy(dtype=float), rowvar=False))
        n = len(pdf)

        def score(keys):
            return [gaussian_bic(cov, n, c, sorted(pa), params["lambda_value"], eps)
                    for c, pa in keys]

        return dag_edges(equivalence_search(len(names), score, max_parents), names)

    return learn


@dataclass(frozen=True)
class Prepared:
    """Training rows reduced to a key and one array of cell values per row."""

    rows: DataFrame
    columns: tuple[str, ...]
    total: int
    discrete: bool


def prepare(df: DataFrame, key: str, config: SubsampleConfig) -> Prepared:
    """Rows every pass samples from.

    Codes are looked up behind the scan of the text table, so only drawn rows are encoded and the table is
    not written a second time; numbers are written once.
    """
    columns = [c for c in df.columns if c != key and c not in config.ignore_columns]
    discrete = config.search.score == "bdeu"
    if discrete:
        coded = encode_table(df, columns, keep=[key], pin=False).codes
    else:
        coded = numeric_or_code(df, columns, keep=[key])
    rows = coded.select(key, F.array(*columns).alias("cells"))
    rows = rows if discrete else durable(rows)
    return Prepared(rows, tuple(columns), rows.count(), discrete)


def column_plan(prepared: Prepared, plan: DataFrame, config: SubsampleConfig,
                related: Mapping[str, set[str]] | None = None, weight: float = 1.0) -> DataFrame:
    """Choose each sample's columns: (sample_id, forced, cols)."""
    k = min(config.num_columns_per_sample, len(prepared.columns))
    if related and weight != 1.0:
        out = sampling.sample_columns_weighted(
            plan, prepared.columns, k, config.random_seed, related, weight, "forced"
        )
    else:
        out = sampling.sample_columns(
            plan, prepared.columns, k, config.random_seed, forced="forced"
        )
    return durable(out)


def search_samples(prepared: Prepared, key: str, plan: DataFrame, num_samples: int,
                   config: SubsampleConfig, learner: Learner | None = None) -> DataFrame:
    """Run one search per planned sample; edges (sample_id, edge_ord, parent, child).

    Only the cells of the sampled columns travel to the group that searches them. Groups
    are spread by an explicit partition count, because their work is in the search, not
    in the bytes that adaptive execution would merge them by.
    """
    spark = prepared.rows.sparkSession
    k = min(config.num_rows_per_sample, prepared.total)
    learn = learner or (
        discrete_learner(config.search, config.max_parents) if prepared.discrete
        else gaussian_learner(config.search, config.max_parents)
    )
    position = F.create_map(*[
        part for i, c in enumerate(prepared.columns) for part in (F.lit(c), F.lit(i))
    ])
    small = num_samples <= BROADCAST_ROWS
    at = plan.select("sample_id", F.transform("cols", lambda c: position[c]).alias("at"))
    names = plan.select("sample_id", "cols")
    at, names = (F.broadcast(at), F.broadcast(names)) if small else (at, names)
    parts = min(num_samples, 4 * spark.sparkContext.defaultParallelism)

    def slim(drawn: DataFrame) -> DataFrame:
        cells = F.transform("at", lambda i: F.element_at("cells", i + 1))
        return drawn.join(at, "sample_id").select(key, "sample_id", cells.alias("cells"))

    drawn = sampling.sample_rows(
        prepared.rows, [key], num_samples, k, config.random_seed, prepared.total, partitions=parts, shape=slim
    )
    named = drawn.select("sample_id", "cells").join(names, "sample_id")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        sample = int(pdf["sample_id"].iloc[0])
        if len(pdf) != k:
            raise RuntimeError(f"sample {sample} has {len(pdf)} rows instead of {k}")
        table = pd.DataFrame(np.stack(pdf["cells"].to_numpy()), columns=list(pdf["cols"].iloc[0]))
        found = [(sample, i, p, c) for i, (p, c) in enumerate(learn(table))]
        return pd.DataFrame(found, columns=["sample_id", "edge_ord", "parent", "child"]).astype(
            {"sample_id": "int32", "edge_ord": "int32"}
        )

    return durable(named.groupBy("sample_id").applyInPandas(search, EDGES))


def parent_correlation(df: DataFrame, columns: Sequence[str], rank_by: str) -> DataFrame | None:
    """Correlation table to rank by, or None to rank by votes.

    ``auto`` uses correlation only if every column is numeric.
    """
    if rank_by == "votes":
        return None
    flags = collect_bounded(numeric_columns(df, columns), "column kinds")
    if not all(r["numeric"] for r in flags):
        if rank_by == "corr":
            raise ValueError("rank_by='corr' needs numeric columns only")
        return None
    return durable(correlation(df, columns))


def ranked_candidates(ranked: DataFrame, counted: DataFrame, nodes: DataFrame) -> DataFrame:
    """Attach the node order to ranked parents: (run_id, position, child, rank, parent)."""
    order = votes.node_order(votes.parent_appearance(counted, nodes))
    return ranked.join(order.select(F.col("node").alias("child"), "position"), "child").select(
        F.lit(0).alias("run_id"), "position", "child", "rank", "parent"
    )


def merge_votes(edges: DataFrame, cooc: DataFrame, columns: Sequence[str],
                config: SubsampleConfig, corr: DataFrame | None = None) -> DataFrame:
    """Count, cut, resolve, rank and assemble: (parent, child, n, cooc, freq)."""
    spark = edges.sparkSession
    nodes = local_frame(spark, [(c,) for c in columns], "node string")
    counted = votes.vote_counts(edges)
    kept = votes.resolve_direction(
        votes.frequency_cutoff(counted, cooc, config.frequency_cutoff)
    )
    kept = durable(kept)
    ranked = ranked_candidates(votes.rank_parents(kept, corr), kept, nodes)
    dag = asm.assemble(ranked, config.max_parents)
    return (
        votes.with_support(kept.select("child", "parent", "n"), cooc)
        .join(dag.select("parent", "child", "edge_ord"), ["parent", "child"])
        .select("parent", "child", "n", "cooc", "freq", "edge_ord")
    )


def save_candidates(path: str, edges: DataFrame, cooc: DataFrame) -> None:
    """Keep edges and co-occurrence together, so that merging can be repeated."""
    edges.write.parquet(f"{path}/edges")
    cooc.write.parquet(f"{path}/cooc")


def load_candidates(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/cooc")


def learn_subsampled(df: DataFrame, key: str, config: SubsampleConfig,
                     learner: Learner | None = None) -> DataFrame:
    """The whole pipeline: rows in, voted acyclic graph out."""
    spark = df.sparkSession
    columns = [c for c in df.columns if c != key and c not in config.ignore_columns]
    if config.candidates_path:
        edges, cooc = load_candidates(spark, config.candidates_path)
    else:
        prepared = prepare(df, key, config)
        plan = column_plan(prepared, sampling.sample_plan(spark, config.num_samples), config)
        edges = search_samples(prepared, key, plan, config.num_samples, config, learner)
        cooc = durable(votes.cooccurrence(plan, columns))
    if config.save_candidates_path:
        save_candidates(config.save_candidates_path, edges, cooc)
    corr = parent_correlation(df, columns, config.rank_by)
    return merge_votes(edges, cooc, columns, config, corr)
