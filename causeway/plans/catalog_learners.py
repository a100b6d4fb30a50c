"""Queries that learn structures."""

from __future__ import annotations

import os
import uuid

import pandas as pd
from pyspark.sql import functions as F

from causeway.config import (
    AdvisedConfig,
    ConstraintConfig,
    FullSearchConfig,
    ModelConfig,
    RequestSettings,
    SearchSettings,
    SubsampleConfig,
)
from causeway.plans import workloads as w
from causeway.plans.advised import AdvisedLearner
from causeway.plans.catalog_inference import EDGES, NODES
from causeway.plans.full_table import advised_constraint_search, constraint_search, greedy_search
from causeway.plans.model import Model
from causeway.plans.network import fit_blankets
from causeway.plans.registry import query
from causeway.plans.search import bdeu_scorer
from causeway.plans.subsample import learn_subsampled
from causeway.session import durable, local_frame, shared_dir
from causeway.sources.responses import Advisor

LEARNED = ["price", "quantity", "unitprice", "orderyear", "shipyear", "late", "returnflag", "linestatus"]
BASE = {"num_samples": 40, "num_rows_per_sample": 2000, "num_columns_per_sample": 8, "max_parents": 3,
        "random_seed": 42, "frequency_cutoff": 0.5}


def _edges(spark, edges):
    return local_frame(spark, edges, "parent string, child string")


def _voted(df):
    return df.select("parent", "child", "n", "cooc", F.round("freq", 6).alias("freq"))


@query("subsample_dag")
def subsample_dag(spark, sf):
    """Flagship: forty searches on row and column samples of all line items, voted into one graph."""
    return _voted(learn_subsampled(w.star(spark, sf), "row_id", SubsampleConfig(**BASE)))


@query("subsample_gaussian")
def subsample_gaussian(spark, sf):
    """The same on numeric columns with the Gaussian score, ranked by correlation."""
    lines = w.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("total"), (F.col("o_totalprice") * 2 + F.col("o_custkey")).alias("blend"),
        F.col("o_custkey").cast("double").alias("cust"), F.dayofyear("o_orderdate").cast("double").alias("day"))
    config = SubsampleConfig(**{**BASE, "num_samples": 12, "num_rows_per_sample": 500, "num_columns_per_sample": 3},
                             rank_by="corr", search=SearchSettings(score="bic"))
    return _voted(learn_subsampled(lines, "key", config))


@query("custom_learner")
def custom_learner(spark, sf):
    """A caller's own sub-learner: strongest mutual predictability per column pair."""
    def learn(pdf: pd.DataFrame):
        names, cards = list(pdf.columns), [int(pdf[c].max()) + 1 for c in pdf.columns]
        score = bdeu_scorer(pdf.to_numpy(), cards)
        out = []
        for i, child in enumerate(names):
            alone = score([(i, frozenset())])[0]
            gain, j = max((score([(i, frozenset([j]))])[0] - alone, j) for j in range(len(names)) if j != i)
            if gain > 0:
                out.append((names[j], child))
        return out

    return _voted(learn_subsampled(w.star(spark, sf), "row_id", SubsampleConfig(**{**BASE, "num_samples": 16}), learn))


@query("greedy_full")
def greedy_full(spark, sf):
    """Greedy equivalence search over all rows of eight columns."""
    found = greedy_search(w.star(spark, sf).select(*LEARNED), FullSearchConfig(max_parents=3))
    return _edges(spark, found)


@query("greedy_deterministic")
def greedy_deterministic(spark, sf):
    """The variant for deterministic relations, on numeric columns with a column that is a sum."""
    num = w.star_numeric(spark, sf).select("quantity", "discount", "tax", (F.col("discount") + F.col("tax")).alias("both"))
    config = FullSearchConfig(max_parents=2, search=SearchSettings(score="bic_det", algorithm="dges"))
    return _edges(spark, greedy_search(num, config))


@query("constraint_full")
def constraint_full(spark, sf):
    """Constraint-based search over all rows of eight columns."""
    found = constraint_search(w.star(spark, sf).select(*LEARNED), ConstraintConfig(alpha=0.001))
    return _edges(spark, found)


def _responder(pdf: pd.DataFrame) -> pd.DataFrame:
    """A stand-in advisor with fixed habits, so that runs repeat."""
    def reply(op: str, user: str) -> str:
        if op == "edge_check":
            return '{"KEEP": 80, "FLIP": 15, "REMOVE": 5}'
        if op == "edge_orient":
            return "1"
        if op == "cycle_arbitration":
            return "[1]"
        if op == "refinement":
            return "terminate()"
        if op == "parent_ordering":
            names = sorted(line.split(":")[0] for line in user.split("Candidates:\n")[1].splitlines() if not line.startswith(" "))
            return "[" + ", ".join(f'"{n}"' for n in names) + "]"
        if op == "column_grouping":
            return '["late", "unitprice"]'
        return "[]"

    size = pdf["user"].str.len().astype("int64")
    usage = [{"prompt_tokens": int(n), "cached_prompt_tokens": 0, "completion_tokens": 5, "total_tokens": int(n) + 5} for n in size]
    return pd.DataFrame({"key": pdf["key"], "content": [reply(o, u) for o, u in zip(pdf["op"], pdf["user"])],
                         "truncated": False, "usage": usage})


@query("advised_dag")
def advised_dag(spark, sf):
    """Subsample learning with all four kinds of advice and the guarded repairs."""
    config = AdvisedConfig(**{**BASE, "num_samples": 24}, parent_ordering=True, column_grouping=True,
                           cycle_arbitration=True, adaptive_sampling=True, targeted_samples_per_node=2,
                           confounder_review=True, orphan_repair=True)
    advisor = Advisor(spark, RequestSettings(model="stand-in"), responder=_responder)
    return _voted(AdvisedLearner(w.star(spark, sf), "row_id", config, advisor).fit())


@query("advised_constraint")
def advised_constraint(spark, sf):
    """Constraint-based search with an advisor for borderline tests, edges and directions."""
    advisor = Advisor(spark, RequestSettings(model="stand-in"), responder=_responder)
    config = ConstraintConfig(alpha=0.001, borderline=0.0005)
    return _edges(spark, advised_constraint_search(w.star(spark, sf).select(*LEARNED), config, advisor))


@query("saved_model")
def saved_model(spark, sf):
    """A model saved as tables, loaded again and asked."""
    star = durable(w.star(spark, sf).select(*NODES))
    config = ModelConfig(backend="blanket")
    path = os.path.join(shared_dir(spark), f"model-{uuid.uuid4().hex}")
    Model("subsample", config, fit_blankets(star, NODES, EDGES)).save(spark, path)
    model = Model.load(spark, path, "subsample", config)
    flags = star.select("returnflag").distinct()
    asked = flags.select(F.col("returnflag").alias("query_id"), F.lit("linestatus").alias("target"),
                         F.create_map(F.lit("returnflag"), F.col("returnflag")).alias("context"))
    out = model.predict(asked)
    return out.select("query_id", "target", F.explode("dist").alias("state", "p")).withColumn("p", F.round("p", 7))
