"""Model lifecycle: fit a structure, fit parameters, predict, save and load."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from typing import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from causeway.config import AdvisedConfig, AnswerConfig, ModelConfig
from causeway.operators import advice, inference, propagation
from causeway.operators.encode import state_catalogue
from causeway.plans.advised import AdvisedLearner
from causeway.plans.full_table import (
    advised_constraint_search,
    constraint_search,
    greedy_search,
    structure_from_document,
    visit_search,
)
from causeway.plans.network import Network, ParametersNotFitted, fit_blankets, fit_global
from causeway.plans.subsample import learn_subsampled
from causeway.session import collect_bounded, local_frame
from causeway.sources.responses import Advisor


@dataclass
class Model:
    """A learned graph and, once fitted, its parameters."""

    kind: str
    config: ModelConfig
    network: Network

    @property
    def nodes(self) -> list[str]:
        return list(self.network.nodes)

    def edges(self, spark: SparkSession) -> DataFrame:
        return local_frame(spark, list(self.network.edges), "parent string, child string")

    def fit_parameters(self, df: DataFrame) -> "Model":
        if self.config.backend == "blanket":
            self.network = fit_blankets(df, self.network.nodes, self.network.edges)
        else:
            self.network = fit_global(df, self.network.nodes, self.network.edges)
        return self

    @property
    def parameters_fitted(self) -> bool:
        return self.network.rows is not None

    @property
    def supports_propagation(self) -> bool:
        return self.network.local is not None

    def predict(self, queries: DataFrame) -> DataFrame:
        """(query_id, target, dist) for (query_id, target, context)."""
        self.network.require_parameters()
        return inference.posterior(queries, self.network)

    def predict_table(self, df: DataFrame, key: str) -> DataFrame:
        return inference.predict_table(df, [key], self.network)

    def predict_propagated(self, queries: DataFrame, max_hops: int | None = 3,
                           draws: int = 50) -> DataFrame:
        self.network.require_parameters()
        if not self.supports_propagation:
            raise TypeError("propagation needs parameters fitted per blanket")
        return propagation.propagate(queries, self.network, max_hops, draws, self.config.random_seed)

    def save(self, spark: SparkSession, path: str) -> None:
        """Parquet tables and one manifest row; an existing path is an error."""
        net = self.network
        local_frame(spark, [(self.kind, json.dumps(asdict(self.config), default=list))],
                    "kind string, config string").write.parquet(f"{path}/manifest")
        local_frame(spark, list(enumerate(net.nodes)), "ord int, node string").write.parquet(f"{path}/nodes")
        self.edges(spark).write.parquet(f"{path}/dag")
        if self.parameters_fitted:
            local_frame(spark, list(net.states.items()), "var string, states array<string>").write.parquet(f"{path}/states")
            net.cpts.write.parquet(f"{path}/cpt")
            net.rows.write.parquet(f"{path}/cpt_rows")
            owned = [(t, n, i) for t, ids in (net.owners or {}).items() for n, i in ids.items()]
            local_frame(spark, owned, "target string, node string, family_id int").write.parquet(f"{path}/blankets")

    @classmethod
    def load(cls, spark: SparkSession, path: str, kind: str, config: ModelConfig) -> "Model":
        """Load a saved model; a different kind is a TypeError."""
        saved = spark.read.parquet(f"{path}/manifest").first()["kind"]
        if saved != kind:
            raise TypeError(f"the saved model is {saved}, not {kind}")
        nodes = tuple(r["node"] for r in collect_bounded(spark.read.parquet(f"{path}/nodes").orderBy("ord"), "nodes"))
        edges = tuple(sorted((r["parent"], r["child"]) for r in collect_bounded(spark.read.parquet(f"{path}/dag"), "edges")))
        net = Network(nodes, edges)
        if _exists(spark, f"{path}/cpt"):
            states = {r["var"]: list(r["states"]) for r in collect_bounded(spark.read.parquet(f"{path}/states"), "states")}
            owners: dict[str, dict[str, int]] = {}
            for r in collect_bounded(spark.read.parquet(f"{path}/blankets"), "blankets"):
                owners.setdefault(r["target"], {})[r["node"]] = r["family_id"]
            net = Network(nodes, edges, states, spark.read.parquet(f"{path}/cpt"),
                          spark.read.parquet(f"{path}/cpt_rows"),
                          {t: set(ids) for t, ids in owners.items()} or None, owners or None)
        return cls(kind, config, net)


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _edges(df: DataFrame) -> list[tuple[str, str]]:
    return [(r["parent"], r["child"]) for r in collect_bounded(df.select("parent", "child"), "edges")]


def fit(kind: str, df: DataFrame, config: ModelConfig, key: str | None = None,
        advisor: Advisor | None = None, dictionary: DataFrame | None = None) -> Model:
    """Learn a structure of the given kind and, if configured, its parameters."""
    if kind not in LEARNERS:
        raise ValueError(f"unknown model {kind!r}; choose one of {', '.join(sorted(LEARNERS))}")
    edges = LEARNERS[kind](df, config, key, advisor, dictionary)
    nodes = [c for c in df.columns if c != key and c not in config.ignore_columns]
    model = Model(kind, config, Network(tuple(nodes), tuple(sorted(edges))))
    return model.fit_parameters(df) if config.fit_parameters else model


Learn = Callable[..., list[tuple[str, str]]]
AUGMENTATIONS = ("parent_ordering", "column_grouping", "cycle_arbitration", "adaptive_sampling")


def _advised(flags: Mapping[str, bool]) -> Learn:
    def learn(df, config: AdvisedConfig, key, advisor, dictionary):
        return _edges(AdvisedLearner(df, key, replace(config, **flags), advisor, dictionary).fit())

    return learn


def _document(df, config: AnswerConfig, key, advisor, dictionary):
    """Ask once for the whole structure."""
    columns = [c for c in df.columns if c != key and c not in config.ignore_columns]
    spark = df.sparkSession
    known = dictionary if dictionary is not None else local_frame(spark, [], "var string, description string")
    asked = advice.render_variables(state_catalogue(df, columns), known)
    answers = advisor.answer(asked, "structure_generation").select("run_id", "content")
    nodes = local_frame(spark, [(c,) for c in columns], "node string")
    return _edges(structure_from_document(answers, nodes, config))


def _flags(names, **extra) -> dict[str, bool]:
    return {**{a: a in names for a in AUGMENTATIONS}, **extra}


LEARNERS: dict[str, Learn] = {
    "subsample": lambda df, c, key, a, d: _edges(learn_subsampled(df, key, c)),
    "ges": lambda df, c, key, a, d: greedy_search(df, c, key),
    "pc": lambda df, c, key, a, d: constraint_search(df, c, key),
    "advised_pc": lambda df, c, key, a, d: advised_constraint_search(df, c, a, key),
    "document": _document,
    "visits": lambda df, c, key, a, d: visit_search(df, c, a, key, d),
    "advised_all": _advised(_flags(AUGMENTATIONS)),
    **{f"advised_{x}": _advised(_flags([x])) for x in AUGMENTATIONS},
    **{f"advised_without_{x}": _advised(_flags([y for y in AUGMENTATIONS if y != x])) for x in AUGMENTATIONS},
    "advised_all_plain_refinement": _advised(_flags(AUGMENTATIONS, refinement=True, refinement_support=False)),
    "advised_all_supported_refinement": _advised(_flags(AUGMENTATIONS, refinement=True, refinement_support=True)),
    "advised_all_narrow_refinement": _advised(_flags(AUGMENTATIONS, confounder_review=True, orphan_repair=True)),
}

__all__ = ["LEARNERS", "Model", "ParametersNotFitted", "fit"]
