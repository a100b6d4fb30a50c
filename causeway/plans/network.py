"""A fitted network: nodes, edges, states and conditional probability tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators.counts import Family, cpt_rows, fit_cpts
from causeway.operators.encode import encode_table
from causeway.session import durable

Edge = tuple[str, str]


class ParametersNotFitted(RuntimeError):
    """A predictive query before the parameters were fitted."""


def parents_of(nodes: Sequence[str], edges: Iterable[Edge]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {n: [] for n in nodes}
    for parent, child in edges:
        out[child].append(parent)
    return {n: sorted(ps) for n, ps in out.items()}


def blanket_of(node: str, parents: dict[str, list[str]]) -> set[str]:
    """The node, its parents, its children and their other parents."""
    children = [c for c, ps in parents.items() if node in ps]
    spouses = {p for c in children for p in parents[c]}
    return {node, *parents[node], *children, *spouses}


@dataclass(frozen=True)
class Scope:
    """The part of a network that answers queries about one target."""

    parents: dict[str, list[str]]
    cpt: DataFrame

    def factor(self, node: str) -> DataFrame:
        """(key, p): key holds the parents' states, then the node's own."""
        return self.cpt.where(F.col("node") == node).select("key", "p")


@dataclass(frozen=True)
class Network:
    """``cpts`` has one row per occurring parent configuration; see ``counts.fit_cpts``.

    With ``local`` every node has its own scope: its blanket's induced graph, with tables
    fitted on that graph. Otherwise all targets share the whole graph.
    """

    nodes: tuple[str, ...]
    edges: tuple[Edge, ...]
    states: dict[str, list[str]] = field(default_factory=dict)
    cpts: DataFrame | None = None
    rows: DataFrame | None = None
    local: dict[str, set[str]] | None = None
    owners: dict[str, dict[str, int]] | None = None

    @property
    def parents(self) -> dict[str, list[str]]:
        return parents_of(self.nodes, self.edges)

    def require_parameters(self) -> None:
        if self.rows is None:
            raise ParametersNotFitted("fit the parameters before asking for predictions")

    def members(self, target: str) -> set[str]:
        return self.local[target] if self.local is not None else set(self.nodes)

    def scope(self, target: str) -> Scope:
        self.require_parameters()
        if self.local is None:
            return Scope(self.parents, self.rows)
        inside = self.local[target]
        ids = self.owners[target]
        induced = {n: [p for p in self.parents[n] if p in inside] for n in sorted(inside)}
        return Scope(induced, self.rows.where(F.col("family_id").isin(list(ids.values()))))


def _keyed(cpts: DataFrame) -> DataFrame:
    return cpt_rows(cpts).select(
        "family_id", "node", F.concat("cfg", F.array("state")).alias("key"), "p"
    )


def fit_global(df: DataFrame, nodes: Sequence[str], edges: Iterable[Edge]) -> Network:
    """One table per node over its parents, counted in one pass."""
    edges = tuple(sorted(edges))
    encoded = encode_table(df, list(nodes))
    parents = parents_of(nodes, edges)
    families = [Family(i, n, tuple(parents[n])) for i, n in enumerate(nodes)]
    cpts = durable(fit_cpts(encoded, families))
    return Network(tuple(nodes), edges, encoded.states, cpts, durable(_keyed(cpts)))


def fit_blankets(df: DataFrame, nodes: Sequence[str], edges: Iterable[Edge]) -> Network:
    """Separate tables per target's blanket; equal families are counted only once.

    In the induced graph a spouse keeps only those parents that lie in the blanket.
    """
    edges = tuple(sorted(edges))
    encoded = encode_table(df, list(nodes))
    parents = parents_of(nodes, edges)
    local = {n: blanket_of(n, parents) for n in nodes}
    ids: dict[tuple[str, tuple[str, ...]], int] = {}
    owners: dict[str, dict[str, int]] = {}
    for target in nodes:
        owners[target] = {}
        for n in sorted(local[target]):
            family = (n, tuple(p for p in parents[n] if p in local[target]))
            owners[target][n] = ids.setdefault(family, len(ids))
    families = [Family(i, n, pa) for (n, pa), i in ids.items()]
    cpts = durable(fit_cpts(encoded, families))
    return Network(tuple(nodes), edges, encoded.states, cpts, durable(_keyed(cpts)), local, owners)


def topological(nodes: Sequence[str], parents: dict[str, list[str]]) -> list[str]:
    """Parents before children; a cycle is an error."""
    left, out = list(nodes), []
    while left:
        ready = [n for n in left if all(p in out for p in parents[n])]
        if not ready:
            raise ValueError("the graph has a cycle")
        out += ready
        left = [n for n in left if n not in ready]
    return out
