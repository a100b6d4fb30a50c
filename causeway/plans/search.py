"""Greedy equivalence search over variables; scores come from a callback.

The search holds only the graph over the variables. Where the data are counted is the
callback's business: in a task for one subsample, or in one Spark job per step for the
full table.
"""

from __future__ import annotations

from itertools import chain, combinations
from typing import Callable, Iterable, Iterator, Sequence

import numpy as np

from causeway.functions.mathx import lgamma_np

FamilyKey = tuple[int, frozenset]
Scorer = Callable[[Sequence[FamilyKey]], Sequence[float]]


class Pattern:
    """Partially directed graph: ``pa[v]`` directed parents, ``nb[v]`` undirected neighbours."""

    def __init__(self, p: int) -> None:
        self.pa: list[set[int]] = [set() for _ in range(p)]
        self.nb: list[set[int]] = [set() for _ in range(p)]

    def copy(self) -> "Pattern":
        out = Pattern(0)
        out.pa = [set(s) for s in self.pa]
        out.nb = [set(s) for s in self.nb]
        return out

    def children(self, v: int) -> set[int]:
        return {w for w in range(len(self.pa)) if v in self.pa[w]}

    def adjacent(self, v: int) -> set[int]:
        return self.pa[v] | self.nb[v] | self.children(v)

    def is_clique(self, nodes: Iterable[int]) -> bool:
        adj = {v: self.adjacent(v) for v in nodes}
        return all(b in adj[a] for a, b in combinations(adj, 2))

    def semi_directed_path(self, start: int, end: int, blocked: set[int]) -> bool:
        """A path start..end along undirected or forward edges that avoids ``blocked``."""
        seen, todo = {start}, [start]
        while todo:
            v = todo.pop()
            if v == end:
                return True
            for w in (self.nb[v] | self.children(v)) - seen - blocked:
                seen.add(w)
                todo.append(w)
        return False


def extend_to_dag(pattern: Pattern) -> list[set[int]] | None:
    """Parent sets of a DAG in the class of the pattern (sink removal), None if there is none."""
    g = pattern.copy()
    parents = [set(s) for s in g.pa]
    left = set(range(len(parents)))
    while left:
        for v in sorted(left):
            if any(v in g.pa[w] for w in left):
                continue
            around = g.pa[v] | g.nb[v]
            if all(around - {w} <= g.adjacent(w) for w in g.nb[v]):
                break
        else:
            return None
        for w in g.nb[v]:
            parents[v].add(w)
            g.nb[w].discard(v)
        g.pa[v], g.nb[v] = set(), set()
        left.discard(v)
    return parents


def meek_closure(pattern: Pattern) -> Pattern:
    """Orient undirected edges that every member of the class orients the same way."""
    changed = True
    while changed:
        changed = False
        for b in range(len(pattern.pa)):
            for c in sorted(pattern.nb[b]):
                into_b, into_c = pattern.pa[b], pattern.pa[c]
                chain_rule = any(a != c and c not in pattern.adjacent(a) for a in into_b)
                cycle_rule = bool(pattern.children(b) & into_c)
                spouses = [d for d in pattern.nb[b] if d in into_c]
                kite_rule = any(e not in pattern.adjacent(d) for d, e in combinations(spouses, 2))
                if chain_rule or cycle_rule or kite_rule:
                    pattern.nb[b].discard(c)
                    pattern.nb[c].discard(b)
                    pattern.pa[c].add(b)
                    changed = True
    return pattern


def class_of(parents: Sequence[set[int]]) -> Pattern:
    """Completed pattern of a DAG: colliders stay directed, the rest follows by closure."""
    p = len(parents)
    adj = [set(parents[v]) for v in range(p)]
    for v in range(p):
        for w in parents[v]:
            adj[w].add(v)
    out = Pattern(p)
    for v in range(p):
        for a, b in combinations(sorted(parents[v]), 2):
            if b not in adj[a]:
                out.pa[v] |= {a, b}
    for v in range(p):
        for w in parents[v]:
            if w not in out.pa[v]:
                out.nb[v].add(w)
                out.nb[w].add(v)
    return meek_closure(out)


def _subsets(items: Iterable[int], most: int | None = None) -> Iterator[frozenset]:
    items = sorted(items)
    top = len(items) if most is None else min(most, len(items))
    return map(frozenset, chain.from_iterable(combinations(items, k) for k in range(top + 1)))


def _insertions(g: Pattern, max_parents: int) -> list[tuple]:
    out = []
    for y in range(len(g.pa)):
        adj_y = g.adjacent(y)
        for x in range(len(g.pa)):
            if x == y or x in adj_y:
                continue
            adj_x = g.adjacent(x)
            shared = g.nb[y] & adj_x
            for t in _subsets(g.nb[y] - adj_x, max_parents - 1):
                base = frozenset(shared | t | g.pa[y])
                if len(base) + 1 <= max_parents:
                    out.append((x, y, t, shared | t, base | {x}, base))
    return out


def _deletions(g: Pattern) -> list[tuple]:
    out = []
    for y in range(len(g.pa)):
        for x in g.pa[y] | g.nb[y]:
            shared = g.nb[y] & g.adjacent(x)
            for h in _subsets(shared):
                base = frozenset((shared - h) | g.pa[y]) - {x}
                out.append((x, y, h, shared - h, base, base | {x}))
    return out


def equivalence_search(p: int, score: Scorer, max_parents: int) -> list[set[int]]:
    """Forward insertions, then backward deletions; returns the parent sets of a DAG.

    All families a step may need are scored by one call of ``score``.
    """
    cache: dict[FamilyKey, float] = {}
    g = Pattern(p)

    def gains(moves: list[tuple]) -> list[tuple]:
        need = {(y, fam) for _, y, _, _, new, old in moves for fam in (new, old)} - cache.keys()
        if need:
            keys = sorted(need, key=lambda k: (k[0], sorted(k[1])))
            cache.update(zip(keys, score(keys)))
        scored = [(cache[y, new] - cache[y, old], x, y, extra, cond)
                  for x, y, extra, cond, new, old in moves]
        return sorted((m for m in scored if m[0] > 0),
                      key=lambda m: (-m[0], m[1], m[2], sorted(m[3])))

    def insert(x: int, y: int, t: frozenset) -> Pattern:
        new = g.copy()
        new.pa[y].add(x)
        for w in t:
            new.nb[y].discard(w)
            new.nb[w].discard(y)
            new.pa[y].add(w)
        return new

    def delete(x: int, y: int, h: frozenset) -> Pattern:
        new = g.copy()
        new.pa[y].discard(x)
        new.nb[y].discard(x)
        new.nb[x].discard(y)
        for w in h:
            if w in new.nb[y]:
                new.nb[y].discard(w)
                new.nb[w].discard(y)
                new.pa[w].add(y)
            if w in new.nb[x]:
                new.nb[x].discard(w)
                new.nb[w].discard(x)
                new.pa[w].add(x)
        return new

    def insert_ok(x: int, y: int, cond: set[int]) -> bool:
        return g.is_clique(cond) and not g.semi_directed_path(y, x, set(cond))

    def delete_ok(x: int, y: int, cond: set[int]) -> bool:
        return g.is_clique(cond)

    for moves, apply, valid in (
        (lambda: _insertions(g, max_parents), insert, insert_ok),
        (lambda: _deletions(g), delete, delete_ok),
    ):
        moving = True
        while moving:
            moving = False
            for _, x, y, extra, cond in gains(moves()):
                if not valid(x, y, cond):
                    continue
                dag = extend_to_dag(apply(x, y, extra))
                if dag is not None:
                    g, moving = class_of(dag), True
                    break
    return extend_to_dag(g)


def bdeu_scorer(data: np.ndarray, cards: Sequence[int], ess: float = 1.0) -> Scorer:
    """Scores counted from one task's own integer table."""
    data = data.astype(np.int64)

    def one(child: int, parents: frozenset) -> float:
        r = cards[child]
        cell = np.zeros(len(data), dtype=np.int64)
        q = 1
        for v in sorted(parents):
            cell = cell * cards[v] + data[:, v]
            q *= cards[v]
        if q > 4 * len(data):
            cell = np.unique(cell, return_inverse=True)[1]
        counts = np.bincount(cell * r + data[:, child])
        counts = np.pad(counts, (0, -len(counts) % r)).reshape(-1, r)
        rows = counts.sum(axis=1)
        counts, rows = counts[counts > 0], rows[rows > 0]
        a, b = ess / q, ess / (q * r)
        ends = lgamma_np(np.array([a, b]))
        return float(
            (lgamma_np(counts + b) - ends[1]).sum() - (lgamma_np(rows + a) - ends[0]).sum()
        )

    return lambda keys: [one(c, pa) for c, pa in keys]


def dag_edges(parents: Sequence[set[int]], names: Sequence[str]) -> list[tuple[str, str]]:
    return sorted((names[w], names[v]) for v in range(len(parents)) for w in parents[v])
