"""Clique tree posteriors against the full joint, on random networks."""

from itertools import combinations, product

import numpy as np
import pytest

from causeway.operators import inference
from causeway.operators.clique_tree import clique_tree, cliques_of
from causeway.plans.network import Network


def random_network(rng, n):
    nodes = [f"n{k}" for k in range(n)]
    states = {v: [f"s{i}" for i in range(int(rng.integers(1, 4)))] for v in nodes}
    parents = {v: sorted(rng.choice(nodes[:k], min(k, int(rng.integers(0, 3))), replace=False).tolist()) for k, v in enumerate(nodes)}
    tables = {}
    for v in nodes:
        for cfg in product(*[states[p] for p in parents[v]]):
            if rng.random() < 0.15 and parents[v]:
                continue  # never seen in training: uniform
            w = rng.random(len(states[v])) * (rng.random(len(states[v])) < 0.8)
            w = w if w.sum() else np.ones(len(states[v]))
            for s, p in zip(states[v], w / w.sum()):
                tables[v, (*cfg, s)] = float(p)
    return nodes, states, parents, tables


def joint(nodes, states, parents, tables):
    out = {}
    for a in product(*[states[v] for v in nodes]):
        at, p = dict(zip(nodes, a)), 1.0
        for v in nodes:
            cfg = tuple(at[u] for u in parents[v])
            unseen = not any((v, (*cfg, s)) in tables for s in states[v])
            p *= 1 / len(states[v]) if unseen else tables[v, (*cfg, at[v])]
        out[a] = p
    return out


@pytest.mark.parametrize("seed, n", [(1, 1), (2, 4), (3, 7), (4, 8)])
def test_posteriors(spark, seed, n):
    rng = np.random.default_rng(seed)
    nodes, states, parents, tables = random_network(rng, n)
    rows = spark.createDataFrame([(0, v, list(k), p) for (v, k), p in tables.items()], "family_id int, node string, key array<string>, p double")
    edges = tuple((p, v) for v in nodes for p in parents[v])
    net = Network(tuple(nodes), edges, states, None, rows)
    whole = joint(nodes, states, parents, tables)
    asked, want = [], {}
    for k in range(25):
        seen = {v: rng.choice(states[v]).item() for v in rng.choice(nodes, int(rng.integers(0, min(n, 4))), replace=False).tolist()}
        target = rng.choice(nodes).item()
        asked.append((k, target, seen | {"other": "x"}))
        seen.pop(target, None)
        mass = {s: sum(p for a, p in whole.items() if a[nodes.index(target)] == s and all(a[nodes.index(v)] == x for v, x in seen.items()))
                for s in states[target]}
        total = sum(mass.values())
        want[k] = {s: m / total for s, m in mass.items()} if total else None
    asked += [(100, "nowhere", {}), (101, nodes[0], {nodes[-1]: "unknown"})]
    want |= {100: None, 101: None if n > 1 else {s: pytest.approx(whole[(s,)]) for s in states[nodes[0]]}}
    frame = spark.createDataFrame(asked, "query_id int, target string, context map<string,string>")
    got = {r.query_id: r.dist for r in inference.posterior(frame, net).collect()}
    assert got.keys() == want.keys()
    for k, dist in want.items():
        assert got[k] == (None if dist is None else pytest.approx(dist, abs=1e-9)), k


def test_tree_is_a_clique_tree():
    rng = np.random.default_rng(9)
    for n in (1, 2, 6, 12):
        nodes, states, parents, _ = random_network(rng, n)
        tree = clique_tree(parents, {v: len(s) for v, s in states.items()})
        assert len(tree) == len(cliques_of(parents)) and sum(c.parent < 0 for c in tree) == 1
        assert sorted(v for c in tree for v in c.families) == sorted(nodes)
        for v in nodes:  # the cliques with a variable hang together
            having = [k for k, c in enumerate(tree) if v in c.names]
            assert sum(tree[k].parent in having for k in having) == len(having) - 1
        for a, b in combinations(tree, 2):
            assert not set(a.names) <= set(b.names) and not set(b.names) <= set(a.names)
