"""Posteriors of all targets from one clique tree and two message passes.

The tree (moral graph, min-fill triangulation, maximum-weight spanning tree of the cliques) lives on the
driver and is as small as the network. Everything that grows is a table: clique potentials
(clique, assignment), evidence signatures (clique, evidence case) and messages
(kind, clique, signature, separator assignment). All cliques of one depth send their messages in one job,
so the plan grows with the tree, not with the targets, and every join is an equality on keys.

A message only depends on the evidence of the cliques behind it. It is computed once per distinct
signature of that evidence and shared by all cases that have it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.session import broadcast_if_small, durable, local_frame

UP, DOWN = 0, 1
OPEN = -1  # in place of a state: not observed


@dataclass
class Clique:
    """Variables, the clique towards the root, those away from it, and the families multiplied in."""

    names: tuple[str, ...]
    parent: int
    depth: int
    children: list[int]
    families: list[str]
    inside: set[str]  # variables of this clique and of all below

    def separator(self, other: Clique) -> list[str]:
        return [v for v in self.names if v in other.names]


def cliques_of(parents: dict[str, list[str]]) -> list[frozenset[str]]:
    """Maximal cliques of the triangulated moral graph."""
    adj: dict[str, set[str]] = {v: set() for v in parents}
    for v, ps in parents.items():
        for a, b in combinations({v, *ps}, 2):
            adj[a].add(b)
            adj[b].add(a)
    found: list[frozenset[str]] = []
    while adj:
        def fill(v: str) -> int:
            return sum(1 for a, b in combinations(adj[v], 2) if b not in adj[a])

        v = min(adj, key=lambda u: (fill(u), len(adj[u]), u))
        clique = frozenset({v, *adj[v]})
        if not any(clique <= c for c in found):
            found.append(clique)
        for a in adj[v]:
            adj[a] |= adj[v] - {a}
            adj[a].discard(v)
        del adj[v]
    return found


def _weight(names, cards: dict[str, int]) -> int:
    return reduce(lambda a, v: a * cards[v], names, 1)


def clique_tree(parents: dict[str, list[str]], cards: dict[str, int], root_for: str | None = None) -> list[Clique]:
    """Cliques with their tree; the root holds ``root_for`` or stands in the middle."""
    sets = cliques_of(parents)
    links: dict[int, set[int]] = {0: set()}
    while len(links) < len(sets):  # a separator may be empty, so a forest becomes one tree
        i, j = max(((i, j) for i in links for j in range(len(sets)) if j not in links),
                   key=lambda e: (len(sets[e[0]] & sets[e[1]]), -e[0], -e[1]))
        links[i].add(j)
        links[j] = {i}

    def walk(start: int) -> dict[int, tuple[int, int]]:
        seen, todo = {start: (-1, 0)}, [start]
        for k in todo:
            for n in sorted(links[k]):
                if n not in seen:
                    seen[n] = (k, seen[k][1] + 1)
                    todo.append(n)
        return seen

    if root_for is not None:
        root = min((k for k in links if root_for in sets[k]), key=lambda k: (_weight(sets[k], cards), k))
    else:
        root = min(links, key=lambda k: (max(d for _, d in walk(k).values()), k))
    placed = walk(root)
    out = [Clique(tuple(sorted(s)), placed[k][0], placed[k][1], [], [], set(s)) for k, s in enumerate(sets)]
    for k in sorted(placed, key=lambda k: -placed[k][1]):
        if (up := placed[k][0]) >= 0:
            out[up].children.append(k)
            out[up].inside |= out[k].inside
    for v, ps in parents.items():
        home = min((k for k, c in enumerate(out) if {v, *ps} <= set(c.names)), key=lambda k: (_weight(out[k].names, cards), k))
        out[home].families.append(v)
    return out


class Tree:
    """Potentials of a fitted network and the passes over its tree."""

    def __init__(self, spark: SparkSession, parents: dict[str, list[str]], states: dict[str, list[str]],
                 factors: DataFrame, root_for: str | None = None) -> None:
        """``factors``: (node, key, p), key being the states of the parents, then the node's own."""
        self.spark, self.states = spark, states
        self.nodes = sorted(parents)
        self.cards = {v: len(states[v]) for v in self.nodes}
        self.cliques = clique_tree(parents, self.cards, root_for)
        self.potentials = durable(self._potentials(parents, factors))
        self.sent: dict[tuple[int, int], DataFrame] = {}  # (kind, depth): messages

    def _frame(self, rows: list, schema: str) -> DataFrame:
        return broadcast_if_small(local_frame(self.spark, rows, schema))

    def home(self, name: str) -> int:
        return min((k for k, c in enumerate(self.cliques) if name in c.names), key=lambda k: (_weight(self.cliques[k].names, self.cards), k))

    def _potentials(self, parents: dict[str, list[str]], factors: DataFrame) -> DataFrame:
        """(clique, cell, a, w): every possible assignment ``a`` (state numbers) and its product of tables."""
        shape, owned = [], []
        for k, c in enumerate(self.cliques):
            steps, step = [], 1
            for v in reversed(c.names):
                steps.append(step)
                step *= self.cards[v]
            shape.append((k, step, steps[::-1], [self.cards[v] for v in c.names], len(c.families)))
            owned += [(k, v, [c.names.index(u) for u in (*parents[v], v)], 1.0 / self.cards[v]) for v in c.families]
        cells = self._frame(shape, "clique int, space bigint, steps array<bigint>, sizes array<bigint>, tables int").select(
            "clique", "tables", "steps", "sizes", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("space") - 1)).alias("cell"))
        cells = cells.select("clique", "tables", "cell", F.expr(
            "transform(steps, (s, i) -> cast((cell div s) % sizes[i] as int))").alias("a"))
        order = {v: [*parents[v], v] for v in self.nodes}
        known = self._frame([(v, [self.states[u] for u in order[v]]) for v in self.nodes], "node string, known array<array<string>>")
        coded = factors.join(known, "node").select("node", F.expr(
            "transform(key, (s, i) -> cast(array_position(known[i], s) - 1 as int))").alias("at"), "p")
        use = self._frame(owned, "clique int, node string, places array<int>, miss double")
        picked = cells.join(use, "clique").withColumn("at", F.transform("places", lambda p: F.get("a", p)))
        table = picked.join(broadcast_if_small(coded), ["node", "at"], "left").groupBy("clique", "cell").agg(
            F.product(F.coalesce("p", "miss")).alias("w"))
        return cells.join(table, ["clique", "cell"], "left").select(
            "clique", "cell", "a", F.when(F.col("tables") == 0, 1.0).otherwise(F.col("w")).alias("w")).where("w > 0")

    def _places(self, clique: int, names: list[str]) -> list[int]:
        return [self.cliques[clique].names.index(v) for v in names]

    def signatures(self, cases: DataFrame) -> DataFrame:
        """(clique, ev_key, mask, seen, up, down): what each clique, and each side of it, knows of a case.

        ``cases`` has ev_key and ``obs``, the state numbers of ``nodes`` or OPEN.
        """
        at = {v: i for i, v in enumerate(self.nodes)}
        inner = [{v for k2, o in enumerate(self.cliques) if not self._below(k, k2) for v in o.names} for k in range(len(self.cliques))]
        rows = [(k, [at[v] for v in c.names], sorted(at[v] for v in c.inside), sorted(at[v] for v in inner[k]))
                for k, c in enumerate(self.cliques)]
        shape = [F.struct(F.lit(k).alias("clique"), *[_ints(x).alias(n) for n, x in zip(("own", "under", "over"), r)])
                 for k, *r in rows]
        wide = cases.select("ev_key", "obs", F.explode(F.array(*shape)).alias("s")).select("ev_key", "obs", "s.*")
        part = lambda c: F.array_join(F.transform(c, lambda i: F.get("obs", i).cast("string")), ",")
        own = F.transform("own", lambda i: F.get("obs", i))
        return durable(wide.select(
            "clique", "ev_key", F.transform(own, lambda s: s != OPEN).alias("mask"), F.filter(own, lambda s: s != OPEN).alias("seen"),
            part("under").alias("up"), part("over").alias("down")))

    def _below(self, top: int, k: int) -> bool:
        while k >= 0:
            if k == top:
                return True
            k = self.cliques[k].parent
        return False

    def _incoming(self, clique: int, but: int | None) -> list[tuple[int, int, list[int]]]:
        """(kind, sender's clique, places of the separator) of all messages to a clique."""
        c = self.cliques[clique]
        out = [(UP, k, self._places(clique, self.cliques[k].separator(c))) for k in c.children if k != but]
        if c.parent >= 0 and but != c.parent:
            out.append((DOWN, clique, self._places(clique, self.cliques[clique].separator(self.cliques[c.parent]))))
        return out

    def _send(self, base: DataFrame, keys: list[str], jobs: list[tuple[int, int | None, list[int], int]], messages: DataFrame | None) -> DataFrame:
        """Products of potentials and incoming messages, summed onto the places ``out``: keys, sep, w.

        ``base`` has ``keys``, job, ev_key (any case with the key's signature), mask and seen. A job is
        (clique, neighbour that gets the result, out places, number); the signature of each incoming
        message is that of ``ev_key`` at its sender.
        """
        plan = [(n, clique, out, [k for k in self._incoming(clique, but)]) for clique, but, out, n in jobs]
        how = self._frame([(n, c, out, len(i)) for n, c, out, i in plan], "job int, clique int, out array<int>, expected int")
        masks = base.select("job", "mask").distinct().join(how.select("job", "clique"), "job").select("clique", "mask").distinct()
        masked = self.potentials.join(broadcast_if_small(masks), "clique").withColumn(
            "seen", F.expr("filter(a, (x, i) -> mask[i])"))
        rows = base.join(how, "job").join(masked.select("clique", "mask", "seen", "a", "w"), ["clique", "mask", "seen"])
        if messages is not None:
            links = self._frame([(n, kind, c, at) for n, _, _, i in plan for kind, c, at in i], "job int, kind int, sender int, at array<int>")
            asked = rows.where("expected > 0").join(links, "job").withColumn("sep", F.transform("at", lambda p: F.get("a", p)))
            asked = asked.join(self.signed, (F.col("sender") == F.col("s_clique")) & (F.col("ev_key") == F.col("s_key")))
            asked = asked.withColumn("behind", F.when(F.col("kind") == UP, F.col("up")).otherwise(F.col("down")))
            met = asked.join(messages, ["kind", "sender", "behind", "sep"]).groupBy(*keys, "job", "out", "expected", "a").agg(
                F.first("w").alias("w"), F.product("m").alias("m"), F.count("*").alias("n"))
            met = met.where("n = expected").select(*keys, "job", "out", "a", (F.col("w") * F.col("m")).alias("w"))
            rows = rows.where("expected = 0").select(*keys, "job", "out", "a", "w").unionByName(met)
        sep = F.transform("out", lambda p: F.get("a", p)).alias("sep")
        return rows.groupBy(*keys, "job", sep).agg(F.sum("w").alias("w"))

    def _messages(self, kinds: list[tuple[int, int]]) -> DataFrame | None:
        parts = [self.sent[k] for k in kinds if k in self.sent]
        return reduce(DataFrame.unionByName, parts) if parts else None

    def posteriors(self, cases: DataFrame, asked: DataFrame) -> DataFrame:
        """(target, ev_key, state number, w), not normalised, for ``asked`` (target, ev_key)."""
        signs = self.signatures(cases)
        self.signed = signs.select(F.col("clique").alias("s_clique"), F.col("ev_key").alias("s_key"), "up", "down")
        height = max(c.depth for c in self.cliques)
        targets = sorted(r["target"] for r in asked.select("target").distinct().collect())  # at most all nodes
        for depth in range(height, 0, -1):
            here = [k for k, c in enumerate(self.cliques) if c.depth == depth]
            base = signs.where(F.col("clique").isin(here)).groupBy("clique", F.col("up").alias("sig")).agg(
                F.min_by(F.struct("ev_key", "mask", "seen"), "ev_key").alias("e")).select(
                F.col("clique").alias("job"), "sig", "e.*")
            jobs = [(k, self.cliques[k].parent, self._places(k, self.cliques[k].separator(self.cliques[self.cliques[k].parent])), k) for k in here]
            self._keep(UP, depth, self._send(base, ["sig"], jobs, self._messages([(UP, depth + 1)])))
        wanted = {self.home(t) for t in targets}
        wanted = {k for k in range(len(self.cliques)) if any(self._below(k, h) for h in wanted)}
        for depth in range(1, height + 1):
            here = [k for k in wanted if self.cliques[k].depth == depth]
            if not here:
                break
            # what the parent knows of a case that stands for all with the same evidence outside
            whose = self._frame([(k, self.cliques[k].parent) for k in here], "job int, clique int")
            first = signs.where(F.col("clique").isin(here)).groupBy(F.col("clique").alias("job"), F.col("down").alias("sig")).agg(F.min("ev_key").alias("ev_key"))
            base = first.join(whose, "job").join(signs.select("clique", "ev_key", "mask", "seen"), ["clique", "ev_key"]).drop("clique")
            jobs = [(p, k, self._places(p, self.cliques[k].separator(self.cliques[p])), k) for k in here for p in [self.cliques[k].parent]]
            self._keep(DOWN, depth, self._send(base, ["sig"], jobs, self._messages([(UP, depth), (DOWN, depth - 1)])))
        homes = self._frame([(t, self.home(t), i) for i, t in enumerate(targets)], "target string, clique int, job int")
        base = asked.join(homes, "target").join(signs.select("clique", "ev_key", "mask", "seen"), ["clique", "ev_key"]).drop("clique")
        jobs = [(self.home(t), None, self._places(self.home(t), [t]), i) for i, t in enumerate(targets)]
        found = self._send(base, ["target", "ev_key"], jobs, self._messages(list(self.sent)))
        return found.select("target", "ev_key", F.col("sep")[0].alias("state"), "w")

    def _keep(self, kind: int, depth: int, found: DataFrame) -> None:
        self.sent[kind, depth] = durable(found.select(
            F.lit(kind).alias("kind"), F.col("job").alias("sender"), F.col("sig").alias("behind"), "sep", F.col("w").alias("m")))


def _ints(values: list[int]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<int>")
