"""Contingency cube: a few variable sets are counted from the rows, all their subsets from the cells.

A batch of families or tests asks for the counts of many overlapping variable sets. ``cover`` picks
maximal sets that hold them all and grows them while the product of their states stays small, ``cells``
counts these in a few scans of the code table, and every family or test is then rolled up from the cells
of one set. However many tests a batch has, the rows are read once per ``DENSE_CELLS`` cells of the sets.

Cells of one set are bounded by the product of its states, not by rows. Sets with at most ``GROUP_CELLS``
occupied cells (counted, not assumed) are rolled up as arrays, one set a task; larger ones by groupings
over cells, spread like any other table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.operators.counts import Family, strides
from causeway.operators.encode import Encoded
from causeway.session import broadcast_if_small, collect_bounded, durable, local_frame

SMALL_SPACE = 1 << 14  # sets are widened up to this product of states
DENSE_CELLS = 1 << 24  # counters a task keeps as arrays through all its rows (4 bytes each)
SCANS = 16
CHUNK_ROWS = 1_000_000
MOST_ROWS = 1 << 30  # counters are given out after so many rows, before they could overflow
GROUP_CELLS = 1 << 21
CELLS = "set_id int, cell bigint, n bigint"


class Cover(NamedTuple):
    """``sets`` to count, and for each asked set (sorted names) the place of the set that holds it."""

    sets: list[tuple[str, ...]]
    holder: dict[tuple[str, ...], int]


def space(names: Sequence[str], cards: dict[str, int]) -> int:
    out = 1
    for c in names:
        out *= max(1, cards[c])
    return out


def cover(asked: set[tuple[str, ...]], cards: dict[str, int], small: int = SMALL_SPACE) -> Cover:
    """Sets that hold every asked one (tuples of sorted names).

    The largest open set is taken first and given further variables, smallest first, while its product of
    states is at most ``small`` and some open set gains by it.
    """
    left = sorted((frozenset(s) for s in asked), key=lambda s: (-len(s), sorted(s)))
    by_variable: dict[str, set[frozenset]] = {}
    for s in left:
        for v in s:
            by_variable.setdefault(v, set()).add(s)
    names = sorted(by_variable, key=lambda v: (cards[v], v))
    open_ = set(left)
    sets: list[tuple[str, ...]] = []
    holder: dict[tuple[str, ...], int] = {}
    for first in left:
        if first not in open_:
            continue
        grown = set(first)
        for v in names:
            if v not in grown and space([*grown, v], cards) <= small and any(s in open_ and s <= grown | {v} for s in by_variable[v]):
                grown.add(v)
        inside = set().union(*(by_variable[v] for v in grown)) if grown else {first}
        for s in inside:
            if s in open_ and s <= grown:
                open_.discard(s)
                holder[tuple(sorted(s))] = len(sets)
        if frozenset() in open_:
            open_.discard(frozenset())
            holder[()] = len(sets)
        sets.append(tuple(sorted(grown)))
    return Cover(sets, holder)


def deal(sets: Sequence[tuple[str, ...]], cards: dict[str, int], room: int = DENSE_CELLS, scans: int = SCANS) -> list[tuple[list[int], list[int]]]:
    """Places of the sets, dealt to scans: those counted as arrays (together at most ``room`` cells), and the others."""
    out: list[tuple[list[int], list[int]]] = [([], [])]
    held = 0
    for k in sorted(range(len(sets)), key=lambda k: (space(sets[k], cards), k)):
        size = space(sets[k], cards)
        if held + size > room and held and len(out) < scans:
            out.append(([], []))
            held = 0
        out[-1][held + size > room].append(k)
        held += size if held + size <= room else 0
    return out


def cells(codes: DataFrame, sets: Sequence[tuple[str, ...]], cards: dict[str, int], room: int = DENSE_CELLS) -> DataFrame:
    """(set_id, cell, n): mixed-radix cells of every set, last variable fastest, from a few scans.

    A scan takes sets with up to ``room`` cells in all; a task keeps their counters as arrays through all its
    rows and gives out each occupied cell once, so the cells shuffled grow with tasks, not with rows. Sets
    for which ``SCANS`` scans have no room are given out as distinct cells per ``CHUNK_ROWS`` rows. Spark adds them up.
    """
    parts = [_scanned(codes, sets, cards, dense, rest) for dense, rest in deal(sets, cards, room)]
    return reduce(DataFrame.union, parts).groupBy("set_id", "cell").agg(F.sum("n").alias("n"))


def _scanned(codes: DataFrame, sets: Sequence[tuple[str, ...]], cards: dict[str, int], dense: list[int], rest: list[int]) -> DataFrame:
    used = sorted({c for k in (*dense, *rest) for c in sets[k]}) or codes.columns[:1]  # one column carries the number of rows
    size = {k: space(sets[k], cards) for k in (*dense, *rest)}
    steps = {k: ([used.index(c) for c in sets[k]], strides(sets[k][:-1], sets[k][-1], cards) if sets[k] else []) for k in size}

    def table(k: int, cell: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({
            "set_id": pa.array(np.full(len(cell), k), pa.int32()), "cell": pa.array(cell, pa.int64()), "n": pa.array(n, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = {k: np.zeros(size[k], np.int32) for k in dense}

        def cell_of(k: int, data: list[np.ndarray], rows: int) -> np.ndarray:
            kind = np.int32 if size[k] < 1 << 31 else np.int64
            cell = np.zeros(rows, kind)
            for i, step in zip(*steps[k]):
                cell += data[i] if step == 1 else np.multiply(data[i], kind(step), dtype=kind)
            return cell

        def add(chunk: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(chunk)
            data = [rows[c].to_numpy().astype(np.int32) for c in used]
            for k, counter in counters.items():
                np.add(counter, np.bincount(cell_of(k, data, rows.num_rows), minlength=size[k]), out=counter, casting="unsafe")
            for k in rest:
                yield table(k, *np.unique(cell_of(k, data, rows.num_rows), return_counts=True))

        def given() -> Iterator[pa.RecordBatch]:
            for k, counter in counters.items():
                some = np.flatnonzero(counter)
                yield table(k, some, counter[some])
                counter[:] = 0

        chunk, held, counted = [], 0, 0
        for batch in batches:
            chunk.append(batch)
            held += batch.num_rows
            if held >= CHUNK_ROWS:
                yield from add(chunk)
                counted += held
                chunk, held = [], 0
                if counted >= MOST_ROWS:
                    yield from given()
                    counted = 0
        if held:
            yield from add(chunk)
        yield from given()

    return codes.select(*used).mapInArrow(run, CELLS)


class Projection(NamedTuple):
    """How cells of a counted set become cells of a family: digits (step, states) and their new steps."""

    family_id: int
    set_id: int
    digits: list[tuple[int, int]]
    steps: list[int]


def projections(families: Sequence[Family], chosen: Cover, cards: dict[str, int]) -> list[Projection]:
    places = [dict(zip(s, strides(s[:-1], s[-1], cards))) if s else {} for s in chosen.sets]
    out = []
    for f in families:
        names = (*f.parents, f.child)
        k = chosen.holder[tuple(sorted(set(names)))]
        out.append(Projection(f.id, k, [(places[k][c], max(1, cards[c])) for c in names], strides(f.parents, f.child, cards)))
    return out


def project(cell: np.ndarray, p: Projection) -> np.ndarray:
    return sum((cell // step % states * new for (step, states), new in zip(p.digits, p.steps)), np.zeros(len(cell), np.int64))


def summed(cell: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells and their sums; by counting where the cells lie close, else by sorting."""
    top = int(cell.max(initial=-1)) + 1
    if top <= 4 * len(cell) and n.sum() < 1 << 53:  # sums of doubles are exact below
        out = np.bincount(cell, n, minlength=top).astype(np.int64)
        key = np.flatnonzero(out)
        return key, out[key]
    key, inverse = np.unique(cell, return_inverse=True)
    out = np.zeros(len(key), np.int64)
    np.add.at(out, inverse, n)
    return key, out


class Cube(NamedTuple):
    """Written cells of the sets of a cover, and which sets fit a task as arrays."""

    counted: DataFrame
    chosen: Cover
    few: frozenset


def build(encoded: Encoded, asked: set[tuple[str, ...]], small: int = SMALL_SPACE, group_cells: int = GROUP_CELLS) -> Cube:
    chosen = cover(asked, encoded.cards, small)
    counted = durable(cells(encoded.codes, chosen.sets, encoded.cards))
    sizes = counted.groupBy("set_id").agg(F.count("*").alias("n")).where(F.col("n") > group_cells)
    many = {r["set_id"] for r in collect_bounded(sizes, "variable sets")}
    return Cube(counted, chosen, frozenset(set(range(len(chosen.sets))) - many))


def _by_expression(cube: Cube, wanted: list[Projection]) -> DataFrame:
    """Families of large sets: every cell once per family of its set, then one grouping."""
    spark = cube.counted.sparkSession
    rows = [(p.set_id, p.family_id, [d[0] for d in p.digits], [d[1] for d in p.digits], p.steps) for p in wanted]
    how = local_frame(spark, rows, "set_id int, family_id int, at array<bigint>, states array<bigint>, steps array<bigint>")
    cell = F.expr("aggregate(transform(at, (a, i) -> ((cell div a) % states[i]) * steps[i]), 0L, (x, y) -> x + y)")
    return cube.counted.join(broadcast_if_small(how), "set_id").groupBy("family_id", cell.alias("cell")).agg(F.sum("n").alias("n"))


def family_cells(cube: Cube, families: Sequence[Family], cards: dict[str, int]) -> DataFrame:
    """(family_id, cell, n) as ``counts.family_counts`` gives them, rolled up from the cube."""
    by_set: dict[int, list[Projection]] = {}
    for p in projections(families, cube.chosen, cards):
        by_set.setdefault(p.set_id, []).append(p)
    large = [p for k, ps in by_set.items() if k not in cube.few for p in ps]
    ours = {k: ps for k, ps in by_set.items() if k in cube.few}

    def roll_up(group: pa.Table) -> pa.Table:
        cell, n = group["cell"].to_numpy(), group["n"].to_numpy()
        parts = [(p.family_id, *summed(project(cell, p), n)) for p in ours.get(group["set_id"][0].as_py(), [])]
        return pa.table({
            "family_id": pa.array(np.concatenate([np.full(len(c), f) for f, c, _ in parts] or [[]]), pa.int32()),
            "cell": pa.array(np.concatenate([c for _, c, _ in parts] or [[]]), pa.int64()),
            "n": pa.array(np.concatenate([m for _, _, m in parts] or [[]]), pa.int64()),
        })

    small = cube.counted.where(F.col("set_id").isin(sorted(ours))) if large else cube.counted
    out = small.groupBy("set_id").applyInArrow(roll_up, "family_id int, cell bigint, n bigint")
    return out.unionByName(_by_expression(cube, large)) if large else out


def occupied(cube: Cube, asked: Sequence[tuple[str, ...]], cards: dict[str, int]) -> DataFrame:
    """(family_id, cells): how many combinations of states occur in each asked set, numbered by its place."""
    families = [Family(i, s[-1], s[:-1]) for i, s in enumerate(asked)]
    by_set: dict[int, list[Projection]] = {}
    for p in projections(families, cube.chosen, cards):
        by_set.setdefault(p.set_id, []).append(p)
    large = [p for k, ps in by_set.items() if k not in cube.few for p in ps]
    ours = {k: ps for k, ps in by_set.items() if k in cube.few}

    def count(group: pa.Table) -> pa.Table:
        cell = group["cell"].to_numpy()
        rows = [(p.family_id, len(summed(project(cell, p), group["n"].to_numpy())[0])) for p in ours.get(group["set_id"][0].as_py(), [])]
        columns = list(zip(*rows)) or [[], []]
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64()))], ["family_id", "cells"])

    out = cube.counted.where(F.col("set_id").isin(sorted(ours))).groupBy("set_id").applyInArrow(count, "family_id int, cells bigint")
    return out.unionByName(_by_expression(cube, large).groupBy("family_id").agg(F.count("*").alias("cells"))) if large else out


def chi2_of(n: np.ndarray, stratum: np.ndarray, x: np.ndarray, y: np.ndarray, rx: int, ry: int) -> tuple[float, int]:
    """Statistic and degrees of freedom of one test from its occupied cells.

    Margins are summed over cells; states without counts in a stratum cost no freedom there.
    """
    _, s = np.unique(stratum, return_inverse=True)
    nt = np.bincount(s, n)
    row, at_row = np.unique(s * rx + x, return_inverse=True)
    column, at_column = np.unique(s * ry + y, return_inverse=True)
    expected = np.bincount(at_row, n)[at_row] * np.bincount(at_column, n)[at_column] / nt[s]
    rows = np.bincount(row // rx, minlength=len(nt))
    columns = np.bincount(column // ry, minlength=len(nt))
    return float((n * n / expected).sum() - n.sum()), int(((rows - 1) * (columns - 1)).sum())


def test_statistics(cube: Cube, tests: Sequence, cards: dict[str, int]) -> DataFrame:
    """(test_id, stat, dof) of tests (x, y, s), numbered by their place, all from the cube's cells."""
    from causeway.operators.citest import chi2_statistics

    families = [Family(i, t.y, (*t.s, t.x)) for i, t in enumerate(tests)]
    by_set: dict[int, list[tuple[Projection, int, int]]] = {}
    for p, t in zip(projections(families, cube.chosen, cards), tests):
        by_set.setdefault(p.set_id, []).append((p, max(1, cards[t.x]), max(1, cards[t.y])))
    large = [e for k, es in by_set.items() if k not in cube.few for e in es]
    ours = {k: es for k, es in by_set.items() if k in cube.few}

    def tested(group: pa.Table) -> pa.Table:
        cell, n = group["cell"].to_numpy(), group["n"].to_numpy()
        rows = []
        for p, rx, ry in ours.get(group["set_id"][0].as_py(), []):
            key, m = summed(project(cell, p), n)
            rows.append((p.family_id, *chi2_of(m.astype(float), key // (rx * ry), key // ry % rx, key % ry, rx, ry)))
        columns = list(zip(*rows)) or [[], [], []]
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.float64(), pa.int64()))], ["test_id", "stat", "dof"])

    small = cube.counted.where(F.col("set_id").isin(sorted(ours))) if large else cube.counted
    out = small.groupBy("set_id").applyInArrow(tested, "test_id int, stat double, dof bigint")
    if not large:
        return out
    spark = cube.counted.sparkSession
    shape = local_frame(spark, [(p.family_id, rx, ry) for p, rx, ry in large], "family_id int, rx bigint, ry bigint")
    rolled = _by_expression(cube, [p for p, _, _ in large]).join(broadcast_if_small(shape), "family_id").select(
        F.col("family_id").alias("test_id"), F.expr("cell div (rx * ry)").alias("stratum"),
        F.expr("(cell div ry) % rx").alias("x"), F.expr("cell % ry").alias("y"), "n")
    return out.unionByName(chi2_statistics(durable(rolled)).select("test_id", "stat", "dof"))


def blocks(names: Sequence[str], cards: dict[str, int], width: int, small: int = SMALL_SPACE) -> list[tuple[str, ...]]:
    """Columns dealt into blocks; ``width`` of those with several columns have at most ``small`` states together."""
    out: list[list[str]] = []
    for v in sorted(names, key=lambda v: (cards[v], v)):
        if out and space([*out[-1], v], cards) ** width <= small:
            out[-1].append(v)
        else:
            out.append([v])
    return [tuple(b) for b in out]


def block_statistics(encoded: Encoded, tests: DataFrame, width: int, small: int = SMALL_SPACE, group_cells: int = GROUP_CELLS) -> DataFrame:
    """(x, y, s, stat, dof) of a written frame of tests (x, y, s) over at most ``width`` columns each.

    A test is answered by the union of the blocks its columns lie in. The driver learns which unions occur,
    never the tests: these meet the cells of their union in the cluster.
    """
    spark, cards = tests.sparkSession, encoded.cards
    dealt = blocks(encoded.columns, cards, width, small)
    block_of = F.create_map(*[F.lit(v) for i, b in enumerate(dealt) for c in b for v in (c, i)])
    every = F.concat("s", F.array("x", "y"))
    tests = tests.withColumn("blocks", F.array_sort(F.array_distinct(F.transform(every, lambda v: block_of[v]))))
    unions = sorted(tuple(r["blocks"]) for r in collect_bounded(tests.select("blocks").distinct(), "unions of blocks"))
    sets = [tuple(sorted(c for i in u for c in dealt[i])) for u in unions]
    places = [dict(zip(s, strides(s[:-1], s[-1], cards))) for s in sets]
    number = local_frame(spark, [(list(u), k) for k, u in enumerate(unions)], "blocks array<int>, set_id int")
    tests = tests.join(broadcast_if_small(number), "blocks").drop("blocks")
    counted = durable(cells(encoded.codes, sets, cards))
    sizes = counted.groupBy("set_id").agg(F.count("*").alias("n")).where(F.col("n") > group_cells)
    many = sorted(r["set_id"] for r in collect_bounded(sizes, "unions of blocks"))
    schema = "x string, y string, s array<string>, stat double, dof bigint"

    def tested(asked: pa.Table, cell_rows: pa.Table) -> pa.Table:
        cell, n = cell_rows["cell"].to_numpy(), cell_rows["n"].to_numpy()
        out = []
        for t in asked.to_pylist() if len(cell) else []:
            names = (*t["s"], t["x"], t["y"])
            digits = [(places[t["set_id"]][c], max(1, cards[c])) for c in names]
            key, m = summed(project(cell, Projection(0, t["set_id"], digits, strides(names[:-1], names[-1], cards))), n)
            rx, ry = max(1, cards[t["x"]]), max(1, cards[t["y"]])
            out.append((t["x"], t["y"], t["s"], *chi2_of(m.astype(float), key // (rx * ry), key // ry % rx, key % ry, rx, ry)))
        columns = list(zip(*out)) or [[]] * 5
        kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.float64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["x", "y", "s", "stat", "dof"])

    fits = ~F.col("set_id").isin(many) if many else F.lit(True)
    out = tests.where(fits).groupBy("set_id").cogroup(counted.where(fits).groupBy("set_id")).applyInArrow(tested, schema)
    if not many:
        return out
    from causeway.operators.citest import chi2_statistics

    layout = local_frame(spark, [(k, places[k]) for k in many], "set_id int, place map<string,bigint>")
    states = F.create_map(*[F.lit(v) for c in encoded.columns for v in (c, max(1, cards[c]))])
    large = tests.join(broadcast_if_small(layout), "set_id").select(
        "set_id", F.struct("x", "y", "s").alias("test_id"), states[F.col("x")].cast("bigint").alias("rx"),
        states[F.col("y")].cast("bigint").alias("ry"),
        F.transform(every, lambda v: F.struct(F.col("place")[v].alias("at"), states[v].cast("bigint").alias("states"))).alias("digits"))
    cell = F.expr("aggregate(digits, 0L, (a, d) -> a * d.states + (cell div d.at) % d.states)")
    rolled = counted.join(large, "set_id").groupBy("test_id", "rx", "ry", cell.alias("cell")).agg(F.sum("n").alias("n")).select(
        "test_id", F.expr("cell div (rx * ry)").alias("stratum"), F.expr("(cell div ry) % rx").alias("x"), F.expr("cell % ry").alias("y"), "n")
    return out.unionByName(chi2_statistics(durable(rolled)).select("test_id.*", "stat", "dof"))


def all_tests(columns: Sequence[str], depth: int) -> list:
    """Every test of two columns given up to ``depth`` others."""
    from itertools import combinations

    from causeway.operators.citest import Test

    names = sorted(columns)
    return [
        Test(x, y, s) for d in range(depth + 1) for x, y in combinations(names, 2)
        for s in combinations([c for c in names if c not in (x, y)], d)
    ]
