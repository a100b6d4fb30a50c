"""The contingency cube against plain counts, with and without the array paths."""

import math
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from causeway.operators import citest, cube, encode, scores
from causeway.operators.counts import Family

NAMES = ["a", "b", "c", "d", "e"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 3, 800)
    rows = np.stack([a, (a + rng.integers(0, 2, 800)) % 4, rng.integers(0, 2, 800), np.where(a == 0, 7, rng.integers(0, 9, 800)), np.zeros(800, int)])
    return [tuple(f"v{x}" for x in r) for r in rows.T]


@pytest.fixture(scope="module")
def coded(spark, data):
    return encode.encode_table(spark.createDataFrame(data, NAMES).repartition(4), NAMES)


def test_cover_holds_every_set():
    cards = dict(zip(NAMES, (3, 4, 2, 9, 1)))
    for small in (1, 20, 1000):
        asked = {s for k in range(5) for s in combinations(NAMES, k)}
        found = cube.cover(asked, cards, small)
        assert set(found.holder) == asked and all(set(s) <= set(found.sets[k]) for s, k in found.holder.items())
    assert len(cube.cover({("a", "b"), ("b", "c"), ("a", "c")}, cards, 1000).sets) == 1
    assert len(cube.cover({("a", "d"), ("b", "d")}, cards, 1).sets) == 2


@pytest.mark.parametrize("small, group_cells, dense", [(1 << 14, 1 << 21, 1 << 22), (1, 1 << 21, 0), (60, 30, 40), (1 << 14, 0, 1 << 22)])
def test_families_and_tests(spark, data, coded, monkeypatch, small, group_cells, dense):
    monkeypatch.setattr(cube, "DENSE_CELLS", dense)
    monkeypatch.setattr(cube, "CHUNK_ROWS", 90)
    families = [Family(7, "d", ("b", "a")), Family(3, "c", ()), Family(4, "a", ("e", "d", "c"))]
    tests = cube.all_tests(NAMES, 2)
    asked = {tuple(sorted((f.child, *f.parents))) for f in families} | {tuple(sorted((t.x, t.y, *t.s))) for t in tests}
    built = cube.build(coded, asked, small, group_cells)
    got = {(r.family_id, r.cell): r.n for r in cube.family_cells(built, families, coded.cards).collect()}
    want = Counter()
    codes = [{c: coded.states[c].index(v) for c, v in zip(NAMES, row)} for row in data]
    for f in families:
        for row in codes:
            cell = 0
            for c in (*f.parents, f.child):
                cell = cell * coded.cards[c] + row[c]
            want[f.id, cell] += 1
    assert got == want
    stats = {r.test_id: (r.stat, r.dof) for r in cube.test_statistics(built, tests, coded.cards).collect()}
    assert len(stats) == len(tests) == 10 * (1 + 3 + 3)
    for i, t in enumerate(tests):
        stat = dof = 0
        for s in {tuple(r[c] for c in t.s) for r in codes}:
            own = [(r[t.x], r[t.y]) for r in codes if tuple(r[c] for c in t.s) == s]
            n, x, y = Counter(own), Counter(p for p, _ in own), Counter(q for _, q in own)
            stat += sum((n[p, q] - x[p] * y[q] / len(own)) ** 2 / (x[p] * y[q] / len(own)) for p in x for q in y)
            dof += (len(x) - 1) * (len(y) - 1)
        assert stats[i] == (pytest.approx(stat, abs=1e-7), dof)


def test_same_as_tests_on_their_own(coded):
    tests = cube.all_tests(NAMES, 1)
    a = {r.test_id: (r.stat, r.dof, r.p) for r in citest.ci_tests(coded, tests).collect()}
    b = {r.test_id: (r.stat, r.dof, r.p) for r in citest.cube_tests(coded, tests).collect()}
    assert a.keys() == b.keys()
    assert all(a[k] == (pytest.approx(b[k][0], abs=1e-7), b[k][1], pytest.approx(b[k][2], abs=1e-9)) for k in a)


def plain_tests(edges, depth):
    around = {v: {b if a == v else a for a, b in edges if v in (a, b)} for e in edges for v in e}
    return {(min(e), max(e), s) for e in edges for v, u in (e, e[::-1]) for s in combinations(sorted(around[v] - {u}), depth)}


def test_subsets_by_rank():
    for size, width in ((5, 0), (5, 1), (6, 3), (4, 4), (9, 5)):
        assert [tuple(citest.subset_at(r, size, width)) for r in range(math.comb(size, width))] == list(combinations(range(size), width))


@pytest.mark.parametrize("ranks", [1, 3, 10_000])
def test_tests_of_a_level(spark, monkeypatch, ranks):
    monkeypatch.setattr(citest, "RANKS", ranks)
    edges = [("a", "b"), ("c", "a"), ("a", "d"), ("b", "e"), ("d", "e"), ("f", "g")]
    frame = spark.createDataFrame(edges, "a string, b string")
    for depth in range(4):
        got = [(r.x, r.y, tuple(r.s)) for r in citest.level_tests(frame, depth).collect()]
        assert len(got) == len(set(got)) and set(got) == plain_tests(edges, depth)
    assert citest.level_tests(frame.limit(0), 1).count() == 0


@pytest.mark.parametrize("small, group_cells", [(1 << 14, 1 << 21), (1, 1 << 21), (1 << 14, 0), (60, 9)])
def test_block_statistics(spark, coded, small, group_cells):
    tests = cube.all_tests(NAMES, 2)
    frame = spark.createDataFrame([(t.x, t.y, list(t.s)) for t in tests], "x string, y string, s array<string>").coalesce(1)
    got = {(r.x, r.y, tuple(r.s)): (r.stat, r.dof) for r in cube.block_statistics(coded, frame, 4, small, group_cells).collect()}
    want = {tests[r.test_id]: (r.stat, r.dof) for r in citest.cube_tests(coded, tests).collect()}
    assert got.keys() == want.keys() and all(got[t] == (pytest.approx(want[t][0], abs=1e-7), want[t][1]) for t in want)


@pytest.mark.parametrize("united", [True, False])
def test_skeleton_equals_plain_search(coded, united):
    edges, sets = set(combinations(sorted(NAMES), 2)), {}
    for depth in range(4):
        tests = [citest.Test(*t) for t in sorted(plain_tests(edges, depth))]
        p = {tests[r.test_id]: r.p for r in citest.cube_tests(coded, tests).collect()} if tests else {}
        for pair in {(t.x, t.y) for t in tests if p[t] > 0.05}:
            own = [(p[t], t.s) for t in tests if (t.x, t.y) == pair and p[t] > 0.05]
            sets[pair] = tuple(sorted({v for _, s in own for v in s})) if united else max(own)[1]
            edges.discard(pair)
    found = citest.skeleton(coded, 0.05, union_sets=united)
    assert found.edges == edges and found.sepsets == sets


def test_no_rows(spark):
    coded = encode.encode_table(spark.createDataFrame([], "a string, b string"), ["a", "b"])
    built = cube.build(coded, {("a", "b")})
    assert cube.family_cells(built, [Family(0, "a", ("b",))], coded.cards).count() == 0


def test_minimal_dependencies(spark, data, coded):
    got = set(scores.minimal_dependencies(coded))
    rows = [dict(zip(NAMES, r)) for r in data]
    fixes = lambda s, y: len({tuple(r[c] for c in (*s, y)) for r in rows}) == len({tuple(r[c] for c in s) for r in rows})
    want = set()
    for k in range(4):
        for s in combinations(NAMES, k):
            for y in set(NAMES) - set(s):
                if fixes(s, y) and not any(fixes(t, y) for j in range(k) for t in combinations(s, j)):
                    want.add((s, y))
    assert got == want and ((), "e") in got


def test_linear_relations():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 4)) * [1, 50, 0.01, 3]
    wide = np.column_stack([x, x[:, 0] - 2 * x[:, 1], x[:, 1] + x[:, 2] * 1000 + x[:, 3], np.full(500, 7.0), x[:, 3] * -4])
    names = list("abcdefgh")
    basis, relations = scores.linear_relations(np.cov(wide.T), names)
    assert len(basis) == 4 and "g" not in basis
    centred = dict(zip(names, (wide - wide.mean(axis=0)).T))
    for dependent in set(names) - set(basis) - {"g"}:
        parts = [(b, weight) for d, b, weight in relations if d == dependent]
        assert {b for b, _ in parts} <= set(basis)
        assert np.allclose(sum(weight * centred[b] for b, weight in parts), centred[dependent], atol=1e-6)
    assert scores.linear_relations(np.zeros((1, 1)), ["a"]) == ([], []) and scores.linear_relations(np.eye(2), ["a", "b"]) == (["a", "b"], [])


def test_cells_in_several_scans(spark):
    """Sets dealt to scans, one of them too large for any, against plain counts; a scan gives a cell once per task."""
    names, cards = ["a", "b", "c", "d"], {"a": 3, "b": 4, "c": 5, "d": 7}
    rng = np.random.default_rng(5)
    data = {c: rng.integers(0, cards[c], 400) for c in names}
    rows = list(zip(*(data[c].tolist() for c in names)))
    codes = spark.createDataFrame(rows, "a int, b int, c int, d int").repartition(3)
    sets = [("a",), ("a", "b"), (), ("c", "d"), ("a", "b", "c", "d"), ("b", "c")]
    dealt = cube.deal(sets, cards, 40)
    assert sorted(k for dense, rest in dealt for k in (*dense, *rest)) == list(range(6))
    assert len(dealt) > 1 and [k for _, rest in dealt for k in rest] == [4]
    assert all(sum(cube.space(sets[k], cards) for k in dense) <= 40 for dense, _ in dealt)
    want = {}
    for k, s in enumerate(sets):
        steps = cube.strides(s[:-1], s[-1], cards) if s else []
        for r in rows:
            at = (k, sum(r[names.index(c)] * step for c, step in zip(s, steps)))
            want[at] = want.get(at, 0) + 1
    for room in (40, 1, 1 << 24):
        got = cube.cells(codes, sets, cards, room).collect()
        assert {(r.set_id, r.cell): r.n for r in got} == want and len(got) == len(want)


def test_sums_by_counting_and_by_sorting():
    rng = np.random.default_rng(6)
    for spread in (5, 300, 10**9):
        cell, n = rng.integers(0, spread, 200), rng.integers(1, 9, 200)
        key, total = cube.summed(cell, n)
        assert {int(k): int(t) for k, t in zip(key, total)} == {int(k): int(n[cell == k].sum()) for k in cell}
        assert total.dtype == np.int64
    assert [len(x) for x in cube.summed(cell[:0], n[:0])] == [0, 0]
