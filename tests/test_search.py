import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from causeway.operators.scores import gaussian_bic
from causeway.plans.search import Pattern, bdeu_scorer, class_of, equivalence_search, extend_to_dag


def noisy_copy(rng, x, keep=0.9):
    return np.where(rng.random(len(x)) < keep, x, 1 - x)


def acyclic(parents):
    left = set(range(len(parents)))
    while left:
        free = {v for v in left if not (parents[v] & left)}
        if not free:
            return False
        left -= free
    return True


def test_collider_is_found_with_direction():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2, 4000), rng.integers(0, 2, 4000)
    c = noisy_copy(rng, a & b)
    found = equivalence_search(3, bdeu_scorer(np.column_stack([a, b, c]), [2, 2, 2]), 3)
    assert found == [set(), set(), {0, 1}]


def test_chain_has_the_right_skeleton_and_no_collider():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2, 4000)
    b = noisy_copy(rng, a)
    c = noisy_copy(rng, b)
    found = equivalence_search(3, bdeu_scorer(np.column_stack([a, b, c]), [2, 2, 2]), 3)
    assert {frozenset((v, w)) for v in range(3) for w in found[v]} == {frozenset((0, 1)), frozenset((1, 2))}
    assert found[1] != {0, 2}


def test_parent_cap_and_independence():
    rng = np.random.default_rng(3)
    xs = rng.integers(0, 2, (3000, 4))
    y = xs.sum(axis=1) > 2
    data = np.column_stack([xs, y])
    found = equivalence_search(5, bdeu_scorer(data, [2] * 5), 2)
    assert acyclic(found) and max(map(len, found)) <= 2
    noise = rng.integers(0, 3, (3000, 4))
    assert equivalence_search(4, bdeu_scorer(noise, [3] * 4), 3) == [set()] * 4


def test_equivalent_graphs_score_alike():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, 1000)
    y = (x + (rng.random(1000) < 0.2)) % 3
    s = bdeu_scorer(np.column_stack([x, y]), [3, 3])
    forward = sum(s([(0, frozenset()), (1, frozenset([0]))]))
    backward = sum(s([(1, frozenset()), (0, frozenset([1]))]))
    assert abs(forward - backward) < 1e-8


def test_gaussian_search_and_singular_parents():
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=3000), rng.normal(size=3000)
    c = a + b + 0.3 * rng.normal(size=3000)
    cov = np.cov(np.column_stack([a, b, c]), rowvar=False)
    found = equivalence_search(3, lambda ks: [gaussian_bic(cov, 3000, v, sorted(pa)) for v, pa in ks], 3)
    assert found == [set(), set(), {0, 1}]
    flat = np.ones((2, 2))
    assert np.isfinite(gaussian_bic(flat, 10, 0, [1]))
    assert gaussian_bic(flat, 10, 0, [1], det_epsilon=0.01) > gaussian_bic(flat, 10, 0, [], det_epsilon=0.01)


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 7), st.integers(0, 10_000))
def test_class_extension_round_trip(p, seed):
    rng = np.random.default_rng(seed)
    order = rng.permutation(p)
    parents = [set() for _ in range(p)]
    for i in range(p):
        for j in range(i):
            if rng.random() < 0.4:
                parents[order[i]].add(int(order[j]))
    cls = class_of(parents)
    back = extend_to_dag(cls)
    assert back is not None and acyclic(back)
    again = class_of(back)
    assert again.pa == cls.pa and again.nb == cls.nb


def test_pattern_without_extension():
    g = Pattern(4)
    for a, b in ((0, 1), (1, 2), (2, 3), (3, 0)):
        g.nb[a].add(b)
        g.nb[b].add(a)
    assert extend_to_dag(g) is None
