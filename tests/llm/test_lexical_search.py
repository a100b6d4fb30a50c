"""Ranked search against plain integer arithmetic."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from plain import lowered

from causeway.llm import lexical_search as L

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(lowered(text))


def brute(docs, items, k):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        rows = []
        for d, c in counts:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                    for t, q in Counter(terms(text)).items() if t in c)
            if s > 0:
                rows.append((-s, d is None, d or 0))
        out += [(item, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables():
    rng = np.random.default_rng(1)
    say = lambda n: "".join(rng.choice(["a", "B", "c", "d", "é", "zz9", "Q"]) + rng.choice([" ", "-", "_", "@", "\n"]) for _ in range(n))
    docs = [(int(k), say(int(n))) for k, n in enumerate(rng.integers(0, 25, 150))]
    docs += [(900, None), (901, ""), (902, " ,;"), (7, docs[7][1]), (None, docs[3][1]), (903, "é " * 5000 + "zz9"), *[(k, "a c d") for k in range(950, 1000)]]
    items = [(1, say(8)), (2, "a"), (3, None), (4, ""), (5, say(60)), (5, "zz9 zz9 é"), (None, "c d"), (6, "nowhere"), (7, "A C " * 3000)]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"block_bytes": 1}, {"k": 3, "tile_bytes": 50}])
def test_search(spark, tables, options):
    docs, items = tables
    df = spark.createDataFrame([(d, t, 1.5) for d, t in docs], "doc_id long, text string, score double").repartition(4)
    bench = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id int, text string, doc_id string")
    got = L.search(df, bench, **options)
    assert got.dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs, items, options.get("k", 20))


def test_tiles_of_terms_and_digits(monkeypatch):
    """More terms than a tile holds, and weights of several digits: sums stay exact."""
    monkeypatch.setattr(L, "TILE_TERMS", 16)
    rng = np.random.default_rng(2)
    rows = [(np.sort(rng.choice(100, 40, replace=False)), rng.integers(1, 2**35, 40)) for _ in range(5)]
    weights = rng.integers(0, 30, 100)
    doc, term = np.nonzero(rng.random((9, 100)) < 0.4)
    impact = rng.integers(1, 10**6, len(doc))
    got = L.ItemTile(0, rows, weights).scores(9, doc, term, impact)
    for i, (terms_, n) in enumerate(rows):
        w = dict(zip(terms_.tolist(), n.tolist()))
        for d in range(9):
            assert got[i, d] == sum(w.get(t, 0) * int(weights[t]) * int(x) for e, t, x in zip(doc, term, impact) if e == d)


def test_long_documents_in_a_large_corpus():
    """The product in a document's length norm may pass 64 bits."""
    n = np.array([10**9, 5], np.int64)
    got = L.impacts(n, np.array([3, 1]), 10**12, 10**13)
    assert got.tolist() == [3 * 10**9 // (3000 + 12 * (75 + 25 * 10**9 * 10**12 // 10**13)), 10**9 // (1000 + 12 * (75 + 25 * 5 // 10))]


def test_ties_at_the_cut():
    best = L.Best(1, 3)
    for ids in ([9, 8, 7, 6, 5], [4, 3], [10]):
        best.add(0, np.full(len(ids), 50), np.array(ids), np.array([i == 3 for i in ids]))
    best.add(0, np.array([60]), np.array([99]), np.array([False]))
    assert best.rows[0][0].tolist() == [60, 50, 50] and best.rows[0][1].tolist() == [99, 4, 5]


def test_nothing(spark, tables):
    df = spark.createDataFrame(tables[0], "doc_id long, text string")
    bench = spark.createDataFrame(tables[1], "item_id int, text string")
    assert L.search(df.limit(0), bench).count() == 0 and L.search(df, bench.limit(0)).count() == 0
