"""Systematic sampling against a plain comb, targets against rounds of resharing."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from causeway.llm import mixing as M


def level_by_rounds(sizes, limit=3):
    """Share by weight, stop what is above, share the excess again until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        share = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if share * weight[s] >= limit * sizes[s]}
        if not above:
            return target | {s: share * weight[s] for s in open_}
        for s in above:
            target[s] = limit * sizes[s]
            left -= target[s]
        open_ -= above
    return target


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(1)
    names = ["b", "a", "é", "z", None, "hot", "tiny"]
    rows = [(k, " ".join(["w"] * int(n)), "hot" if k % 3 == 0 else rng.choice(names[:5])) for k, n in enumerate(rng.integers(0, 60, 900))]
    rows = [(k, t, None if s is None else str(s)) for k, t, s in rows]
    return rows + [(2000, None, "b"), (2001, "", "none"), (2002, "x y\tz\x0b", "tiny"), (5, "w w", "a"), (5, "w w", "a"), (None, "w " * 30000, "z")]


def hexed(text, n):
    return int(hashlib.md5(text.encode()).hexdigest()[:n], 16)


def test_copies(spark, docs):
    df = spark.createDataFrame([(k, t, s, 1) for k, t, s in docs], "doc_id long, text string, source string, size int").repartition(5)
    got = M.copies(df).drop("_row").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    rows = defaultdict(list)
    for k, t, s in docs:
        sizes[s] += size(t)
        rows[s].append((size(t), hexed(f"12:{'' if k is None else k}", 15), k))
    target = level_by_rounds(sizes)
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6
    want = Counter()
    for s, own in rows.items():
        rate, start = target[s] / sizes[s] if sizes[s] else 0, hexed(f"12/{s or ''}", 13) / 2**52
        for i, (n, _, k) in enumerate(sorted(own, key=lambda r: (*r[:2], r[2] is None))):
            taken = math.floor((i + 1) * rate + start) - math.floor(i * rate + start)
            want[k, n, sizes[s], round(target[s], 6), taken, taken * n] += 1
    assert Counter((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.copies, r.taken) for r in got) == want
    assert all(r.taken <= 3 * r["size"] for r in got)
    assert {r.source_size * 3 for r in got if r.target == 3 * r.source_size} >= {0, 6}  # "none" and "tiny" stop


def test_mix_repeats_rows(spark, docs):
    df = spark.createDataFrame([(k, t, s, None) for k, t, s in docs], "doc_id long, text string, source string, copies string").repartition(3)
    want = Counter()
    for r in M.copies(df).collect():
        want[r.doc_id] += r.copies
    mixed = M.mix_sources(df)
    assert mixed.columns == df.columns
    assert Counter(r.doc_id for r in mixed.select("doc_id").collect()) == Counter({k: n for k, n in want.items() if n})


def test_words_near_the_target(spark):
    rng = np.random.default_rng(2)
    rows = [(k, "w " * int(n), f"s{k % 4}") for k, n in enumerate(rng.geometric(0.02, 4000))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken, target, largest = Counter(), {}, Counter()
    for r, (_, _, s) in zip(sorted(M.copies(df).collect(), key=lambda r: r.doc_id), rows):
        taken[s] += r.taken
        target[s] = r.target
        largest[s] = max(largest[s], r["size"])
    for s in target:
        assert abs(taken[s] - target[s]) <= largest[s]


def test_no_python(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    plan = M.copies(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.copies(df).count() == 0 and M.mix_sources(df).count() == 0
    df = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert [(r["size"], r.target, r.taken) for r in M.copies(df).collect()] == [(0, 0.0, 0)] * 2
