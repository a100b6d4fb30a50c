"""Steps of the full-table learners count distinct rows."""

import numpy as np

from causeway.config import FullSearchConfig
from causeway.operators import counts, scores
from causeway.operators.counts import Family, distinct_rows, family_counts
from causeway.operators.encode import encode_table
from causeway.plans import full_table


def rows(spark, n=900):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 3, n)
    b = np.where(rng.random(n) < 0.9, a, 0)
    c = rng.integers(0, 2, n)
    listed = [(i, f"a{x}", None if y == 2 else f"b{y}", f"c{z}") for i, (x, y, z) in enumerate(zip(a.tolist(), b.tolist(), c.tolist()))]
    return spark.createDataFrame(listed, "row_id long, rows0 string, b string, c string")


def test_greedy_steps_count_distinct_rows(spark, monkeypatch):
    df = rows(spark)
    read = []

    def counted(codes, *rest):
        read.append(codes.count())
        return family_counts(codes, *rest)

    monkeypatch.setattr(scores, "family_counts", counted)
    found = full_table.greedy_search(df, FullSearchConfig(max_parents=2), key="row_id")
    assert read and max(read) <= 3 * 3 * 2
    monkeypatch.setattr(full_table, "GROUPED_SPACE", 0)
    read.clear()
    assert full_table.greedy_search(df, FullSearchConfig(max_parents=2), key="row_id") == found and found
    assert set(read) == {900}


def test_weighted_counts(spark, monkeypatch):
    encoded = encode_table(rows(spark), ["rows0", "b", "c"])
    families = [Family(0, "b", ("rows0",)), Family(1, "c", ("b", "rows0")), Family(2, "c", ())]
    few = distinct_rows(encoded.codes, ["rows0", "b", "c"], "n")
    want = sorted(map(tuple, family_counts(encoded.codes, families, encoded.cards).collect()))
    assert sorted(map(tuple, family_counts(few, families, encoded.cards, "n").collect())) == want
    monkeypatch.setattr(counts, "DENSE_CELLS", 0)
    assert sorted(map(tuple, family_counts(few, families, encoded.cards, "n").collect())) == want
