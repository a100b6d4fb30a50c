"""Registered queries against their SQL oracles.

A quick selection runs by default; CAUSEWAY_ALL_ORACLES=1 runs every pair.
"""

import os

import pytest

import oracle
from causeway.plans import catalog

QUICK = [
    "codebook", "encoded_rows", "family_batch", "cpt", "bdeu_local", "covariance", "correlation", "sample_rows", "split_exact",
    "edge_votes", "cooccurrence", "direction_resolution", "parent_ranking", "uncertain_edges", "trajectory", "advice_order",
    "edge_digest", "descendants", "markov_blankets", "v_structures", "chi2_tests", "posterior", "predict_table",
    "structure_report", "question_report", "across_trials", "usage_summary", "request_keys", "cache_split", "parse_lists",
    "network_files", "sweep_expansion",
]
CHOSEN = sorted(catalog.ORACLES) if os.environ.get("CAUSEWAY_ALL_ORACLES") else QUICK


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", CHOSEN)
def test_oracle(spark, sf, con, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    assert oracle.difference(got, con.execute(catalog.ORACLES[name]).df()) is None


def test_every_oracle_has_a_query():
    assert set(catalog.ORACLES) <= set(catalog.QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["parent", "child", "n", "cooc", "freq"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
