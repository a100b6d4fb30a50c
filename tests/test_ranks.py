"""Global ranks and running sums against sorted Python lists."""

import random

import pytest
from pyspark.sql import functions as F

from causeway.operators.ranks import global_rank, running_sums


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(k, rng.choice(["a", "b", "c", None]), rng.randrange(40), rng.choice([None, 1.0, 2.5])) for k in range(700)]
    return [(k, "hot", v, x) if k % 3 == 0 else (k, g, v, x) for k, g, v, x in out]


def test_global_rank(spark, rows):
    df = spark.createDataFrame(rows, "k long, g string, v int, x double").repartition(5)
    got = {r.k: r.rank for r in global_rank(df, [F.desc("v"), F.asc("k")]).collect()}
    assert got == {k: i for i, (k, *_) in enumerate(sorted(rows, key=lambda r: (-r[2], r[0])))}


def test_rank_in_groups(spark, rows):
    df = spark.createDataFrame(rows, "k long, g string, v int, x double").repartition(5)
    got = {r.k: r.at for r in global_rank(df, [F.asc("v"), F.asc("k")], "at", group="g").collect()}
    want = {}
    for g in {r[1] for r in rows}:
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (r[2], r[0]))
        want |= {r[0]: i for i, r in enumerate(own)}
    assert got == want


def test_running_sums(spark, rows):
    df = spark.createDataFrame(rows, "k long, g string, v int, x double").repartition(5)
    got = {r.k: (r.sv, r.sx) for r in running_sums(df, [F.asc("v"), F.asc("k")], {"sv": "v", "sx": "x"}).collect()}
    v = x = 0
    for k, _, a, b in sorted(rows, key=lambda r: (r[2], r[0])):
        v, x = v + a, x + (b or 0)
        assert got[k] == (v, x)


def test_empty(spark):
    df = spark.createDataFrame([], "k long, g string, v int")
    assert global_rank(df, [F.asc("k")], group="g").count() == 0
    assert running_sums(df, [F.asc("k")], {"s": "v"}).columns == ["k", "g", "v", "s"]
