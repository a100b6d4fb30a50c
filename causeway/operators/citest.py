"""Conditional independence tests and the level-wise skeleton search."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb
from typing import NamedTuple, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from causeway.functions.mathx import chi2_tail
from causeway.operators import cube
from causeway.operators.counts import Family, family_counts
from causeway.operators.encode import Encoded
from causeway.session import broadcast_if_small, collect_bounded, durable, local_frame

RANKS = 10_000  # subsets that one row stands for before they are made


class Test(NamedTuple):
    """Is x independent of y given s? x < y by name, s sorted."""

    x: str
    y: str
    s: tuple[str, ...]


@F.pandas_udf(T.DoubleType())
def chi2_p(stat: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(s, d) for s, d in zip(stat, dof)])


def chi2_statistics(cells: DataFrame) -> DataFrame:
    """(test_id, stat, dof) from (test_id, stratum, x, y, n).

    Expected counts are row times column over total per stratum. Cells without rows need
    no rows here: the sum over all cells of (O-E)^2/E equals the sum of O^2/E over the
    occupied ones minus the total. Rows and columns without counts cost no freedom.
    """
    keys = ["test_id", "stratum"]
    rows = cells.groupBy(*keys, "x").agg(F.sum("n").alias("nx"))
    cols = cells.groupBy(*keys, "y").agg(F.sum("n").alias("ny"))
    size = rows.groupBy(*keys).agg(F.sum("nx").alias("nt"), F.count("*").alias("rx"))
    width = cols.groupBy(*keys).agg(F.count("*").alias("ry"))
    expected = F.col("nx") * F.col("ny") / F.col("nt")
    part = (
        cells.join(rows, [*keys, "x"]).join(cols, [*keys, "y"]).join(size, keys)
        .groupBy(*keys).agg(F.sum(F.col("n") * F.col("n") / expected).alias("ratio"))
    )
    per = part.join(size, keys).join(width, keys)
    return per.groupBy("test_id").agg(
        F.sum(F.col("ratio") - F.col("nt")).alias("stat"),
        F.sum((F.col("rx") - 1) * (F.col("ry") - 1)).alias("dof"),
    )


def cube_tests(encoded: Encoded, tests: Sequence[Test]) -> DataFrame:
    """(test_id, stat, dof, p) of any number of tests from one scan of the table: see ``cube``."""
    counted = cube.build(encoded, {tuple(sorted({t.x, t.y, *t.s})) for t in tests})
    return cube.test_statistics(counted, tests, encoded.cards).withColumn("p", chi2_p("stat", F.col("dof").cast("double")))


def ci_tests(encoded: Encoded, tests: Sequence[Test]) -> DataFrame:
    """(test_id, stat, dof, p) of some tests, each counted on its own in one pass over the table."""
    cards = encoded.cards
    families = [Family(i, t.y, (*t.s, t.x)) for i, t in enumerate(tests)]
    shape = local_frame(
        encoded.codes.sparkSession,
        [(i, cards[t.x], cards[t.y]) for i, t in enumerate(tests)],
        "family_id int, rx bigint, ry bigint",
    )
    cells = family_counts(encoded.codes, families, cards).join(broadcast_if_small(shape), "family_id")
    cells = cells.select(
        F.col("family_id").alias("test_id"), F.expr("cell div (rx * ry)").alias("stratum"),
        F.expr("(cell div ry) % rx").alias("x"), F.expr("cell % ry").alias("y"), "n",
    )
    stats = chi2_statistics(durable(cells))
    return stats.withColumn("p", chi2_p("stat", F.col("dof").cast("double")))


def decide(p: Column, alpha: float, borderline: float, advised: Column) -> Column:
    """independent / dependent; within the borderline the advised score (>= 0.5) decides.

    A distance of exactly ``borderline`` from alpha counts as dependent.
    """
    clear = (p > alpha) & (p - alpha > borderline)
    near = F.abs(p - alpha) < borderline
    return F.when(clear, "independent").when(
        near & (F.coalesce(advised, F.lit(0.0)) >= 0.5), "independent"
    ).otherwise("dependent")


def is_borderline(p: Column, alpha: float, borderline: float) -> Column:
    return F.abs(p - alpha) < borderline


class Skeleton(NamedTuple):
    edges: set[tuple[str, str]]
    sepsets: dict[tuple[str, str], tuple[str, ...]]


def subset_at(rank: int, size: int, width: int) -> list[int]:
    """Subset number ``rank`` of ``width`` out of ``size`` places, in order of the sorted places."""
    out, place = [], 0
    for left in range(width, 0, -1):
        while (skipped := comb(size - place - 1, left - 1)) <= rank:
            rank -= skipped
            place += 1
        out.append(place)
        place += 1
    return out


def level_tests(edges: DataFrame, depth: int) -> DataFrame:
    """(x, y, s): each adjacent pair (a, b) given each subset of ``depth`` other neighbours of either end.

    A pair has ranges of ranks, one row for ``RANKS`` subsets, and executors turn each rank into its subset.
    A subset of the neighbours of both ends comes from the first one only, so nothing has to be compared.
    """
    both = edges.select(F.col("a").alias("v"), F.col("b").alias("u")).union(edges.select("b", "a")).distinct()
    near = durable(both.groupBy("v").agg(F.array_sort(F.collect_list("u")).alias("us")))
    x = near.select(F.col("v").alias("x"), F.col("us").alias("ux"))
    y = near.select(F.col("v").alias("y"), F.col("us").alias("uy"))
    ordered = edges.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    pairs = ordered.join(broadcast_if_small(x), "x").join(broadcast_if_small(y), "y").select(
        "x", "y", F.array_remove("ux", F.col("y")).alias("ux"), F.array_remove("uy", F.col("x")).alias("uy"))
    sides = pairs.select("x", "y", F.col("ux").alias("from"), F.array().cast("array<string>").alias("not_in"))
    if depth:  # without a condition there is one test, made by the first end
        sides = sides.union(pairs.select("x", "y", "uy", "ux"))
    subsets = reduce(lambda n, i: f"({n} * (size(`from`) - {i}) div {i + 1})", range(depth), "1L")
    numbered = sides.where(F.size("from") >= depth).withColumn("subsets", F.expr(subsets))
    ranges = numbered.select(
        "x", "y", "from", "not_in", "subsets", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("subsets") - 1, F.lit(RANKS).cast("bigint"))).alias("start"))

    def unrank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seen = set(row["not_in"])
                found = []
                for rank in range(row["start"], min(row["subsets"], row["start"] + RANKS)):
                    s = [row["from"][i] for i in subset_at(rank, len(row["from"]), depth)]
                    if not seen or not seen.issuperset(s):
                        found.append(s)
                yield pa.RecordBatch.from_pydict({
                    "x": pa.array([row["x"]] * len(found), pa.string()), "y": pa.array([row["y"]] * len(found), pa.string()),
                    "s": pa.array(found, pa.list_(pa.string()))})

    return ranges.repartition("x", "y", "start").mapInArrow(unrank, "x string, y string, s array<string>")


def level_statistics(encoded: Encoded, tests: DataFrame, depth: int) -> DataFrame:
    """(x, y, s, stat, dof, p) of the written tests of one depth from one scan; see ``cube.block_statistics``."""
    stats = cube.block_statistics(encoded, tests, depth + 2)
    return stats.withColumn("p", chi2_p("stat", F.col("dof").cast("double")))


def skeleton(encoded: Encoded, alpha: float, borderline: float = 0.0,
             advisor=None, union_sets: bool = True) -> Skeleton:
    """Start complete; at each depth run every test, remove separated pairs at its end.

    The tests of a depth are made on executors and come from one scan of the table; only the separating set
    of each separated pair comes back. ``advisor`` maps a frame of borderline tests (test_id, x, y, s) to
    (test_id, score). With ``union_sets`` all sets that separate a pair are united, otherwise the one with
    the largest p is kept.
    """
    spark = encoded.codes.sparkSession
    names = sorted(encoded.columns)
    edges = set(combinations(names, 2))
    sepsets: dict[tuple[str, str], tuple[str, ...]] = {}
    depth = 0
    while edges:
        degree = Counter(v for e in edges for v in e)
        if max(degree.values()) <= depth:
            break
        tests = durable(level_tests(local_frame(spark, sorted(edges), "a string, b string"), depth))
        result = level_statistics(encoded, tests, depth).withColumn("test_id", F.array_join(F.concat(F.array("x", "y"), "s"), "\u0001"))
        if advisor is not None and borderline > 0:
            result = durable(result)
            near = result.where(is_borderline(F.col("p"), alpha, borderline)).select("test_id", "x", "y", "s")
            result = result.join(advisor(near), "test_id", "left")
        else:
            result = result.withColumn("score", F.lit(None).cast("double"))
        separated = result.where(decide(F.col("p"), alpha, borderline, F.col("score")) == "independent")
        chosen = F.array_sort(F.array_distinct(F.flatten(F.collect_list("s")))) if union_sets else F.max(F.struct("p", "s"))["s"]
        for row in collect_bounded(separated.groupBy("x", "y").agg(chosen.alias("s")), "separated pairs"):
            sepsets[row["x"], row["y"]] = tuple(row["s"])
            edges.discard((row["x"], row["y"]))
        depth += 1
    return Skeleton(edges, sepsets)
