"""Reproducible samples of rows and columns, splits and targeted plans."""

from __future__ import annotations

import math
from typing import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.functions.hashing import BITS, hash_bits, hash_key, hash_unit

SIGMAS = 8
SPLIT_FAN = 4096
SPLIT_ROWS = 50_000


def membership_rate(total: int, k: int) -> float:
    """Rate at which a row joins a sample before the exact cut to ``k`` rows.

    Eight standard deviations above k, so that falling short is practically impossible
    (callers still check the exact size).
    """
    if k >= total:
        return 1.0
    return min(1.0, (k + SIGMAS * math.sqrt(k) + 32) / total)


def membership(key: Sequence[Column], num_samples: int, rate: float, seed: int,
               portable: bool = False) -> tuple[Column, Column]:
    """(keep, samples): whether a row joins any sample, and the ids it joins.

    Instead of one draw per (row, sample), the distance to the next joined sample is
    drawn from a geometric distribution. Most rows of a large table leave after one draw.
    """
    if rate >= 1.0:
        return F.lit(True), F.sequence(F.lit(0), F.lit(num_samples - 1))
    log_miss = math.log1p(-rate)

    def gap(i: Column | int) -> Column:
        u = hash_unit(*key, seed, "gap", i, portable=portable)
        return F.least(F.floor(F.ln(u) / F.lit(log_miss)), F.lit(num_samples)).cast("int")

    start = F.struct(gap(0).alias("pos"), F.array().cast("array<int>").alias("ids"))

    def step(acc: Column, i: Column) -> Column:
        # one step: record the current position, jump to the next one
        jumped = F.struct(
            (acc["pos"] + 1 + gap(i)).alias("pos"),
            F.concat(acc["ids"], F.array(acc["pos"])).alias("ids"),
        )
        return F.when(acc["pos"] >= num_samples, acc).otherwise(jumped)

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(num_samples)), start, step, lambda acc: acc["ids"])
    return gap(0) < num_samples, walk


def sample_rows(df: DataFrame, key: Sequence[str], num_samples: int, k: int, seed: int,
                total: int | None = None, portable: bool = False,
                partitions: int | None = None,
                shape: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Draw ``num_samples`` row samples without replacement, exactly min(rows, k) each.

    ``key`` must identify rows. Adds ``sample_id``. The table is scanned once and only the
    drawn rows are shuffled; one group holds about k rows whatever the table size.
    ``shape`` can slim drawn rows (which must keep key and ``sample_id``) before the shuffle.
    """
    total = df.count() if total is None else total
    cols = [F.col(c) for c in key]
    keep, ids = membership(cols, num_samples, membership_rate(total, k), seed, portable)
    drawn = df.where(keep).withColumn("sample_id", F.explode(ids))
    if shape is not None:
        drawn = shape(drawn)
    drawn = drawn.withColumn(
        "draw", hash_bits(*cols, F.col("sample_id") + seed, "rank", portable=portable)
    )
    if partitions:
        drawn = drawn.repartition(partitions, "sample_id")
    order = Window.partitionBy("sample_id").orderBy("draw", *key)
    return drawn.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= k).drop("draw")


def sample_columns(samples: DataFrame, columns: Sequence[str] | Column, k: int, seed: int,
                   portable: bool = False, forced: str | None = None) -> DataFrame:
    """Add ``cols``: k columns per sample, forced ones first, the rest in hash order."""
    pool = columns if isinstance(columns, Column) else F.array(*[F.lit(c) for c in columns])
    picked = F.array().cast("array<string>")
    if forced is not None:
        picked = F.slice(F.filter(F.array_distinct(forced), lambda c: F.array_contains(pool, c)), 1, k)
    keyed = F.transform(
        F.array_except(pool, picked),
        lambda c: F.struct(
            hash_bits(F.col("sample_id") + seed, c, portable=portable).alias("h"), c.alias("c")
        ),
    )
    fill = F.transform(F.array_sort(keyed), lambda s: s["c"])
    return samples.withColumn("cols", F.slice(F.concat(picked, fill), 1, k))


def sample_columns_weighted(samples: DataFrame, columns: Sequence[str], k: int, seed: int,
                            related: Mapping[str, set[str]], weight: float,
                            forced: str | None = None) -> DataFrame:
    """Add ``cols`` by successive draws that favour relatives of columns already drawn.

    A column related to any drawn column has ``weight``, others 1; the weight does not
    compound. Each sample is one row, so this is a per-row map over the plan table.
    """
    columns = list(columns)
    base = samples.withColumn(
        "forced_cols", F.col(forced) if forced else F.array().cast("array<string>")
    )

    def draw(sample_id: int, start: Sequence[str]) -> list[str]:
        rng = np.random.default_rng(seed + int(sample_id))
        chosen = [c for c in dict.fromkeys(start) if c in columns][:k]
        while len(chosen) < min(k, len(columns)):
            rest = [c for c in columns if c not in chosen]
            near = set().union(*(related.get(c, set()) for c in chosen)) if chosen else set()
            w = np.array([weight if c in near else 1.0 for c in rest])
            chosen.append(rest[int(np.searchsorted(np.cumsum(w), rng.random() * w.sum(), "right"))])
        return chosen

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.assign(
                cols=[draw(s, f) for s, f in zip(pdf["sample_id"], pdf["forced_cols"])]
            )
            yield pdf.drop(columns="forced_cols")

    schema = samples.select("*", F.array().cast("array<string>").alias("cols")).schema
    return base.mapInPandas(run, schema)


def sample_plan(spark: SparkSession, num_samples: int,
                forced: Sequence[Sequence[str]] | None = None) -> DataFrame:
    """(sample_id, forced): one row per sample; forced lists must match the count."""
    if forced is not None and len(forced) != num_samples:
        raise ValueError(f"{len(forced)} forced column lists for {num_samples} samples")
    if forced is None:
        return spark.range(num_samples).select(
            F.col("id").cast("int").alias("sample_id"),
            F.array().cast("array<string>").alias("forced"),
        )
    return spark.createDataFrame(
        [(i, list(f)) for i, f in enumerate(forced)], "sample_id int, forced array<string>"
    )


def targeted_plan(uncertain: DataFrame, suggestions: DataFrame, k: int,
                  repeats: int) -> DataFrame:
    """(node, repeat, forced): the node, its candidates and the suggested columns.

    ``uncertain`` has (node, candidates array), ``suggestions`` (node, cols array).
    """
    room = max(2, k - 1)
    joined = uncertain.join(suggestions, "node", "left")
    wanted = F.concat(
        F.array("node"), "candidates", F.coalesce("cols", F.array().cast("array<string>"))
    )
    return joined.select(
        "node", F.slice(F.array_distinct(wanted), 1, room).alias("forced"),
        F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"),
    )


def hash_cut(df: DataFrame, key: Sequence[str], seed: int, m: int,
             portable: bool = False) -> Column:
    """Predicate true for exactly the ``m`` rows with the smallest hash.

    The m-th hash is found by narrowing a range: each pass counts rows in 4096 slices,
    until few enough rows are left to order them. No global sort.
    """
    cols = [F.col(c) for c in key]
    bits, text = hash_bits(*cols, seed, "cut", portable=portable), hash_key(*cols)
    hashed = df.select(bits.alias("h"), text.alias("k"))
    if m <= 0:
        return F.lit(False)
    lo, width, rank = 0, 1 << BITS, m
    while width > 1:
        step = max(1, width // SPLIT_FAN)
        inside = hashed.where((F.col("h") >= lo) & (F.col("h") < lo + width))
        counts = inside.groupBy(F.expr(f"(h - {lo}L) div {step}L").alias("slot")).count()
        total = 0
        for row in counts.orderBy("slot").collect():
            if total + row["count"] >= rank:
                break
            total += row["count"]
        else:
            return F.lit(True)
        rank -= total
        lo, width = lo + row["slot"] * step, step
        if row["count"] <= SPLIT_ROWS:
            break
    inside = hashed.where((F.col("h") >= lo) & (F.col("h") < lo + width))
    last = inside.orderBy("h", "k").limit(rank).agg(F.max(F.struct("h", "k")).alias("x")).first()["x"]
    return (bits < last["h"]) | ((bits == last["h"]) & (text <= F.lit(last["k"])))


def split_exact(df: DataFrame, key: Sequence[str], fraction: float, seed: int,
                portable: bool = False) -> DataFrame:
    """Add ``is_train``: exactly floor(rows * fraction) rows are in the training part."""
    if not 0.0 < fraction < 1.0:
        raise ValueError("fraction must lie strictly between 0 and 1")
    m = math.floor(df.count() * fraction)
    return df.withColumn("is_train", hash_cut(df, key, seed, m, portable))
