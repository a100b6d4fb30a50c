"""Ranks and running sums over a whole table, without a window that takes all rows into one task.

Rows are range-partitioned by the order, so equal-sized slices of it are sorted side by side. A row's
place in its slice and the sums of all earlier slices give its place in the table; only one row per
slice (and per group, if there are groups) is ever brought together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.session import broadcast_if_small, durable

PLACE_BITS = 33  # of monotonically_increasing_id: the lower ones count rows inside a partition


def sorted_slices(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` written once in sorted slices, with ``_slice`` and the place ``_at`` (from 0) in the slice.

    The order should be total, else rows that tie get any order among themselves.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    return durable(placed.select(
        "*", F.shiftright("_id", PLACE_BITS).alias("_slice"),
        F.col("_id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).alias("_at"),
    ).drop("_id"))


def _before(sums: DataFrame, value: str, name: str, group: list[str] = []) -> DataFrame:  # noqa: B006
    """Running sum of ``value`` over earlier slices; one row per slice, so one window may hold them."""
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    w = w.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return sums.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def global_rank(df: DataFrame, order: list[Column], name: str = "rank", group: str | None = None) -> DataFrame:
    """``df`` with a BIGINT ``name``: the row's place from 0 in ``order``, inside its group if one is named.

    NULLs stand where the order puts them, NULL groups are a group, an empty table stays empty. A hot
    group only spans more slices. ``df`` is run twice (bounds, then rows): write it first if it is a
    join. Columns ``_slice``, ``_at`` and ``_first`` are taken.
    """
    by = ([F.col(group).asc_nulls_last()] if group else []) + order
    rows = sorted_slices(df, by)
    counts = rows.groupBy("_slice").agg(F.count("*").alias("_n"))
    offsets = broadcast_if_small(_before(counts, "_n", "_first").select("_slice", "_first"))
    out = rows.join(offsets, "_slice").withColumn(name, F.col("_first") + F.col("_at")).drop("_slice", "_at", "_first")
    if group is None:
        return out
    starts = out.groupBy(F.col(group).alias("_group")).agg(F.min(name).alias("_first"))
    starts = broadcast_if_small(starts)
    out = out.join(starts, F.col(group).eqNullSafe(F.col("_group")))
    return out.withColumn(name, F.col(name) - F.col("_first")).drop("_group", "_first")


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """``df`` with, for each entry of ``sums`` (new name: column), the sum of that column up to and with the row.

    NULL counts as 0. Inside a slice a window adds up the rows, so a task holds one slice.
    """
    rows = sorted_slices(df, order)
    totals = rows.groupBy("_slice").agg(*[F.sum(c).alias(f"_t{k}") for k, c in enumerate(sums.values())])
    for k in range(len(sums)):
        totals = _before(totals, f"_t{k}", f"_b{k}")
    totals = broadcast_if_small(totals.select("_slice", *[f"_b{k}" for k in range(len(sums))]))
    w = Window.partitionBy("_slice").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.select("*", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_s{k}") for k, c in enumerate(sums.values())])
    out = out.join(totals, "_slice")
    return out.select(*df.columns, *[(F.col(f"_s{k}") + F.col(f"_b{k}")).alias(name) for k, name in enumerate(sums)])
