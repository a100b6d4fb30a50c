"""Projections and encodings of a wide categorical table."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.operators.ranks import global_rank
from causeway.session import BROADCAST_ROWS, broadcast_if_small, collect_bounded, durable, is_scan, local_frame, spread

MAX_STATES = 100_000
INLINE_STATES = 64


def drop_columns(df: DataFrame, ignored: Sequence[str]) -> DataFrame:
    """Drop the ignored columns; names that are absent are skipped."""
    return df.drop(*ignored)


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def as_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Every (listed) column as a string without NULLs; the rest is kept as it is."""
    columns = set(columns if columns is not None else df.columns)
    return df.select(
        *[
            F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in columns else F.col(c)
            for c in df.columns
        ]
    )


def long_form(df: DataFrame, key: Sequence[str], columns: Sequence[str],
              name: str = "var", value: str = "state") -> DataFrame:
    """One row per (row, variable)."""
    return df.unpivot(list(key), list(columns), name, value)


def state_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(var, state, n) over all columns in one pass."""
    text = as_text(df.select(*columns))
    return text.unpivot([], list(columns), "var", "state").groupBy("var", "state").agg(
        F.count("*").alias("n")
    )


def dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(var, state, n, code BIGINT): codes count from 0 in the order of a column's states.

    Codes are ranks over range-partitioned slices, so a column may have as many states as rows.
    """
    return global_rank(durable(state_counts(df, columns)), [F.asc("state")], "code", group="var")


def codebook(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(var, state, n, code INT): see ``dictionary``."""
    return dictionary(df, columns).withColumn("code", F.col("code").cast("int"))


def encode_wide(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` and the BIGINT codes of ``columns``, whatever the number of states; no state reaches the driver.

    A column's states are joined by a broadcast while they are counted to be few, else by a shuffle on the
    state that splits hot ones.
    """
    text = as_text(df.select(*keep, *columns), columns)
    text = text if is_scan(df) else durable(text)
    book = durable(dictionary(text, columns).drop("n"))
    out = text
    for c in columns:
        own = book.where(F.col("var") == c).select(F.col("state").alias(c), F.col("code").alias(f"{c}__code"))
        out = out.join(broadcast_if_small(own), c)
    return out.select(*keep, *[F.col(f"{c}__code").alias(c) for c in columns])


def cardinalities(book: DataFrame) -> DataFrame:
    return book.groupBy("var").agg((F.max("code") + 1).alias("r"))


def state_catalogue(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(var, states): sorted distinct non-null states of each column."""
    text = df.select(*[F.col(c).cast("string").alias(c) for c in columns])
    return (
        text.unpivot([], list(columns), "var", "state")
        .where(F.col("state").isNotNull())
        .groupBy("var", "state").count()
        .groupBy("var")
        .agg(F.array_sort(F.collect_list("state")).alias("states"))
    )


@dataclass(frozen=True)
class Encoded:
    """Integer-coded table plus the states behind the codes."""

    codes: DataFrame
    columns: tuple[str, ...]
    states: dict[str, list[str]]

    @property
    def cards(self) -> dict[str, int]:
        return {c: len(self.states[c]) for c in self.columns}


def encode_table(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (),
                 max_states: int = MAX_STATES, pin: bool = True) -> Encoded:
    """Replace the states of ``columns`` by their codes, keeping the ``keep`` columns.

    One aggregate over the source finds the states, a second pass writes the codes; a source that is
    more than a scan of files is written first, so its joins run once. Codes are looked up with one
    join per column. The state lists are broadcast when their counted size allows it and joined by
    shuffle otherwise. The result is written once, because searches read it many times. The states of
    all columns stand on the driver; ``encode_wide`` does without.
    """
    columns = list(columns)
    out = spread(as_text(df.select(*keep, *columns), columns))
    out = out if is_scan(df) else durable(out)
    found = collect_bounded(
        state_counts(out, columns).select("var", "state"), "states", max_states * len(columns)
    )
    states: dict[str, list[str]] = {c: [] for c in columns}
    for row in found:
        states[row["var"]].append(row["state"])
    for c in columns:
        if len(states[c]) > max_states:
            raise ValueError(f"more than {max_states} states in {c}")
        states[c].sort()
    coded = []
    for c in columns:
        if len(states[c]) <= INLINE_STATES:
            known = F.array(*[F.lit(s) for s in states[c]])
            coded.append((F.array_position(known, F.col(c)) - 1).cast("int").alias(c))
            continue
        listed = [(s, i) for i, s in enumerate(states[c])]
        side = local_frame(df.sparkSession, listed, f"`{c}` string, `{c}__code` int")
        out = out.join(F.broadcast(side) if len(states[c]) <= BROADCAST_ROWS else side, c, "left")
        coded.append(F.col(f"{c}__code").alias(c))
    out = out.select(*keep, *coded)
    return Encoded(durable(out) if pin else out, tuple(columns), states)


def numeric_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(var, numeric): a column is numeric only if every value parses as a number."""
    def parses(c: str) -> Column:
        num = F.expr(f"try_cast(`{c}` AS DOUBLE)")
        return (F.count_if(num.isNotNull() & ~F.isnan(num)) == F.count("*")).alias(c)

    flags = df.agg(*[parses(c) for c in columns])
    return flags.unpivot([], list(columns), "var", "numeric")


def numeric_or_code(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Doubles for numeric columns, sorted codes (as doubles) for the others."""
    flags = {r["var"]: r["numeric"]
             for r in collect_bounded(numeric_columns(df, columns), "column kinds")}
    textual = [c for c in columns if not flags[c]]
    numeric = [c for c in columns if flags[c]]
    base = df.select(
        *keep, *textual,
        *[F.expr(f"try_cast(`{c}` AS DOUBLE)").alias(c) for c in numeric],
    )
    if textual:
        base = encode_table(base, textual, keep=[*keep, *numeric], pin=False).codes
    return base.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns])


def first_seen_codes(df: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """(var, state, first_row, code): codes in order of first appearance."""
    text = as_text(df.select(row_id, *columns), columns)
    first = (
        text.unpivot([row_id], list(columns), "var", "state")
        .groupBy("var", "state")
        .agg(F.min(row_id).alias("first_row"))
    )
    ranked = global_rank(first, [F.asc("first_row"), F.asc("state")], "code", group="var")
    return ranked.withColumn("code", F.col("code").cast("int"))


def evidence(context: Column, nodes: Sequence[str] | Column, target: Column) -> Column:
    """Context restricted to known nodes other than the target, without NULL values."""
    known = nodes if isinstance(nodes, Column) else F.array(*[F.lit(n) for n in nodes])
    return F.map_filter(
        context, lambda k, v: F.array_contains(known, k) & (k != target) & v.isNotNull()
    )


def clean_edges(edges: DataFrame, nodes: DataFrame, order: str) -> DataFrame:
    """Edges between known nodes, without self loops, first occurrence of each pair."""
    return (
        edges.where(F.col("parent") != F.col("child"))
        .join(nodes.select(F.col("node").alias("parent")).distinct(), "parent", "left_semi")
        .join(nodes.select(F.col("node").alias("child")).distinct(), "child", "left_semi")
        .groupBy("parent", "child")
        .agg(F.min(order).alias(order))
    )


def adjacency(edges: DataFrame, nodes: Sequence[str]) -> DataFrame:
    """0/1 matrix: one row per parent, one column per child, all nodes on both sides."""
    spark = edges.sparkSession
    base = local_frame(spark, [(n,) for n in nodes], "parent string")
    hit = edges.groupBy("parent").pivot("child", list(nodes)).agg(F.lit(1))
    return base.join(hit, "parent", "left").select(
        "parent", *[F.coalesce(F.col(f"`{n}`"), F.lit(0)).cast("int").alias(n) for n in nodes]
    )
