"""Sufficient statistics: family contingency counts, moments and fitted CPTs."""

from __future__ import annotations

from typing import Iterable, Iterator, NamedTuple, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from causeway.operators.encode import Encoded, encode_table
from causeway.session import collect_bounded, durable, local_frame

DENSE_CELLS = 1 << 16
FLUSH_CELLS = 2_000_000
MAX_CELLS = 1 << 62


class Family(NamedTuple):
    """A child with its ordered parents."""

    id: int
    child: str
    parents: tuple[str, ...]


def group_counts(df: DataFrame, child: str, parents: Sequence[str]) -> DataFrame:
    """Counts of one family by plain grouping: parents, child, n."""
    return df.groupBy(*parents, child).agg(F.count("*").alias("n"))


def strides(parents: Sequence[str], child: str, cards: dict[str, int]) -> list[int]:
    """Mixed-radix strides of (parents..., child); the child is the fastest digit."""
    out, step = [], 1
    for name in [child, *reversed(parents)]:
        out.append(step)
        step *= max(1, cards[name])
    if step > MAX_CELLS:
        raise ValueError(f"family of {child} has too many cells")
    return list(reversed(out))


def distinct_rows(codes: DataFrame, columns: Sequence[str], weight: str) -> DataFrame:
    """The distinct rows of ``columns`` with their number ``weight``, written once."""
    return durable(codes.groupBy(*columns).agg(F.count("*").alias(weight)))


def family_counts(codes: DataFrame, families: Sequence[Family],
                  cards: dict[str, int], weight: str | None = None) -> DataFrame:
    """(family_id, cell, n) of many families in one scan; a row counts ``weight`` times, or once.

    Each task counts all families over its own rows and emits only the cells it saw;
    Spark then sums the partial counts. The shuffle carries cells, not rows, so a state
    that holds a third of the rows is no larger than any other.
    """
    used = sorted({c for f in families for c in (f.child, *f.parents)})
    read = used if weight is None else [*used, weight]
    layout = [
        (f.id, [used.index(c) for c in (*f.parents, f.child)],
         strides(f.parents, f.child, cards),
         int(np.prod([float(cards[c]) for c in (*f.parents, f.child)])))
        for f in families
    ]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        dense: dict[int, np.ndarray] = {}
        sparse: dict[int, list] = {}
        held = 0

        def flush() -> Iterator[pd.DataFrame]:
            for fid, arr in dense.items():
                cell = np.flatnonzero(arr)
                yield pd.DataFrame({"family_id": fid, "cell": cell, "n": arr[cell]})
            for fid, parts in sparse.items():
                cell = np.concatenate([p[0] for p in parts])
                n = np.concatenate([p[1] for p in parts])
                key, inverse = np.unique(cell, return_inverse=True)
                total = np.zeros(len(key), dtype=np.int64)
                np.add.at(total, inverse, n)
                yield pd.DataFrame({"family_id": fid, "cell": key, "n": total})
            dense.clear()
            sparse.clear()

        for pdf in batches:
            data = [pdf[c].to_numpy(dtype=np.int64) for c in used]
            times = None if weight is None else pdf[weight].to_numpy(dtype=np.int64)
            for fid, cols, step, space in layout:
                cell = sum(data[c] * s for c, s in zip(cols, step))
                if space <= DENSE_CELLS:
                    if times is None:
                        add = np.bincount(cell, minlength=space)
                    else:
                        add = np.zeros(space, dtype=np.int64)
                        np.add.at(add, cell, times)
                    dense[fid] = dense[fid] + add if fid in dense else add
                else:
                    part = np.unique(cell, return_counts=True) if times is None else (cell, times)
                    sparse.setdefault(fid, []).append(part)
                    held += len(part[0])
            if held > FLUSH_CELLS:
                yield from flush()
                held = 0
        yield from flush()

    return (
        codes.select(*read)
        .mapInPandas(partial, "family_id int, cell bigint, n bigint")
        .groupBy("family_id", "cell")
        .agg(F.sum("n").alias("n"))
    )


def family_frame(spark, families: Iterable[Family], states: dict[str, list[str]]) -> DataFrame:
    """Family descriptions: names, state lists and strides, for decoding cells."""
    rows = []
    for f in families:
        cards = {c: len(states[c]) for c in (f.child, *f.parents)}
        steps = strides(f.parents, f.child, cards)
        rows.append((
            f.id, f.child, list(f.parents), states[f.child],
            [states[p] for p in f.parents], steps[:-1], cards[f.child],
            float(np.prod([float(cards[p]) for p in f.parents])) if f.parents else 1.0,
        ))
    return local_frame(
        spark, rows,
        "family_id int, node string, parents array<string>, states array<string>, "
        "parent_states array<array<string>>, steps array<bigint>, r bigint, q double",
    )


def decode_counts(counts: DataFrame, meta: DataFrame) -> DataFrame:
    """Cells as (node, parents, cfg = parent states, state, n)."""
    joined = counts.join(F.broadcast(meta), "family_id")
    # digit i of the cell = (cell div step_i) mod number of states of parent i
    cfg = F.expr(
        "transform(parent_states, (s, i) -> s[cast((cell div steps[i]) % size(s) as int)])"
    )
    return joined.select(
        "family_id", "node", "parents", cfg.alias("cfg"),
        F.expr("states[cast(cell % r as int)]").alias("state"), "states", "r", "n",
    )


def fit_cpts(encoded: Encoded, families: Sequence[Family]) -> DataFrame:
    """Maximum-likelihood CPTs: (family_id, node, parents, cfg, states, counts, probs).

    One row per parent configuration that occurs; ``probs`` follows ``states``. A
    configuration that never occurs has no row and means a uniform distribution.
    """
    spark = encoded.codes.sparkSession
    meta = family_frame(spark, families, encoded.states)
    cells = decode_counts(family_counts(encoded.codes, families, encoded.cards), meta)
    grouped = cells.groupBy("family_id", "node", "parents", "cfg", "states").agg(
        F.map_from_entries(F.collect_list(F.struct("state", "n"))).alias("seen"),
        F.sum("n").alias("total"),
    )
    counts = F.transform("states", lambda s: F.coalesce(F.col("seen")[s], F.lit(0).cast("bigint")))
    return grouped.select(
        "family_id", "node", "parents", "cfg", "states", counts.alias("counts"), "total"
    ).withColumn("probs", F.transform("counts", lambda n: n / F.col("total")))


def cpt_rows(cpt: DataFrame) -> DataFrame:
    """CPT as long rows (node, cfg, state, n, p)."""
    zipped = F.explode(F.arrays_zip("states", "counts", "probs")).alias("z")
    return cpt.select("family_id", "node", "parents", "cfg", zipped).select(
        "family_id", "node", "parents", "cfg",
        F.col("z.states").alias("state"), F.col("z.counts").alias("n"),
        F.col("z.probs").alias("p"),
    )


def pair_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, rows, n, cov, va, vb) for a <= b in column order, over the ``n`` rows that have both values.

    Tasks emit one row of sums per pair, taken about the column means; Spark adds them up. NULL and NaN
    count as missing, and pairs with fewer than two rows have NULL moments.
    """
    columns = list(columns)
    data = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    means = data.agg(*[F.avg(F.nanvl(c, F.lit(None).cast("double"))).alias(c) for c in columns]).first()
    means = np.array([means[c] or 0.0 for c in columns])
    a, b = np.triu_indices(len(columns))
    sums_of = ("n", "sx", "sy", "sxy", "sxx", "syy")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(sums_of), len(columns), len(columns)))
        rows = 0
        for pdf in batches:
            x = pdf[columns].to_numpy(dtype=float) - means
            have = ~np.isnan(x)
            x, m = np.where(have, x, 0.0), have.astype(float)
            sums += np.stack([m.T @ m, x.T @ m, m.T @ x, x.T @ x, (x * x).T @ m, m.T @ (x * x)])
            rows += len(pdf)
        yield pd.DataFrame({"i": a, "j": b, "rows": rows, **dict(zip(sums_of, sums[:, a, b]))})

    names = F.array(*[F.lit(c) for c in columns])
    totals = data.mapInPandas(
        partial, "i int, j int, rows bigint, " + ", ".join(f"{c} double" for c in sums_of)
    ).groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("rows", *sums_of)])

    def moment(xy: str, x: str, y: str) -> Column:
        return F.when(F.col("n") > 1, (F.col(xy) - F.col(x) * F.col(y) / F.col("n")) / (F.col("n") - 1))

    return totals.select(
        names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), "rows", "n", moment("sxy", "sx", "sy").alias("cov"),
        moment("sxx", "sx", "sx").alias("va"), moment("syy", "sy", "sy").alias("vb"),
    )


def covariance(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, cov, n) for a <= b in column order: sample covariance of pairs of values, number of all rows."""
    return pair_moments(df, columns).select("a", "b", "cov", F.col("rows").alias("n"))


def correlation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(a, b, corr) over all ordered pairs; NULL where a column does not vary."""
    varies = (F.col("va") > 0) & (F.col("vb") > 0)
    half = pair_moments(df, columns).select(
        "a", "b", F.when(varies, F.col("cov") / F.sqrt(F.col("va") * F.col("vb"))).alias("corr"))
    mirror = half.where(F.col("a") != F.col("b")).select(
        F.col("b").alias("a"), F.col("a").alias("b"), "corr"
    )
    return half.unionByName(mirror)


def covariance_matrix(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, int]:
    """The covariance as a p-by-p array (variables only, never rows)."""
    index = {c: i for i, c in enumerate(columns)}
    out = np.zeros((len(columns), len(columns)))
    n = 0
    for row in collect_bounded(covariance(df, columns), "covariance"):
        i, j = index[row["a"]], index[row["b"]]
        out[i, j] = out[j, i] = row["cov"] or 0.0
        n = row["n"]
    return out, int(n)
