"""Shared helpers: row keys, words, text batches and registration.

Every operator takes a frame with ``doc_id`` and ``text`` (names are parameters) and ignores all
other columns, so further columns of any name do no harm. A NULL text counts as an empty one unless
an operator says otherwise, rows are never told apart by ``doc_id`` alone, and an empty table gives
an empty result of the same schema.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.session import drop, durable

QUERIES: dict = {}
ORACLES: dict = {}

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# UTF-8 bytes: A-Z become a-z, other ASCII characters that are no digit or letter become blanks
WORD_BYTES = bytes(
    b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` as a query, with an SQL statement that gives the same rows."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8: A-Z lower-cased, runs of digits, a-z and non-ASCII characters."""
    return [] if text is None else text.encode().translate(WORD_BYTES).split()


def on_files(df: DataFrame) -> DataFrame:
    """``df`` itself if its rows come straight from files, else a copy written once."""
    try:
        df.select(df.metadataColumn("_metadata").getField("row_index")).schema
        return df
    except PySparkException:
        return durable(df)


def row_key(df: DataFrame, name: str, *columns: Column) -> DataFrame:
    """Columns of a frame of files with a unique struct column ``name``: file and position in it.

    Every scan reads the same keys, whatever its partitions. Frames that are no scans go through
    ``on_files`` first.
    """
    place = df.metadataColumn("_metadata")
    key = F.struct(F.xxhash64(place.getField("file_path")).alias("part"), place.getField("row_index").alias("at"))
    return df.select(key.alias(name), *columns)


def whole_rows(df: DataFrame) -> tuple[Column, list[Column]]:
    """All columns as one struct ``_doc``, and the columns that unpack it: no name can clash meanwhile."""
    names = df.columns
    packed = F.struct(*[df[f"`{c}`"] for c in names]).alias("_doc")
    return packed, [F.col("_doc").getField(c).alias(c) for c in names]


def without_rows(df: DataFrame, gone: DataFrame) -> DataFrame:
    """``df`` (a frame of files) without the rows whose keys ``gone`` lists in ``_row``; all columns unchanged."""
    packed, unpacked = whole_rows(df)
    gone = gone.select(F.col("_row").alias("_gone"))
    return row_key(df, "_row", packed).join(gone, F.col("_row") == F.col("_gone"), "left_anti").select(*unpacked)


def crc_mod(key: Column, n: int) -> Column:
    """crc32 of a key as text, modulo ``n``; NULL for a NULL key."""
    return F.crc32(key.cast("string").cast("binary")) % n


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches into runs of rows whose texts hold about ``max_bytes``; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        total, first = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > max_bytes:
                yield batch.slice(first, i - first)
                total, first = 0, i
            total += int(n)
        yield batch.slice(first)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit finaliser over unsigned integers."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x += np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


_RNG = np.random.default_rng(20240229)
BYTE_CODES = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _INVERSE = 0x9E3779B97F4A7C15 | 1, pow(0x9E3779B97F4A7C15 | 1, -1, 2**64)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)[:n]


def token_hashes(data: np.ndarray, is_sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each run of bytes that are no separators.

    ``data`` are UTF-8 bytes; ``is_sep`` marks, per byte value, the separators. The hash is a
    polynomial over random byte codes, taken from prefix sums, then mixed with the length.
    """
    inside = np.concatenate(([False], ~is_sep[data], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return start, end, np.zeros(0, np.uint64)
    block = 1 << 20
    out = np.empty(len(start), np.uint64)
    up, down = _powers(_BASE, block), _powers(_INVERSE, block)
    first = 0
    with np.errstate(over="ignore"):
        while first < len(start):  # tokens of one block of bytes; a longer token stands alone
            origin = start[first]
            last = max(first + 1, int(np.searchsorted(end, origin + block, side="right")))
            size = int(end[last - 1] - origin)
            if size > len(up):
                size_up = 1 << size.bit_length()
                up, down = _powers(_BASE, size_up), _powers(_INVERSE, size_up)
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(BYTE_CODES[data[origin:origin + size]] * up[:size], out=sums[1:])
            a, b = start[first:last] - origin, end[first:last] - origin
            out[first:last] = (sums[b] - sums[a]) * down[a]
            first = last
        return start, end, mix(out ^ (end - start).astype(np.uint64))


def joined(values: list[str | None], sep: bytes = b"\n") -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one separator after each, and the start of each text (one more at the end)."""
    parts = [(v or "").encode() for v in values]
    ends = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)
    data = np.frombuffer(sep.join(parts) + sep if parts else b"", np.uint8)
    return data, np.concatenate(([0], ends)).astype(np.int64)


HOT_SHARE = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Join rows with one row per group, without bringing a hot group into one task.

    Groups above ``total / HOT_SHARE`` rows are fewer than HOT_SHARE, so these few are broadcast; all
    others are joined by a shuffle. ``size`` is the column of ``groups`` with the rows of each group.
    """
    hot = F.col(size) > F.lit(total // HOT_SHARE)
    few = F.broadcast(groups.filter(hot))
    rare = rows.join(few.select(key), key, "left_anti").join(groups.filter(~hot), key)
    return rows.join(few, key).unionByName(rare)


RANK_SALTS = 64


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str) -> DataFrame:
    """The first ``k`` rows of each key in ``order``, numbered from 1 in an INT column ``name``.

    A first cut per key and slice of the partitions keeps ``k`` rows each, so the task that ranks a hot
    key reads at most ``k * RANK_SALTS`` rows of it.
    """
    cut = Window.partitionBy(*keys, "_salt").orderBy(*order)
    rows = df.withColumn("_salt", F.spark_partition_id() % RANK_SALTS).withColumn("_cut", F.row_number().over(cut)).filter(F.col("_cut") <= k)
    rows = rows.drop("_salt", "_cut").withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return rows.filter(F.col(name) <= k)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (u, v of BIGINT): one row (node, root) per node, root the smallest.

    Rounds of large and small stars; each round is written once, so lineage stays short and lost
    executors only repeat one round.
    """
    edges = durable(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")))
        large = durable(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        near = durable(large.groupBy("u").agg(F.min("v").alias("m")))
        linked = large.join(near, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            linked.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        small = durable(small)
        drop(edges, least, large, near)
        # done when every node has one smaller neighbour, and that one is a root
        open_ = small.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
        inner = small.join(small.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        if not open_ and not inner:
            roots = small.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return small.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        edges = small
