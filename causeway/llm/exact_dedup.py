"""Exact deduplication with two Bloom passes.

The first pass counts, per bit, whether it was hit once or more often. Bits hit more than once form
the second filter: a hash with all its bits there may be repeated, any other hash is certainly
unique. Only rows that may be repeated are shuffled; the rest pass straight through.

The filter has about 16 bits a row up to ``max_filter_bits`` (8 MB), which bounds the broadcast. A
fuller filter only sends more rows through the shuffle; results are exact at any fill.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import join_groups, mix, on_files, query, read, row_key, without_rows
from causeway.session import durable

PROBES = 4
BLOCK_BITS = 1 << 19
MERGE_SALTS = 64


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Row key, id, code points and SHA-256 of each text without ASCII white space; NULL counts as empty."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    bare = F.regexp_replace(whole, r"[\x20\x09-\x0D]+", "")
    return row_key(
        on_files(docs), "_row", F.col(doc_id).alias("doc_id"), F.char_length(whole).cast("long").alias("chars"),
        F.sha2(bare.cast("binary"), 256).alias("text_sha256"),
    )


def _bits(hashes: np.ndarray, n_bits: int) -> np.ndarray:
    return np.stack([mix(hashes, k + 1) & np.uint64(n_bits - 1) for k in range(PROBES)]).astype(np.int64)


def _count_bits(n_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = np.zeros(n_bits, np.uint8)
        for batch in batches:
            hashes = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for chunk in np.array_split(hashes, max(1, len(hashes) // 50_000)):
                for row in _bits(chunk, n_bits):
                    at, n = np.unique(row, return_counts=True)
                    hits[at] = np.minimum(2, hits[at] + n)
        salt = TaskContext.get().partitionId() % MERGE_SALTS
        for block in range(0, n_bits, BLOCK_BITS):
            part = hits[block:block + BLOCK_BITS]
            if part.any():
                yield pa.RecordBatch.from_pydict({
                    "salt": pa.array([salt], pa.int32()), "block": pa.array([block // BLOCK_BITS], pa.int32()),
                    "once": [zlib.compress(np.packbits(part >= 1).tobytes(), 1)],
                    "twice": [zlib.compress(np.packbits(part >= 2).tobytes(), 1)],
                })

    return run


def _merge(table: pa.Table) -> pa.Table:
    once = twice = None
    for a, b in zip(table["once"].to_pylist(), table["twice"].to_pylist()):
        a, b = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
        once, twice = (a, b) if once is None else (once | a, twice | b | (once & a))
    return pa.table({
        "salt": table["salt"][:1].cast(pa.int32()), "block": table["block"][:1],
        "once": [zlib.compress(once.tobytes(), 1)], "twice": [zlib.compress(twice.tobytes(), 1)],
    })


FILTER = "salt int, block int, once binary, twice binary"


def repeat_filter(hashes: DataFrame, n_bits: int) -> np.ndarray:
    """Bits that were hit more than once; ``hashes`` has one BIGINT column."""
    parts = hashes.mapInArrow(_count_bits(n_bits), FILTER)
    merged = parts.groupBy("block", "salt").applyInArrow(_merge, FILTER)
    merged = merged.withColumn("salt", F.lit(0)).groupBy("block").applyInArrow(_merge, FILTER)
    bits = np.zeros(n_bits // 8, np.uint8)
    width = min(n_bits, BLOCK_BITS) // 8
    for row in merged.select("block", "twice").collect():  # at most n_bits / 8 bytes
        bits[row.block * width:(row.block + 1) * width] = np.frombuffer(zlib.decompress(row.twice), np.uint8)
    return bits


def mark_possible(rows: DataFrame, hash_column: str, bits: np.ndarray, flag: str) -> DataFrame:
    """Add ``flag``: false where the hash is certainly unique."""
    shared = rows.sparkSession.sparkContext.broadcast(bits)
    n_bits = len(bits) * 8

    @F.pandas_udf("boolean")
    def possible(col):
        import pandas as pd

        at = _bits(col.to_numpy().view(np.uint64), n_bits)
        return pd.Series(((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0))

    return rows.withColumn(flag, possible(F.col(hash_column)))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 max_filter_bits: int = 1 << 26) -> DataFrame:
    """One row per document: ``_row``, doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the longest original stays, then the smallest doc_id (NULL last), then the first
    row. Repeated rows with one doc_id are told apart by their row key, so exactly one is kept.
    """
    slim = durable(fingerprints(docs, doc_id, text).withColumn("_hash", F.xxhash64("text_sha256")))
    total = slim.count()
    n_bits = 1 << 16
    while n_bits < min(16 * total, max_filter_bits):
        n_bits *= 2
    marked = mark_possible(slim, "_hash", repeat_filter(slim.select("_hash"), n_bits), "_maybe")
    alone = marked.filter("not _maybe").select(
        "_row", "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256",
    )
    maybe = durable(marked.filter("_maybe").select("_row", "doc_id", "chars", "text_sha256"))
    best = F.min(F.struct((-F.col("chars")).alias("c"), F.col("doc_id").isNull().alias("n"), "doc_id", "_row"))
    groups = durable(maybe.groupBy("text_sha256").agg(F.count("*").alias("group_size"), best.alias("_best")))
    found = join_groups(maybe, groups, "text_sha256", "group_size", total).select(
        "_row", "doc_id", F.col("_best.doc_id").alias("keep_id"), F.col("group_size").cast("long").alias("group_size"),
        (F.col("_row") == F.col("_best._row")).alias("kept"), "text_sha256",
    )
    return alone.unionByName(found)


def drop_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns unchanged."""
    docs = on_files(docs)
    return without_rows(docs, exact_groups(docs, doc_id, text).filter("not kept"))


SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents),
g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


@query("op5_exact_dedup", SQL)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all documents."""
    return exact_groups(read(spark, sf_dir, "documents")).drop("_row")
