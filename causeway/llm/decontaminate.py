"""Benchmark decontamination by one FM-index per training shard.

A shard is a run of documents of about ``shard_bytes``. Words that no benchmark item has cannot lie
in an occurrence, so they become breaks; runs shorter than the shortest window are breaks as well.
The rest is indexed, all windows are searched backwards, their occurrences located, and the spans
merged per document. Nothing is shuffled. Items come in blocks of bounded size: each block is one
broadcast and one pass over the documents, which adds to the spans found before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import query, read, slices, whole_rows, words_of
from causeway.llm.fm_index import FMIndex
from causeway.session import durable

LOCATE_AT_ONCE = 1 << 20
FOUND = "_words long, _starts array<int>, _ends array<int>, _items array<string>"


class Phrases:
    """Windows of ``width`` consecutive words of some items, and the items that have them."""

    def __init__(self, items: list[tuple[str, list[bytes]]], width: int):
        self.word_ids: dict[bytes, int] = {}  # from 2; 1 is a break
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, words in items:
            ids = [self.word_ids.setdefault(w, len(self.word_ids) + 2) for w in words]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                owners.setdefault(tuple(ids[i:i + width]), set()).add(item)
        by_length: dict[int, list] = {}
        for window, names in owners.items():
            by_length.setdefault(len(window), []).append((window, sorted(names)))
        # windows of one length form one matrix
        self.groups = [(np.array([w for w, _ in some], np.int64), [n for _, n in some])
                       for _, some in sorted(by_length.items())]
        self.shortest = min(by_length, default=0)


def _blocks(items: DataFrame, item_id: str, text: str, width: int, block_bytes: int) -> Iterator[Phrases]:
    """Item blocks of bounded size, read one row at a time."""
    rows = items.select(F.col(item_id).cast("string").alias("i"), F.col(text).cast("string").alias("t"))
    block, held = [], 0
    for row in rows.toLocalIterator():
        words = words_of(row.t)
        if row.i is None or not words:
            continue
        block.append((row.i, words))
        held += len(row.t)
        if held >= block_bytes:
            yield Phrases(block, width)
            block, held = [], 0
    if block:
        yield Phrases(block, width)


def search_shard(texts: list[str | None], phrases: Phrases) -> list[tuple[int, np.ndarray, np.ndarray, list[str]]]:
    """Per document: number of words, merged hit spans (starts, ends) and the items that occur."""
    get = phrases.word_ids.get
    ids, counts = [], []
    for t in texts:
        found = [get(w, 1) for w in words_of(t)]
        counts.append(len(found))
        ids.extend(found)
        ids.append(1)  # no occurrence crosses documents
    ids = np.array(ids, np.int64)
    firsts = np.concatenate(([0], np.cumsum(np.array(counts, np.int64) + 1)))
    result = [(n, np.zeros(0, np.int64), np.zeros(0, np.int64), []) for n in counts]
    if not len(ids) or not phrases.shortest:
        return result
    inside = np.concatenate(([False], ids > 1, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    a, b = edges[::2], edges[1::2]
    long_enough = b - a >= phrases.shortest
    a, b = a[long_enough], b[long_enough]
    if not len(a):
        return result
    keep = np.zeros(len(ids) + 1, np.int64)
    np.add.at(keep, a, 1)
    np.add.at(keep, b + 1, -1)  # the break after a run stays
    places = np.flatnonzero(np.cumsum(keep)[:-1])
    index = FMIndex(ids[places], len(phrases.word_ids) + 1)

    cover = np.zeros(len(ids) + 1, np.int64)
    pairs: set[tuple[int, str]] = set()
    for windows, owners in phrases.groups:
        low, high = index.search(windows)
        hit = np.flatnonzero(high > low)
        sizes = (high - low)[hit]
        for first in _portions(sizes):
            some, n = hit[first], sizes[first]
            rows = np.repeat(low[some] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            at = places[index.locate(rows)]
            np.add.at(cover, at, 1)
            np.add.at(cover, at + windows.shape[1], -1)
            docs = np.searchsorted(firsts, at, side="right") - 1
            which = np.repeat(some, n)
            for d, w in np.unique(np.stack((docs, which)), axis=1).T.tolist():
                pairs.update((d, name) for name in owners[w])
    covered = np.concatenate(([False], np.cumsum(cover)[:-1] > 0, [False]))
    edges = np.flatnonzero(covered[1:] != covered[:-1])
    a, b = edges[::2], edges[1::2]
    docs = np.searchsorted(firsts, a, side="right") - 1
    items: dict[int, list[str]] = {}
    for d, name in pairs:
        items.setdefault(d, []).append(name)
    for d in np.unique(docs).tolist():
        own = docs == d
        result[d] = (counts[d], a[own] - firsts[d], b[own] - firsts[d], sorted(items[d]))
    return result


def _portions(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Index runs whose sizes sum to about LOCATE_AT_ONCE."""
    if len(sizes):
        part = np.cumsum(sizes) // LOCATE_AT_ONCE
        for k in np.unique(part):
            yield np.flatnonzero(part == k)


def _merge(starts: list, ends: list, more_starts: np.ndarray, more_ends: np.ndarray) -> tuple[list, list]:
    out: list[list[int]] = []
    for a, b in sorted([*zip(starts, ends), *zip(more_starts.tolist(), more_ends.tolist())]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [a for a, _ in out], [b for _, b in out]


def _search(shared, text: str, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for shard in slices(batches, text, shard_bytes):
            found = search_shard(shard.column(text).to_pylist(), phrases)
            before = [shard.column(c).to_pylist() for c in ("_starts", "_ends", "_items")]
            starts, ends, items = [], [], []
            for (_, a, b, names), s, e, i in zip(found, *before):
                s, e = _merge(s, e, a, b)
                starts.append(s)
                ends.append(e)
                items.append(sorted({*i, *names}))
            fresh = {
                "_words": pa.array([f[0] for f in found], pa.int64()), "_starts": pa.array(starts, pa.list_(pa.int32())),
                "_ends": pa.array(ends, pa.list_(pa.int32())), "_items": pa.array(items, pa.list_(pa.string())),
            }
            columns = [fresh.get(name, shard.column(k)) for k, name in enumerate(shard.schema.names)]
            yield pa.RecordBatch.from_arrays(columns, shard.schema.names)

    return run


def contamination_spans(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id",
                        item_text: str = "text", width: int = 10, shard_bytes: int = 4_000_000,
                        block_bytes: int = 16_000_000) -> DataFrame:
    """``docs`` with ``_words``, ``_starts``, ``_ends`` (word positions, merged) and ``_items``.

    NULL and empty texts have no words. Items without words or without an id are skipped; repeated
    items count once per id. ``docs`` must not have columns of these four names.
    """
    none = "cast(array() as array<int>)"
    found = docs.select(
        *docs.columns, F.lit(0).cast("long").alias("_words"), F.expr(none).alias("_starts"),
        F.expr(none).alias("_ends"), F.expr("cast(array() as array<string>)").alias("_items"),
    )
    spark, passes = docs.sparkSession, 0
    for phrases in _blocks(items, item_id, item_text, width, block_bytes):
        if passes:
            found = durable(found)
        shared = spark.sparkContext.broadcast(phrases)
        found = found.mapInArrow(_search(shared, text, shard_bytes), found.schema)
        passes += 1
    if not passes:  # no item: words are counted all the same
        shared = spark.sparkContext.broadcast(Phrases([], width))
        found = found.mapInArrow(_search(shared, text, shard_bytes), found.schema)
    return found


def contamination(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, starts, ends."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_text"))
    found = contamination_spans(slim, items, "_text", **options)
    hit = F.aggregate(F.zip_with("_ends", "_starts", lambda b, a: b - a), F.lit(0), lambda s, x: s + x).cast("long")
    return found.select(
        "doc_id", F.col("_words").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("_items")), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
        F.col("_starts").alias("starts"), F.col("_ends").alias("ends"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; all columns unchanged."""
    packed, unpacked = whole_rows(docs)
    slim = docs.select(F.col(text).cast("string").alias("_text"), packed)
    return contamination_spans(slim, items, "_text", **options).filter(F.size("_starts") == 0).select(*unpacked)


SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS key, least(len(w), 10) AS n
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0 AND item_id IS NOT NULL),
lens AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS key
  FROM t, unnest(range(1, len(w) + 1)) AS r(i), lens WHERE i + n - 1 <= len(w)),
occ AS (SELECT pos.doc_id, pos.i, pos.n, win.item_id FROM pos JOIN win ON pos.key = win.key AND pos.n = win.n),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS s FROM occ GROUP BY doc_id)
SELECT t.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM t LEFT JOIN cov ON t.doc_id = cov.doc_id LEFT JOIN its ON t.doc_id = its.doc_id
"""


@query("op1_decontamination", SQL)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark windows against all documents."""
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("starts", "ends")
