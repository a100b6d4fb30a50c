"""Jaccard join of documents on word n-grams by MinHash banding.

1. Each text becomes its set of hashed n-grams. Texts with one set form a class; one member stands
   for it from here on.
2. Band and row counts are chosen for a target recall at the threshold. Bands are shuffled by their
   hash; texts that share a band hang together in candidate components.
3. The n-grams of the candidates are read again and every pair inside a component is verified on the
   full sets. A component above ``block_bytes`` is dealt into blocks, and each pair of blocks is one
   task. A task gives per text its number of links and one link to the smallest text it is tied to,
   never the pairs.
4. These links are joined to classes of similar texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import (
    UPPER, WORD_BYTES, components, join_groups, joined, mix, on_files, query, read, row_key, slices, token_hashes, without_rows,
)
from causeway.session import durable

SEPARATORS = np.frombuffer(WORD_BYTES, np.uint8) == 32
LOWERED = np.array([b + 32 if chr(b) in UPPER else b for b in range(256)], np.uint8)
ODD = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float, recall: float, max_hashes: int = 512) -> tuple[int, int]:
    """Bands and rows: the most rows (fewest false candidates) with which ``recall`` is met at the threshold."""
    best = (max_hashes, 1)
    for rows in range(1, 33):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold ** rows)))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


def ngram_sets(texts: list[str | None], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all texts, and each text's first place (one more at the end).

    A text of fewer than n words, but not none, is one n-gram.
    """
    data, bounds = joined(texts)
    start, _, words = token_hashes(LOWERED[data] if len(data) else data, SEPARATORS)
    first = np.searchsorted(start, bounds)
    counts = np.diff(first)
    grams = np.where(counts > 0, np.maximum(1, counts - n + 1), 0)
    bound = np.concatenate(([0], np.cumsum(grams)))
    owner = np.repeat(np.arange(len(counts)), grams)
    at = first[:-1][owner] + np.arange(len(owner)) - bound[:-1][owner]
    length = np.minimum(n, counts)[owner]
    value = np.zeros(len(owner), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            value = np.where(k < length, (value + words[np.minimum(at + k, max(0, len(words) - 1))]) * ODD, value) if len(words) else value
    value = mix(value)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.concatenate(([True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1]))) if len(value) else np.zeros(0, bool)
    value, owner = value[new], owner[new]
    return value, np.searchsorted(owner, np.arange(len(counts) + 1))


def band_hashes(value: np.ndarray, bound: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per text and band; texts without n-grams have zeros."""
    full = np.flatnonzero(np.diff(bound))
    out = np.zeros((len(bound) - 1, bands), np.uint64)
    if not len(full):
        return out
    rng = np.random.default_rng(20011)
    factors = rng.integers(0, 2**31, (bands, rows), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    shifts = rng.integers(0, 2**32, (bands, rows), dtype=np.uint32)
    short = (value >> np.uint64(32)).astype(np.uint32)
    at = bound[:-1][full]
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(full), b + 1, np.uint64)
            for r in range(rows):
                low = np.minimum.reduceat(short * factors[b, r] + shifts[b, r], at)
                key = (key + low) * ODD
                key ^= key >> np.uint64(29)
            out[full, b] = mix(key)
    return out


SKETCH = "_row struct<part: long, at: long>, doc_id bigint, set_hash binary, n_grams int, n_bytes int, bands array<bigint>"


def _sketch(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1_000_000):
            texts = part.column("text").to_pylist()
            value, bound = ngram_sets(texts, n)
            keys = band_hashes(value, bound, bands, rows).view(np.int64)
            sizes = np.diff(bound)
            sets = [hashlib.blake2b(value[a:b].tobytes(), digest_size=16).digest() if b > a else None
                    for a, b in zip(bound[:-1], bound[1:])]
            offsets = np.concatenate(([0], np.cumsum(np.where(sizes > 0, bands, 0)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                part.column("_row"), part.column("doc_id"), pa.array(sets, pa.binary()), pa.array(sizes, pa.int32()),
                pa.array(sizes * 8, pa.int32()),
                pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[sizes > 0].ravel())),
            ], ["_row", "doc_id", "set_hash", "n_grams", "n_bytes", "bands"])

    return run


CELL = "comp bigint, i int, j int, node bigint, block int, weight bigint, grams binary"


def _deal(n: int):
    """The n-grams of each candidate, once for each pair of blocks its block takes part in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 1_000_000):
            value, bound = ngram_sets(part.column("text").to_pylist(), n)
            rows = part.select(["comp", "node", "block", "blocks", "weight"]).to_pylist()
            for d, r in enumerate(rows):
                grams, own = value[bound[d]:bound[d + 1]].tobytes(), r["block"]
                step = max(1, 8_000_000 // (len(grams) + 1))
                for first in range(0, r["blocks"], step):
                    others = range(first, min(r["blocks"], first + step))
                    k = len(others)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([r["comp"]] * k, pa.int64()), pa.array([min(own, o) for o in others], pa.int32()),
                        pa.array([max(own, o) for o in others], pa.int32()), pa.array([r["node"]] * k, pa.int64()),
                        pa.array([own] * k, pa.int32()), pa.array([r["weight"]] * k, pa.int64()),
                        pa.array([grams] * k, pa.binary()),
                    ], ["comp", "i", "j", "node", "block", "weight", "grams"])

    return run


def overlaps(sets: list[np.ndarray], cells: int = 10_000_000) -> np.ndarray:
    """Sizes of all pairwise intersections, by products of slices of the incidence matrix."""
    n = len(sets)
    out = np.zeros((n, n), np.float32)
    values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    shared = counts > 1  # values of one set only give nothing
    place = np.cumsum(shared) - 1
    keep = shared[column]
    column, owner = place[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = max(1, cells // n)
    for first in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, (first, first + width))
        matrix = np.zeros((n, width), np.float32)
        matrix[owner[a:b], column[a:b] - first] = 1
        out += matrix @ matrix.T
    return out


def _verify(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        nodes = table["node"].to_numpy()
        order = np.argsort(nodes, kind="stable")
        nodes, block = nodes[order], table["block"].to_numpy()[order]
        weight = table["weight"].to_numpy()[order]
        grams = table["grams"]
        sets = [np.frombuffer(grams[int(k)].as_buffer(), np.uint64) for k in order]
        inner = overlaps(sets)
        size = np.array([len(s) for s in sets], np.float64)
        union = size[:, None] + size[None, :] - inner
        linked = inner >= threshold * union - 1e-9
        np.fill_diagonal(linked, False)
        if table["i"][0].as_py() != table["j"][0].as_py():
            linked &= block[:, None] != block[None, :]
        links = linked.astype(np.float64) @ weight
        root = np.arange(len(nodes))
        while True:  # smallest node each one is tied to
            low = np.where(linked, root[None, :], len(nodes)).min(axis=1, initial=len(nodes))
            new = np.minimum(root, low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        has = links > 0
        return pa.table({"node": nodes[has], "links": links[has].astype(np.int64), "root": nodes[root[has]]})

    return run


def similar_groups(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.999, doc_id: str = "doc_id",
                   text: str = "text", block_bytes: int = 1_500_000) -> DataFrame:
    """One row per document: ``_row``, doc_id, class_id, n_links, kept.

    ``class_id`` is the smallest doc_id of the documents tied together by links of at least
    ``threshold``, ``n_links`` the number of other documents linked to this one, and ``kept`` marks one
    document per class: the one with the most distinct n-grams, then the smallest doc_id, then the first
    row. Texts without words have no n-grams and stand alone; NULL ids sort last. Repeated rows are
    documents of their own.
    """
    bands, rows = bands_for(threshold, recall)
    keyed = row_key(on_files(docs), "_row", F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    sketches = durable(keyed.mapInArrow(_sketch(n, bands, rows), SKETCH))
    total = sketches.count()
    alone = sketches.filter("set_hash is null").select(
        "_row", "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept"))

    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_row")).alias("first")
    classes = sketches.filter("set_hash is not null").groupBy("set_hash").agg(
        first, F.count("*").alias("weight"), F.first("n_bytes").alias("n_bytes"), F.first("n_grams").alias("n_grams"))
    classes = durable(classes.withColumn("node", F.monotonically_increasing_id()))

    stands = sketches.select(F.col("_row").alias("_first"), "bands").join(
        classes.select(F.col("first._row").alias("_first"), "node"), "_first")
    keys = stands.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = durable(keys.groupBy("band", "key").agg(F.min("node").alias("low"), F.count("*").alias("n")).filter("n > 1"))
    edges = keys.join(buckets, ["band", "key"]).select(F.col("node").alias("u"), F.col("low").alias("v"))
    candidates = durable(components(edges))

    parts = candidates.join(classes, "node")
    sizes = durable(parts.groupBy("root").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("members")))
    blocks = F.ceil(F.col("bytes") / block_bytes).cast("int")
    parts = join_groups(parts, sizes, "root", "members", total).withColumn("blocks", F.greatest(blocks, F.lit(1)))
    parts = parts.select(F.col("first._row").alias("_first"), F.col("root").alias("comp"), "node", "weight", "blocks",
                         F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"))
    texts = keyed.join(parts, F.col("_row") == F.col("_first")).select("text", "comp", "node", "block", "blocks", "weight")
    cells = texts.mapInArrow(_deal(n), CELL)
    links = durable(cells.groupBy("comp", "i", "j").applyInArrow(_verify(threshold), "node bigint, links bigint, root bigint"))

    tied = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    best = F.min(F.struct((-F.col("n_grams")).alias("g"), F.col("first").alias("f"))).alias("best")
    roots = classes.join(tied, "node", "left").withColumn("root", F.coalesce("root", "node")).join(counts, "node", "left")
    roots = durable(roots.select("set_hash", "root", "weight", "first", "n_grams", F.coalesce("links", F.lit(0)).alias("links")))
    groups = durable(roots.groupBy("root").agg(F.min("first").alias("low"), best, F.count("*").alias("members")))
    sets = join_groups(roots, groups, "root", "members", total).select(
        "set_hash", "weight", F.col("low.doc_id").alias("class_id"), (F.col("weight") - 1 + F.col("links")).alias("n_links"),
        F.col("best.f._row").alias("_best"))
    found = join_groups(sketches.select("_row", "doc_id", "set_hash"), durable(sets), "set_hash", "weight", total)
    return alone.unionByName(found.select(
        "_row", "doc_id", "class_id", F.col("n_links").cast("long").alias("n_links"), (F.col("_row") == F.col("_best")).alias("kept")))


def drop_similar(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class of similar texts, all columns unchanged."""
    docs = on_files(docs)
    return without_rows(docs, similar_groups(docs, doc_id=doc_id, text=text, **options).filter("not kept"))


@query("op8_ngram_join")
def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and links of all documents at a Jaccard similarity of 0.8 on five-word n-grams."""
    return similar_groups(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
