"""Language-model scores: an interpolated modified Kneser-Ney bigram model.

Words and word pairs are counted in Spark: tasks count their own texts, send sorted keys and counts to
shards by hash, and each shard is merged by one task. The model is a set of sorted arrays in the shared
folder, one file per shard, which scoring workers map into memory. Its size follows the corpus; no
worker loads it whole, and a shard's size is bounded by the number of shards.

Three passes over the texts: words, pairs of word numbers, scores. The end token of a text is also the
context of its first word. Unknown words share the mass of one more word.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import UPPER, crc_mod, joined, mix, query, read, slices, token_hashes
from causeway.session import shared_dir

BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
LOWERED = np.array([b + 32 if chr(b) in UPPER else b for b in range(256)], np.uint8)
END = np.uint64(0x5BD1E9955BD1E995)  # key of the end token
UNKNOWN = np.int64(-1)


def token_keys(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all tokens, an end token after each text, and each text's first place (one more at the end)."""
    data, bounds = joined([t for t in texts])
    start, _, keys = token_hashes(LOWERED[data] if len(data) else data, BLANK)
    counts = np.diff(np.searchsorted(start, bounds))
    ends = np.cumsum(counts + 1) - 1
    out = np.empty(len(keys) + len(counts), np.uint64)
    is_end = np.zeros(len(out), bool)
    is_end[ends] = True
    out[is_end], out[~is_end] = END, keys
    return out, np.concatenate(([0], ends + 1)).astype(np.int64)


def _pack(keys: np.ndarray) -> bytes:
    """Sorted keys as differences of as few bytes as they need."""
    steps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    width = blob[0]
    raw = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, width)
    steps = np.zeros((len(raw), 8), np.uint8)
    steps[:, :width] = raw
    return np.cumsum(steps.reshape(-1).view(np.uint64), dtype=np.uint64)


def _save(folder: str, name: str, array: np.ndarray) -> None:
    """Write under another name, then rename: a repeated task leaves the same file."""
    part = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        np.save(out, array)
    os.replace(part, f"{folder}/{name}.npy")


@dataclass
class Model:
    """Where the arrays are, and what fits every worker's memory: totals, discounts, sizes per shard."""

    folder: str
    tokens: int = 0
    words: int = 0
    pairs: int = 0
    word_shards: int = 1
    pair_shards: int = 1
    word_start: list[int] = field(default_factory=list)  # number of the first word of each shard
    block: int = 1 << 12  # word numbers per file of word statistics
    discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    word_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    word_types: tuple[int, int, int] = (0, 0, 0)  # words seen after one, two, more others

    def array(self, name: str) -> np.ndarray:
        opened = self.__dict__.setdefault("_open", {})
        if name not in opened:
            opened[name] = np.load(f"{self.folder}/{name}.npy", mmap_mode="r")
        return opened[name]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_open"}

    def _find(self, keys: np.ndarray, shard: np.ndarray, name: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per shard: which of the sorted ``keys`` it has, and where."""
        order = np.argsort(shard, kind="stable")
        edges = np.flatnonzero(np.concatenate(([True], np.diff(shard[order]) != 0))) if len(order) else order
        for a, b in zip(edges, np.append(edges[1:], len(order))):
            own = order[a:b]
            k = int(shard[own[0]])
            stored = self.array(f"{name}-{k}")
            if len(stored):
                at = np.minimum(np.searchsorted(stored, keys[own]), len(stored) - 1)
                hit = stored[at] == keys[own]
                yield k, own[hit], at[hit]

    def number(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and training count of each distinct word key; UNKNOWN and 0 for others."""
        number, count = np.full(len(keys), UNKNOWN), np.zeros(len(keys), np.int64)
        if self.words:
            for k, own, at in self._find(keys, shard_of(keys, self.word_shards), "word"):
                number[own], count[own] = at + self.word_start[k], self.array(f"wordcount-{k}")[at]
        return number, count

    def pair_count(self, keys: np.ndarray) -> np.ndarray:
        count = np.zeros(len(keys), np.int64)
        if self.pairs:
            for k, own, at in self._find(keys, shard_of(mix(keys), self.pair_shards), "pair"):
                count[own] = self.array(f"paircount-{k}")[at]
        return count

    def word_statistics(self, number: np.ndarray) -> np.ndarray:
        """Rows of word statistics: pair total, followers by count 1, 2, 3+, and number of predecessors."""
        out = np.zeros((len(number), 5), np.int64)
        known = np.flatnonzero(number >= 0)
        block = number[known] // self.block
        for k in np.unique(block):
            own = known[block == k]
            out[own] = self.array(f"stats-{k}")[number[own] % self.block]
        return out


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard by the highest bits, so that the keys of one shard are a range; ``shards`` is a power of two."""
    bits = shards.bit_length() - 1
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def _sent(keys: np.ndarray, counts: np.ndarray, shard: np.ndarray, shards: int) -> pa.RecordBatch:
    """Sorted keys and counts, one row per shard that has any."""
    edges = np.searchsorted(shard, np.arange(shards + 1))
    full = np.flatnonzero(np.diff(edges))
    return pa.RecordBatch.from_pydict({
        "shard": pa.array(full, pa.int64()),
        "keys": pa.array([_pack(keys[edges[k]:edges[k + 1]]) for k in full], pa.binary()),
        "counts": pa.array([counts[edges[k]:edges[k + 1]].astype("<u4").tobytes() for k in full], pa.binary()),
    })


SENT = "shard bigint, keys binary, counts binary"


def _count_words(shards: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", chunk):
            keys, counts = np.unique(token_keys(part.column("text").to_pylist())[0], return_counts=True)
            yield _sent(keys, counts, shard_of(keys, shards), shards)

    return run


def _count_pairs(model: Model, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", chunk):
            keys, first = token_keys(part.column("text").to_pylist())
            values, place = np.unique(keys, return_inverse=True)
            number = model.number(values)[0][place]
            pairs = _pair_keys(number, first, model.number(np.array([END]))[0][0])
            pairs, counts = np.unique(pairs, return_counts=True)
            shard = shard_of(mix(pairs), model.pair_shards)
            order = np.argsort(shard, kind="stable")
            yield _sent(pairs[order], counts[order], shard[order], model.pair_shards)

    return run


def _pair_keys(number: np.ndarray, first: np.ndarray, end: np.int64) -> np.ndarray:
    """Context and word of each token as one key; the key of an unknown word or context is never stored."""
    context = np.concatenate(([end], number[:-1])) if len(number) else number
    context[first[:-1]] = end
    pairs = (context.astype(np.uint64) << np.uint64(32)) | (number.astype(np.uint64) & np.uint64(0xFFFFFFFF))
    pairs[(context < 0) | (number < 0)] = np.uint64(0xFFFFFFFFFFFFFFFF)
    return pairs


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([_unpack(b) for b in table["keys"].to_pylist()])
    counts = np.concatenate([np.frombuffer(b, "<u4") for b in table["counts"].to_pylist()])
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    total = np.add.reduceat(counts.astype(np.int64), first)
    return keys[first], total.astype(np.uint32) if total.max() < 2**32 else total


WORDS = "shard bigint, n bigint, total bigint"


def _merge_words(folder: str):
    def run(table: pa.Table) -> pa.Table:
        keys, counts = _merged(table)
        k = table["shard"][0].as_py()
        _save(folder, f"word-{k}", keys)
        _save(folder, f"wordcount-{k}", counts)
        return pa.table({"shard": [k], "n": [len(keys)], "total": [int(counts.sum(dtype=np.int64))]})

    return run


STATS = "block bigint, ids binary, rows binary, n1 bigint, n2 bigint, n3 bigint, n4 bigint, pairs bigint"


def _merge_pairs(folder: str, block: int):
    """Store a shard of pairs; send on what it adds to the statistics of its contexts and words."""
    def run(table: pa.Table) -> pa.Table:
        keys, counts = _merged(table)
        k = table["shard"][0].as_py()
        _save(folder, f"pair-{k}", keys)
        _save(folder, f"paircount-{k}", counts)
        context, word = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        ids = np.unique(np.concatenate((context, word)))
        at = np.searchsorted(ids, context)
        rows = np.stack([
            np.bincount(at, counts, len(ids)), *(np.bincount(at, counts == c, len(ids)) for c in (1, 2)),
            np.bincount(at, counts >= 3, len(ids)), np.bincount(np.searchsorted(ids, word), minlength=len(ids)),
        ], axis=1).astype("<u4" if counts.max() < 2**31 and counts.sum(dtype=np.int64) < 2**32 else "<u8")
        edges = np.flatnonzero(np.concatenate(([True], np.diff(ids // block) != 0)))
        spans = list(zip(edges, np.append(edges[1:], len(ids))))
        ones = [[int((counts == c).sum()) if i == 0 else 0 for i in range(len(spans))] for c in (1, 2, 3, 4)]
        return pa.table({
            "block": [int(ids[a] // block) for a, _ in spans], "ids": [(ids[a:b] % block).astype("<u4").tobytes() for a, b in spans],
            "rows": [bytes([rows.itemsize]) + rows[a:b].T.tobytes() for a, b in spans],
            "n1": ones[0], "n2": ones[1], "n3": ones[2], "n4": ones[3],
            "pairs": [len(keys) if i == 0 else 0 for i in range(len(spans))],
        })

    return run


TOTALS = "n1 bigint, n2 bigint, n3 bigint, n4 bigint, pairs bigint, m1 bigint, m2 bigint, m3 bigint, m4 bigint, more bigint"


def _merge_stats(folder: str, block: int):
    def run(table: pa.Table) -> pa.Table:
        stats = np.zeros((block, 5), np.int64)
        for ids, rows in zip(table["ids"].to_pylist(), table["rows"].to_pylist()):
            at = np.frombuffer(ids, "<u4")
            stats[at] += np.frombuffer(rows, f"<u{rows[0]}", offset=1).reshape(5, -1).T.astype(np.int64)
        _save(folder, f"stats-{table['block'][0].as_py()}", stats)
        sums = {c: [pa.compute.sum(table[c]).as_py()] for c in ("n1", "n2", "n3", "n4", "pairs")}
        return pa.table(sums | {f"m{c}": [int((stats[:, 4] == c).sum())] for c in (1, 2, 3, 4)} | {"more": [int((stats[:, 4] >= 3).sum())]})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of 1, 2 and more; fixed ones where a needed count is none."""
    if not min(n1, n2, n3, n4):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.0), float(k)) for k, d in enumerate(found, 1))


def _shards(total: int, each: int) -> int:
    n = 1
    while n * each < total:
        n *= 2
    return n


def _folder(spark: SparkSession) -> str:
    root = shared_dir(spark)
    if "://" in root and not root.startswith("file://"):
        raise RuntimeError("the model is mapped into memory: spark.checkpoint.dir must be a folder that workers can open")
    path = os.path.join(root.removeprefix("file://").removeprefix("file:"), f"language-model-{uuid.uuid4().hex}")
    os.makedirs(path)
    return path


def train(docs: DataFrame, text: str = "text", chunk: int = 8_000_000, shard_keys: int = 1_500_000) -> Model:
    """Count all of ``docs`` and store the model; ``shard_keys`` bounds the keys that one task merges, about."""
    spark = docs.sparkSession
    slim = docs.select(F.col(text).cast("string").alias("text"))
    size = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model = Model(_folder(spark))
    model.word_shards = _shards(size // 30, shard_keys)
    sent = slim.mapInArrow(_count_words(model.word_shards, chunk), SENT)
    merged = sent.groupBy("shard").applyInArrow(_merge_words(model.folder), WORDS)
    sizes = {r.shard: r for r in merged.collect()}  # one row per shard
    model.words, model.tokens = sum(r.n for r in sizes.values()), sum(r.total for r in sizes.values())
    if not model.words:
        return model
    model.word_start = np.cumsum([0] + [sizes[k].n if k in sizes else 0 for k in range(model.word_shards)])[:-1].tolist()
    for k in set(range(model.word_shards)) - set(sizes):
        _save(model.folder, f"word-{k}", np.zeros(0, np.uint64))
    if model.words >= 2**32 - 1:
        raise ValueError("word numbers of 32 bits are used up")

    model.pair_shards = _shards(size // 8, shard_keys)
    # as many files of word statistics as shards of pairs: what one task merges stays the same as both grow
    while model.block * model.pair_shards < model.words:
        model.block *= 2
    sent = slim.mapInArrow(_count_pairs(model, chunk), SENT)
    stats = sent.groupBy("shard").applyInArrow(_merge_pairs(model.folder, model.block), STATS)
    totals = stats.groupBy("block").applyInArrow(_merge_stats(model.folder, model.block), TOTALS)
    t = totals.agg(*[F.sum(c).alias(c) for c in totals.columns]).first()
    model.pairs = t.pairs
    model.discounts = discounts(t.n1, t.n2, t.n3, t.n4)
    model.word_discounts = discounts(t.m1, t.m2, t.m3, t.m4)
    model.word_types = (t.m1, t.m2, t.more)
    for k in range(model.pair_shards):
        if not os.path.exists(f"{model.folder}/pair-{k}.npy"):
            _save(model.folder, f"pair-{k}", np.zeros(0, np.uint64))
    return model


def _discount(counts: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
    return np.array((0.0, *by))[np.minimum(counts, 3)]


def probabilities(model: Model, number: np.ndarray, first: np.ndarray, end: np.int64) -> np.ndarray:
    """Probability of each token given the one before."""
    floor = 1 / (model.words + 1)
    if not model.words:
        return np.full(len(number), floor)
    words, place = np.unique(number, return_inverse=True)
    stats = model.word_statistics(words)
    mass = sum(d * n for d, n in zip(model.word_discounts, model.word_types)) / model.pairs
    seen = stats[:, 4]
    unigram = ((seen - _discount(seen, model.word_discounts)) / model.pairs + mass * floor)[place]
    pairs, which = np.unique(_pair_keys(number, first, end), return_inverse=True)
    count = model.pair_count(pairs)[which]
    context = np.concatenate(([end], number[:-1])) if len(number) else number
    context[first[:-1]] = end
    after = stats[np.searchsorted(words, context)]
    total = after[:, 0]
    back = after[:, 1:4] @ np.array(model.discounts)
    with np.errstate(divide="ignore", invalid="ignore"):
        mixed = (count - _discount(count, model.discounts) + back * unigram) / total
    return np.where(total > 0, mixed, unigram)


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"


def _score(model: Model, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", chunk):
            keys, first = token_keys(part.column("text").to_pylist())
            values, place = np.unique(keys, return_inverse=True)
            number, count = (a[place] for a in model.number(values))
            at = first[:-1]
            base = np.add.reduceat(np.log10((count + 1) / (model.tokens + model.words + 1)), at)
            p = probabilities(model, number, first, model.number(np.array([END]))[0][0])
            score = np.add.reduceat(np.log10(p), at)
            n = np.diff(first)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("held_out"), pa.array(n), pa.array(np.add.reduceat((count > 0).astype(np.int64), at)),
                pa.array(np.full(len(n), model.tokens)), pa.array(base), pa.array(score), pa.array(10 ** np.minimum(300, -score / n)),
            ], [c.split()[0] for c in SCORES.split(", ")])

    return run


def lm_scores(docs: DataFrame, model: Model, held_out, doc_id: str = "doc_id", text: str = "text", chunk: int = 8_000_000) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    NULL texts count as empty, that is one end token. Repeated rows and NULL ids are kept.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(_score(model, chunk), SCORES)


@query("op4_lm_score")
def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False))
    return lm_scores(docs, train(docs.filter(~held)), held).drop("perplexity")
