"""Packing of token ids into sequences: first fit decreasing over a tournament tree.

A document is cut into full pieces, which are sequences of their own, and one rest. Rests are dealt
at random into groups of about ``group_rows``, and each group is packed on its own: pieces in order
of decreasing length, each into the first bin with room, which the tree finds in logarithmic time.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import mix, query, read, slices, token_hashes
from causeway.session import durable

PIECES = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
          "sequence_id bigint, offset bigint")
TABLE_BYTES = 32_000_000
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
MARKS = b".,;:!?#$%&*"
SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
ASCII_WORD = frozenset(bytes([b]) for b in b"abcdefghijklmnopqrstuvwxyz0123456789")
GROUPED = 1 << 62  # sequence ids of packed groups start here


def _hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of each word; words hold no ASCII white space and are not empty."""
    return token_hashes(np.frombuffer(b" ".join(words), np.uint8), SPACE)[2]


class WordTokenizer:
    """Ids of texts by a tokenizer that drops white space and case, so that words are encoded once each.

    Texts are split at ASCII white space, which the tokenizer treats as a border as well. A-Z is
    lower-cased first, and a new word's closing punctuation after an ASCII letter or digit, another
    border, is encoded apart. Texts with the opening of a special token are only split. Words met so
    far are a sorted table of hashes with places in one array of ids; a table beyond ``TABLE_BYTES``
    starts anew.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.first, self.count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, "<u4")

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in the table of each hash, and whether it is there."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def _add(self, hashes: np.ndarray, coded: list[bytes]) -> None:
        """Enter new hashes, in ascending order, with their ids."""
        count = np.array([len(c) // 4 for c in coded], np.int64)
        first = len(self.ids) + np.cumsum(count) - count
        at = np.searchsorted(self.hashes, hashes)
        self.hashes = np.insert(self.hashes, at, hashes)
        self.first, self.count = np.insert(self.first, at, first), np.insert(self.count, at, count)
        self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(coded), "<u4")])

    def _learn(self, words: list[bytes], hashes: np.ndarray) -> None:
        """Enter ``words``, none of which is in the table, with their ascending hashes."""
        parts: dict[bytes, bytes] = {}
        cut = []
        for w in words:
            core = w.rstrip(MARKS)
            if len(core) < len(w) and core[-1:] in ASCII_WORD and b"<|" not in w:
                cut.append(len(core))
                parts[core] = parts[w[len(core):]] = b""
            else:
                cut.append(0)
                parts[w] = b""
        names = list(parts)
        at, known = self._find(_hashes(names))
        for k in np.flatnonzero(known).tolist():
            first = self.first[at[k]]
            parts[names[k]] = self.ids[first:first + self.count[at[k]]].tobytes()
        fresh = [names[k] for k in np.flatnonzero(~known).tolist()]
        for i in range(0, len(fresh), 20_000):
            some = fresh[i:i + 20_000]
            coded = self.tokenizer.encode_batch_fast([w.decode() for w in some], add_special_tokens=False)
            parts.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(some, coded))
        self._add(hashes, [parts[w[:c]] + parts[w[c:]] if c else parts[w] for w, c in zip(words, cut)])
        extra = {h: w for h, w in zip(_hashes(fresh).tolist(), fresh)} if fresh else {}
        order = np.array(sorted(extra), np.uint64)
        order = order[~self._find(order)[1]]
        self._add(order, [parts[extra[h]] for h in order.tolist()])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; NULL counts as empty."""
        parts = [(t or "").encode() for t in texts]
        parts = [p if b"<|" in p else p.translate(LOWERED) for p in parts]
        data = b"\n".join(parts)
        start, end, hashes = token_hashes(np.frombuffer(data, np.uint8), SPACE)
        if self.hashes.nbytes * 3 + self.ids.nbytes > TABLE_BYTES:
            self._forget()
        distinct, place, word = np.unique(hashes, return_index=True, return_inverse=True)
        new = np.flatnonzero(~self._find(distinct)[1])
        if len(new):
            spans = zip(start[place[new]].tolist(), end[place[new]].tolist())
            self._learn([data[a:b] for a, b in spans], distinct[new])
        entry = self._find(distinct)[0][word]
        count = self.count[entry]
        ends = np.cumsum(count)
        ids = self.ids[np.repeat(self.first[entry] - ends + count, count) + np.arange(count.sum())]
        text_end = np.cumsum([len(p) + 1 for p in parts], dtype=np.int64)
        bounds = np.concatenate(([0], ends))[np.searchsorted(start, text_end)].tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *bounds], bounds)]


@lru_cache(maxsize=1)
def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per worker process, so that later tasks know the words of earlier ones."""
    return WordTokenizer(path)


def tournament(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """First fit decreasing: bin and offset of each piece.

    The tree holds, per node, the largest room below it; the leftmost leaf with enough room is the
    first bin that fits. Unopened bins have full room, so opening one needs no special case.
    """
    n = len(sizes)
    leaves = 1
    while leaves < max(1, n):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[i]), 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[i], offsets[i] = node - leaves, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            best = room[2 * node] if room[2 * node] >= room[2 * node + 1] else room[2 * node + 1]
            if room[node] == best:
                break
            room[node] = best
    return bins, offsets


def _cut(path: str, doc_id: str, text: str, size: int, end_id: int, groups: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(path)
        part = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        seen = full = 0
        for batch in slices(batches, text, 2_000_000):
            ids = batch.column(doc_id).to_pylist()
            out: list[tuple] = []
            for key, coded in zip(ids, tokenizer.encode(batch.column(text).to_pylist())):
                coded += end
                total = len(coded) // 4
                seen += 1
                for start in range(0, total, size):
                    piece = coded[4 * start:4 * (start + size)]
                    length = len(piece) // 4
                    if length == size:
                        group, sequence = -1, (part << 36) + full
                        full += 1
                    else:
                        drawn = mix(np.array([(part << 36) + seen], np.uint64), seed)[0]
                        group, sequence = int(drawn % np.uint64(groups)), None
                    out.append((key, start, length, zlib.crc32(piece), total, sequence, 0, group))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "_group"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)

    return run


def _pack(size: int):
    def run(table: pa.Table) -> pa.Table:
        bins, offsets = tournament(table["length"].to_numpy(), size)
        group = table["_group"][0].as_py()
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        sequence = pa.array(GROUPED + (group << 24) + bins)
        return pa.table({**{n: table[n] for n in names}, "sequence_id": sequence, "offset": pa.array(offsets)})

    return run


def pack(docs: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 1, group_rows: int = 2048,
         doc_id: str = "doc_id", text: str = "text", seed: int = 7) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is its ids plus ``end_id``; NULL and empty texts are that one id. Repeated rows are
    packed as often as they occur, and NULL ids are kept. Groups are drawn per row from its place in
    the input, so no id and no source makes a group large.
    """
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    groups = max(1, -(-docs.count() // group_rows))
    pieces = slim.mapInArrow(
        _cut(tokenizer_path, "doc_id", "text", size, end_id, groups, seed), PIECES + ", _group bigint")
    pieces = durable(pieces)  # full pieces keep their place; only rests are shuffled
    rests = pieces.filter("_group >= 0").groupBy("_group").applyInArrow(_pack(size), PIECES)
    return pieces.filter("_group < 0").drop("_group").unionByName(rests)


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    import public_tokenizers

    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
