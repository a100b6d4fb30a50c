"""Ranked lexical search as dense blocked matrix products.

Items (queries) come in blocks of bounded text. A block's terms are counted over all documents in one
pass, and a second pass scores them: documents become tiles of impacts, items become tiles of weights
over their own compact vocabulary, and BLAS multiplies tile by tile in float64. Every number in a
product is a whole number: impacts are at most 10**6 < 2**20, weights are cut into digits below 2**20
and a tile has at most 2**12 terms, so no partial sum reaches 2**53 and all sums are exact; digits and
tiles are added up in 64-bit integers.

A task keeps, per item, its best rows in the order (score descending, doc_id ascending), with all ties
at the cut compared, so what it drops cannot be among the best of all. Two rounds of ranks join the
tasks' rows: no step takes more than ``k`` rows per item from a task.

NULL texts have no terms and never appear; items without terms give no rows; repeated items are items
of their own with ranks from 1; repeated documents are rows of their own; documents with a NULL id come
after all others of the same score. ``doc_id`` is read as BIGINT. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import query, read, slices, top_rows, words_of
from causeway.session import durable

DIGIT = 20  # bits of an impact and of one digit of a weight
TILE_TERMS = 1 << 12
TILE_ITEMS = 128
TILE_DOCS = 1024
TILE_ENTRIES = 1 << 21  # of (document, term) in a tile of documents


class Block:
    """Some items: their ids, their vocabulary and, per item, its terms with their repeats."""

    def __init__(self) -> None:
        self.ids: list = []
        self.vocabulary: dict[bytes, int] = {}
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, item_id, words: list[bytes]) -> None:
        counts = Counter(words)
        number = self.vocabulary
        terms = np.array([number.setdefault(w, len(number)) for w in counts], np.int64)
        self.ids.append(item_id)
        self.rows.append((terms, np.fromiter(counts.values(), np.int64, len(counts))))
        self.size += sum(map(len, counts)) + 16 * len(counts)


def item_blocks(items: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[Block]:
    """Items with at least one term, in blocks of about ``block_bytes``; only one block is held at a time."""
    block = Block()
    for row in items.select(F.col(item_id).alias("i"), F.col(text).cast("string").alias("t")).toLocalIterator():
        if words := words_of(row.t):
            block.add(row.i, words)
            if block.size >= block_bytes:
                yield block
                block = Block()
    if block.ids:
        yield block


def term_counts(texts: list[str | None], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms in each text, and for every (text, vocabulary term) that occurs: text, term, occurrences."""
    length = np.zeros(len(texts), np.int64)
    doc, term, times = [], [], []
    for k, text in enumerate(texts):
        words = words_of(text)
        length[k] = len(words)
        found = np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int64, len(words))
        found, n = np.unique(found[found >= 0], return_counts=True)
        doc.append(np.full(len(found), k))
        term.append(found)
        times.append(n)
    none = [np.zeros(0, np.int64)]
    return length, np.concatenate(doc or none), np.concatenate(term or none), np.concatenate(times or none)


def _count(shared, tile_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value.vocabulary
        df = np.zeros(len(vocabulary) + 2, np.int64)  # then: documents with a term, all terms
        for batch in slices(batches, "text", tile_bytes):
            length, _, term, _ = term_counts(batch.column("text").to_pylist(), vocabulary)
            df[:-2] += np.bincount(term, minlength=len(vocabulary))
            df[-2:] += (np.count_nonzero(length), length.sum())
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.int64()), "n": pa.array(df[some], pa.int64())})

    return run


def impacts(length: np.ndarray, times: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """(10**9 tf) div (1000 tf + 12 m), with m = 75 + (25 n N) div L, all in whole numbers."""
    if len(length) and 25 * int(length.max()) * n_docs >= 2**63:
        m = np.array([75 + 25 * int(n) * n_docs // n_terms for n in length], np.int64)
    else:
        m = 75 + 25 * length * n_docs // n_terms
    return 1_000_000_000 * times // (1000 * times + 12 * m)


class ItemTile:
    """Weights of some items over their own terms, as sparse entries cut into digits."""

    def __init__(self, first: int, rows: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray) -> None:
        self.first, self.n = first, len(rows)
        terms = np.concatenate([t for t, _ in rows])
        self.terms, self.at = np.unique(terms, return_inverse=True)
        self.item = np.repeat(np.arange(self.n), [len(t) for t, _ in rows])
        self.weight = np.concatenate([n for _, n in rows]) * weights[terms]

    def scores(self, n_docs: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray) -> np.ndarray:
        """Scores (items, documents) of a tile of documents, given as entries sorted by nothing."""
        out = np.zeros((self.n, n_docs), np.int64)
        place = np.searchsorted(self.terms, term)
        place[place == len(self.terms)] = 0
        own = self.terms[place] == term
        doc, place, impact = doc[own], place[own], impact[own]
        used, place = np.unique(place, return_inverse=True)  # only terms that the tile of documents has
        column = np.full(len(self.terms), -1)
        column[used] = np.arange(len(used))
        at = column[self.at]
        for low in range(0, len(used), TILE_TERMS):
            width = min(TILE_TERMS, len(used) - low)
            here = (place >= low) & (place < low + width)
            right = np.zeros((width, n_docs))
            right[place[here] - low, doc[here]] = impact[here]
            here = (at >= low) & (at < low + width)
            rows, columns, rest, shift = self.item[here], at[here] - low, self.weight[here], 0
            while len(rest):
                left = np.zeros((self.n, width))
                left[rows, columns] = rest & ((1 << DIGIT) - 1)
                out += (left @ right).astype(np.int64) << shift
                more = rest >> DIGIT > 0
                rows, columns, rest, shift = rows[more], columns[more], rest[more] >> DIGIT, shift + DIGIT
        return out


class Best:
    """The ``k`` best (score, doc_id) of each item so far: highest score first, then smallest id, NULL ids last."""

    def __init__(self, n_items: int, k: int) -> None:
        self.k = k
        none = np.zeros(0, np.int64)
        self.rows = [(none, none, none.astype(bool))] * n_items
        self.least = np.ones(n_items, np.int64)  # scores below cannot enter

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        some = scores >= self.least[item]
        if not some.any():
            return
        new = scores[some]
        if len(new) > self.k:  # all that tie with the k-th stay for the comparison of ids
            cut = np.partition(new, len(new) - self.k)[len(new) - self.k]
            some &= scores >= cut
        s, d, n = (np.concatenate(x) for x in zip(self.rows[item], (scores[some], ids[some], null[some])))
        order = np.lexsort((d, n, -s))[:self.k]
        self.rows[item] = (s[order], d[order], n[order])
        if len(order) == self.k:
            self.least[item] = s[order[-1]]


def _search(shared, weights, n_docs: int, n_terms: int, k: int, tile_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        w = weights.value
        tiles = [ItemTile(a, block.rows[a:a + TILE_ITEMS], w) for a in range(0, len(block.rows), TILE_ITEMS)]
        best = Best(len(block.rows), k)

        def score(ids, null, length, doc, term, times):
            impact = impacts(length[doc], times, n_docs, n_terms)
            for tile in tiles:
                for j, row in enumerate(tile.scores(len(ids), doc, term, impact)):
                    best.add(tile.first + j, row, ids, null)

        for batch in slices(batches, "text", tile_bytes):
            for a in range(0, batch.num_rows, TILE_DOCS):
                part = batch.slice(a, TILE_DOCS)
                ids = part.column("doc_id")
                null = ids.is_null().to_numpy(zero_copy_only=False)
                score(ids.fill_null(0).to_numpy(zero_copy_only=False), null, *term_counts(part.column("text").to_pylist(), block.vocabulary))
        for item, (s, d, n) in enumerate(best.rows):
            if len(s):
                yield pa.RecordBatch.from_pydict({
                    "item": pa.array(np.full(len(s), item), pa.int32()), "doc_id": pa.array(d, pa.int64(), mask=n),
                    "score": pa.array(s, pa.int64()),
                })

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_id: str = "doc_id", text: str = "text",
           item_id: str = "item_id", item_text: str = "text", block_bytes: int = 4_000_000,
           tile_bytes: int = 4_000_000) -> DataFrame:
    """The ``k`` best documents of each item with a score above 0: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = items.schema[item_id].dataType.simpleString()
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for block in item_blocks(items, item_id, item_text, block_bytes):
        shared = spark.sparkContext.broadcast(block)
        counted = slim.mapInArrow(_count(shared, tile_bytes), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        df = np.zeros(len(block.vocabulary) + 2, np.int64)
        for row in counted.collect():  # one number per term of the block
            df[row.term] = row.n
        n_docs, n_terms = map(int, df[-2:])
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df[:-2]], np.int64)
        shared_weights = spark.sparkContext.broadcast(weights)
        found = slim.mapInArrow(
            _search(shared, shared_weights, n_docs, n_terms, k, tile_bytes), "item int, doc_id long, score long")
        order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
        ranked = durable(top_rows(found, ["item"], order, k, "rank"))
        names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {kind}")
        out = out.unionByName(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
        shared.destroy()
        shared_weights.destroy()
    return out


SQL = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
q AS (
  SELECT item_id, term, count(*) AS qtf FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark) GROUP BY ALL),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
tot AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM len),
w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, tot
  WHERE term IN (SELECT term FROM q) GROUP BY term, docs),
s AS (
  SELECT item_id, tf.doc_id,
         sum(qtf * w.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN len ON len.doc_id = tf.doc_id, tot GROUP BY item_id, tf.doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM r WHERE rank <= 20
"""


@query("op11_lexical_search", SQL)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
