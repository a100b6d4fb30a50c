"""Language identification by a bidirectional recurrent network over bytes.

Whole texts are cut into windows of ``WINDOW`` bytes that run through the network side by side. Every
byte gets a probability per language, and the mean over the bytes of a document is its probability.
The network is trained in numpy by backpropagation through time on windows drawn from labelled texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions.hashing import hash_unit
from causeway.llm.common import crc_mod, query, read, slices
from causeway.llm.gru import Adam, gradients, init, label_probabilities

WINDOW = 64
AT_ONCE = 4096
LETTER = re.compile(r"[^\W\d_]")


@dataclass
class LanguageModel:
    labels: list[str]
    parameters: dict[str, np.ndarray]

    def label(self, texts: list[str | None], spans: bool = False) -> tuple[np.ndarray, list[list[tuple[int, int, int]]]]:
        """Probabilities per text, and, if asked for, runs of bytes (start, end, label) with one best label."""
        if not self.labels:  # nothing was learned
            return np.zeros((len(texts), 0)), [[] for _ in texts]
        parts = [np.frombuffer((t or "").encode(), np.uint8) for t in texts]
        windows = np.array([-(-len(p) // WINDOW) for p in parts], np.int64)
        first = np.concatenate(([0], np.cumsum(windows)))
        data = np.zeros((int(first[-1]), WINDOW), np.uint8)
        length = np.full(len(data), WINDOW, np.int64)
        for p, a, b in zip(parts, first[:-1], first[1:]):
            if b > a:
                data[a:b].reshape(-1)[:len(p)] = p
                length[b - 1] = len(p) - WINDOW * (b - a - 1)
        sums = np.zeros((len(data), len(self.labels)))
        best = np.zeros(data.shape, np.int16) if spans else None
        for a in range(0, len(data), AT_ONCE):
            some = slice(a, min(a + AT_ONCE, len(data)))
            valid = (np.arange(WINDOW) < length[some][:, None]).astype(np.float32)
            prob = label_probabilities(self.parameters, data[some], valid)
            sums[some] = np.einsum("tbl,bt->bl", prob, valid)
            if spans:
                best[some] = prob.argmax(axis=2).T
        out = np.full((len(texts), len(self.labels)), 1 / max(1, len(self.labels)))
        full = np.flatnonzero(windows)
        if len(full):
            sizes = np.array([len(parts[i]) for i in full])
            out[full] = np.add.reduceat(sums, first[:-1][full], axis=0) / sizes[:, None]
        runs: list[list[tuple[int, int, int]]] = []
        if spans:
            for p, a, b in zip(parts, first[:-1], first[1:]):
                own = best[a:b].reshape(-1)[:len(p)]
                edge = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.zeros(0, np.int64)
                runs.append([(int(s), int(e), int(own[s])) for s, e in zip(edge, np.append(edge[1:], len(own)))])
        return out, runs


def fit(texts: list[str], langs: list[str], hidden: int = 8, steps: int = 400, batch: int = 96, seed: int = 11) -> LanguageModel:
    """Train on windows drawn from the texts, each language equally often."""
    labels = sorted(set(langs))
    p = init(len(labels), hidden, seed)
    by_label = [[np.frombuffer(t.encode(), np.uint8) for t, g in zip(texts, langs) if g == name] for name in labels]
    by_label = [[t for t in some if len(t)] or [np.full(1, 32, np.uint8)] for some in by_label]
    if len(labels) < 2:
        return LanguageModel(labels, p)
    rng, adam = np.random.default_rng(seed), Adam()
    for step in range(steps):
        adam.rate = 0.02 * min(1.0, 2 * (1 - step / steps) + 0.02)
        y = rng.integers(0, len(labels), batch)
        data = np.zeros((batch, WINDOW), np.uint8)
        for i, k in enumerate(y):
            text = by_label[k][rng.integers(len(by_label[k]))]
            at = rng.integers(0, max(1, len(text) - WINDOW + 1))
            data[i] = np.resize(text[at:at + WINDOW], WINDOW)
        adam.update(p, gradients(p, data, y)[1])
    return LanguageModel(labels, p)


def train(docs: DataFrame, label: str = "lang", text: str = "text", doc_id: str = "doc_id", sample_docs: int = 300,
          sample_bytes: int = 16_000_000, **options) -> LanguageModel:
    """Fit on at most ``sample_docs`` texts of each language, drawn by a hash, of ``sample_bytes`` in total."""
    known = docs.select(F.col(label).cast("string").alias("lang"), F.col(text).cast("string").alias("text"), F.col(doc_id).alias("key"))
    known = known.filter("lang is not null and text is not null")
    known = known.filter(F.col("text").rlike(r"\p{L}"))
    # one row per language, which the model holds anyway; the draw then needs no join and moves only what it takes
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return fit([], [], **options)
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 2 * sample_docs / n)))])
    drawn = known.filter(hash_unit(F.coalesce(F.col("key").cast("string"), F.lit("")), F.xxhash64("text")) < share[F.col("lang")])
    texts, langs, taken, held = [], [], {}, 0
    for row in drawn.orderBy(F.xxhash64("key", "text")).toLocalIterator():
        size = len(row.text.encode())
        if taken.get(row.lang, 0) < sample_docs and (row.lang not in taken or held + size <= sample_bytes):
            taken[row.lang] = taken.get(row.lang, 0) + 1
            held += size
            texts.append(row.text)
            langs.append(row.lang)
    return fit(texts, langs, **options)


RESULT = "doc_id bigint, lang_pred string, score double, spans array<struct<start: int, end: int, lang: string>>"


def _predict(shared, spans: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        struct = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for part in slices(batches, "text", 1_000_000):
            texts = part.column("text").to_pylist()
            prob, runs = model.label(texts, spans)
            known = [bool(model.labels) and t is not None and LETTER.search(t) is not None for t in texts]
            best = prob.argmax(axis=1) if model.labels else np.zeros(len(texts), np.int64)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array([model.labels[b] if k else "und" for k, b in zip(known, best)]),
                pa.array([float(min(1.0, prob[i, b])) if k else 0.0 for i, (k, b) in enumerate(zip(known, best))], pa.float64()),
                pa.array([[{"start": a, "end": e, "lang": model.labels[g]} for a, e, g in r] for r in runs] if spans else [None] * len(texts), struct),
            ], ["doc_id", "lang_pred", "score", "spans"])

    return run


def languages(docs: DataFrame, model: LanguageModel, doc_id: str = "doc_id", text: str = "text", spans: bool = True) -> DataFrame:
    """One row per document: doc_id, lang_pred, score and the labelled runs of bytes.

    Texts that are NULL or have no letter are ``und`` with score 0. Repeated rows and NULL ids are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(_predict(shared, spans), RESULT)


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents by a network trained on those that are not held out."""
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    found = languages(docs, train(docs.filter(~held)), spans=False)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
