"""Toxicity by a support vector machine over a gapped subsequence kernel with Nyström landmarks.

The kernel compares words as strings with a start mark: it sums, over the three-character
subsequences two words share, the product of their decayed gaps, so inserted characters and gaps
lower the value but do not remove it. Landmark words give the Nyström features, a squared-hinge SVM
is trained on them, and since the SVM is linear in the kernel it collapses into one weight per
subsequence. Scoring is one pass over the characters of whole texts.

Characters between letters inside a token are removed ("i-d-i-o-t"), and runs of three or more
one-letter tokens are joined ("i d i o t").

Labels belong to documents; every sentence of the training sample carries the label of its document.
Words are weighted by the number of labelled sentences they occur in (once per document), with
classes balanced. A logistic curve over pooled word margins gives the document probability.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import crc_mod, mix, query, read, slices, whole_rows

CLASSES = 64  # characters are hashed to so many classes; 0 ends a word, 1 starts one
DECAY = 0.7
# subsequences as offsets from their first character: three characters up to five apart, five with at most one gap
OFFSETS = [(a, b) for b in range(2, 6) for a in range(1, b)] + [(1, 2, 3, 4)] + [
    tuple(k for k in range(1, 6) if k != gap) for gap in range(1, 5)
]
SPAN = 5
FEATURES = 1 << 20
SENTENCE = re.compile(r"[.!?\n]+")
POOLED = 10
FOLDS = 3
FLOOR = 0.3  # margins below say nothing about a document
MAX_WORDS = 12_000  # training words of each sort


def _character_classes() -> np.ndarray:
    """Class of each BMP code point: lower-cased letters from 2 on, 0 for white space, -1 for others (removed)."""
    out = np.full(0x10000, -1, np.int16)
    for code in range(0x10000):
        c = chr(code)
        if c.isspace():
            out[code] = 0
        elif c.isalpha() or c.isdigit():
            low = ord(c.lower()[0])
            if 97 <= low <= 122:
                out[code] = 2 + low - 97
            elif 48 <= low <= 57:
                out[code] = 28 + low - 48
            else:
                out[code] = 38 + int(mix(np.array([low], np.uint64))[0] % np.uint64(CLASSES - 38))
    return out


_CLASSES: np.ndarray | None = None


def classes_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Character classes of all texts with word starts marked, and each text's first position (and the end).

    Every word is one 1 and its letters, then one 0.
    """
    global _CLASSES
    if _CLASSES is None:
        _CLASSES = _character_classes()
    parts = [(t or "").encode("utf-32-le", "replace") for t in texts]
    codes = np.frombuffer(b"".join(p + b" \x00\x00\x00" for p in parts), np.uint32)
    kinds = np.where(codes < 0x10000, _CLASSES[np.minimum(codes, 0xFFFF)], CLASSES - 1).astype(np.int16)
    owner_end = np.cumsum([len(p) // 4 + 1 for p in parts])
    # the last blank of a text stays apart, so nothing is joined across texts
    kept = np.flatnonzero(kinds >= 0)
    kinds, last = kinds[kept], np.zeros(len(codes), bool)
    last[owner_end - 1] = True
    last = last[kept]
    blank = kinds == 0
    # one blank between words
    double = blank & np.concatenate(([True], blank[:-1])) & ~last
    kinds, last = kinds[~double], last[~double]
    blank = kinds == 0
    # join runs of three or more one-letter words: drop the blank between two of them inside such a run
    at = np.flatnonzero(blank)
    sizes = np.diff(np.concatenate(([-1], at))) - 1  # letters before each blank
    single = (sizes == 1)
    fence = last[at]  # a text ends here
    inner = np.zeros(len(at), bool)
    if single.any():
        ids = np.cumsum(np.concatenate(([True], ~(single[1:] & single[:-1]) | fence[:-1])))
        length = np.bincount(ids, weights=single)[ids]
        same = np.concatenate((ids[1:] == ids[:-1], [False]))
        inner = same & single & (length >= 3)
    keep = np.ones(len(kinds), bool)
    keep[at[inner]] = False
    kinds, last = kinds[keep], last[keep]
    blank = kinds == 0
    starts = np.concatenate(([True], blank[:-1])) & ~blank
    shift = np.cumsum(starts)
    out = np.zeros(len(kinds) + int(starts.sum()), np.int64)
    out[np.arange(len(kinds)) + shift] = kinds
    out[np.flatnonzero(starts) + shift[starts] - 1] = 1
    ends = (np.arange(len(kinds)) + shift)[last] + 1
    return out, np.concatenate(([0], ends))


def _strength(offsets: tuple[int, ...]) -> float:
    """Decayed weight of a subsequence: one factor for each step beyond the shortest, and for its length."""
    return DECAY ** (2 + offsets[-1] - len(offsets))


def _norm(length: np.ndarray) -> np.ndarray:
    """Kernel norm of a word of so many characters (with both marks), if no subsequence repeats."""
    total = sum(np.maximum(0, length - o[-1]) * _strength(o) ** 2 for o in OFFSETS)
    return np.sqrt(np.maximum(total, DECAY ** 4))


def subsequences(kinds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Per kind of subsequence: first positions (ascending), hashed features, weight.

    The end mark of a word is the 0 after it.
    """
    n = len(kinds)
    padded = np.concatenate((kinds, np.zeros(SPAN, np.int64)))
    inside = [padded[:n] > 0]
    for d in range(1, SPAN):
        inside.append(inside[-1] & (padded[d:d + n] > 0))
    for offsets in OFFSETS:
        at = np.flatnonzero(inside[offsets[-1] - 1])
        index = padded[at].copy()
        for o in offsets:
            index *= CLASSES
            index += padded[at + o]
        if len(offsets) > 2:  # 30 bits are folded; three characters have 18 bits of their own
            index = (index * 0x9E3779B1 >> 7) & (FEATURES - 1)
        yield at, index, _strength(offsets)


def _extents(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position of each word and its number of characters with both marks."""
    begin = np.flatnonzero(kinds == 1)
    stop = np.flatnonzero((kinds > 0) & np.concatenate((kinds[1:] == 0, [True])))
    return begin, stop - begin + 2


def word_margins(kinds: np.ndarray, weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """SVM margin of each word (a run of 1 and letters), and its first position."""
    begin, length = _extents(kinds)
    if not len(begin):
        return np.zeros(0), begin
    sums = np.zeros(len(kinds), np.float32)
    for at, index, strength in subsequences(kinds):
        sums[at] += np.float32(strength) * weights[index]
    return np.add.reduceat(sums, begin) / _norm(length) + bias, begin


def pooled(kinds: np.ndarray, bounds: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    """Document features: the three strongest margins, hits above three levels, their share, number of words."""
    margins, begin = word_margins(kinds, weights, bias)
    first = np.searchsorted(begin, bounds)
    counts = np.diff(first)
    out = np.zeros((len(counts), POOLED))
    out[:, :3] = FLOOR
    at = np.flatnonzero(margins > FLOOR)
    owner = np.searchsorted(first, at, side="right") - 1
    order = np.lexsort((-margins[at], owner))
    at, owner = at[order], owner[order]
    place = np.arange(len(at)) - np.searchsorted(owner, owner)
    top = place < 3
    out[owner[top], place[top]] = np.minimum(margins[at[top]], 1.0)
    for k, level in enumerate((FLOOR, 0.5, 0.65)):
        hits = np.bincount(owner, weights=np.clip((margins[at] - level) / 0.3, 0, 1), minlength=len(counts))
        out[:, 3 + k] = np.log1p(hits)
        out[:, 6 + k] = np.sqrt(hits / np.maximum(1, counts))
    out[:, 9] = np.log1p(counts)
    return out


@dataclass
class ToxicityModel:
    weights: np.ndarray  # one per three-character subsequence
    bias: float
    curve: np.ndarray  # logistic coefficients over pooled features, the constant last
    center: np.ndarray
    scale: np.ndarray

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = pooled(*classes_of(texts), self.weights, self.bias)
        z = ((x - self.center) / self.scale) @ self.curve[:-1] + self.curve[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Landmarks:
    """Words that span the Nyström features; only subsequences that some landmark has are stored."""

    def __init__(self, words: list[bytes]):
        kinds = _stream(words)
        begin, length = _extents(kinds)
        norm = _norm(length)
        parts = [(at, index, strength) for at, index, strength in subsequences(kinds)]
        self.features, rows = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
        owner = np.searchsorted(begin, np.concatenate([p[0] for p in parts]), side="right") - 1
        value = np.concatenate([np.full(len(p[0]), p[2]) for p in parts])
        self.table = np.zeros((len(self.features) + 1, len(words)), np.float32)  # row 0: no landmark has it
        np.add.at(self.table, (rows + 1, owner), value / norm[owner])
        self.row_of = np.zeros(FEATURES, np.int32)
        self.row_of[self.features] = np.arange(1, len(self.features) + 1)

    def kernel(self, words: list[bytes], at_once: int = 2000) -> np.ndarray:
        """Kernel between words and landmarks."""
        out = np.zeros((len(words), self.table.shape[1]), np.float32)
        for first in range(0, len(words), at_once):
            kinds = _stream(words[first:first + at_once])
            begin, length = _extents(kinds)
            part = out[first:first + at_once]
            for at, index, strength in subsequences(kinds):
                rows = self.row_of[index]
                hit = rows > 0
                if hit.any():
                    owner = np.searchsorted(begin, at[hit], side="right") - 1
                    edge = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
                    part[owner[edge]] += np.float32(strength) * np.add.reduceat(self.table[rows[hit]], edge, axis=0)
            part /= _norm(length)[:, None].astype(np.float32)
        return out

    def collapse(self, coefficients: np.ndarray) -> np.ndarray:
        """One weight per subsequence for a function that is linear in the kernel values."""
        weights = np.zeros(FEATURES, np.float32)
        weights[self.features] = self.table[1:] @ coefficients.astype(np.float32)
        return weights


def _stream(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(w + b"\0" for w in words), np.uint8).astype(np.int64)


def squared_hinge(x: np.ndarray, positive: np.ndarray, negative: np.ndarray, l2: float, rounds: int = 15,
                  block: int = 4000) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by Newton steps.

    Every row is an example of either label, with the weights ``positive`` and ``negative``. Rows are
    taken in blocks, so memory stays near that of ``x``.
    """
    w, bias_at = np.zeros(x.shape[1] + 1), x.shape[1]
    reg = np.full(len(w), l2)
    reg[-1] = 1e-6

    def margins(v: np.ndarray) -> np.ndarray:
        return x @ v[:-1].astype(x.dtype) + v[-1]

    def loss(v: np.ndarray, f: np.ndarray) -> float:
        slack = positive * np.maximum(0, 1 - f) ** 2 + negative * np.maximum(0, 1 + f) ** 2
        return 0.5 * float((reg * v * v).sum() + slack.sum())

    f = margins(w)
    for _ in range(rounds):
        up, down = np.maximum(0, 1 - f), np.maximum(0, 1 + f)
        pull = positive * up - negative * down
        curve = positive * (up > 0) + negative * (down > 0)
        grad, hess = reg * w, np.diag(reg)
        for i in range(0, len(x), block):
            part = np.hstack([x[i:i + block], np.ones((len(x[i:i + block]), 1))])
            grad -= part.T @ pull[i:i + block]
            hess += (part.T * curve[i:i + block]) @ part
        step = np.linalg.solve(hess, grad)
        size, now = 1.0, loss(w, f)
        while size > 1e-4 and loss(w - size * step, margins(w - size * step)) > now:
            size /= 2
        w = w - size * step
        f = margins(w)
        if np.abs(size * step).max() < 1e-6:
            break
    return w[:bias_at], float(w[bias_at])


def logistic(x: np.ndarray, y: np.ndarray, c: np.ndarray, l2: float = 0.1, rounds: int = 50) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    reg = np.full(x.shape[1], l2)
    reg[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (c * (p - y)) + reg * w
        step = np.linalg.solve((x.T * (c * p * (1 - p) + 1e-9)) @ x + np.diag(reg), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _word_table(texts: list[str], toxic: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Distinct words (one byte per character) of labelled sentences, and in how many clean and toxic documents each is."""
    table: dict[bytes, int] = {}
    for text, label in zip(texts, toxic):
        kinds, _ = classes_of([s for s in SENTENCE.split(text) if s.strip()] or [""])
        begin, length = _extents(kinds)
        packed, one = kinds.astype(np.uint8).tobytes(), 1 << 32 if label else 1
        for w in {packed[a:b] for a, b in zip(begin.tolist(), (begin + length - 1).tolist())}:
            table[w] = table.get(w, 0) + one
    counts = np.fromiter(table.values(), np.int64, len(table))
    return list(table), np.stack((counts & 0xFFFFFFFF, counts >> 32), axis=1).astype(np.float64)


def fit(texts: list[str], toxic: list[int], share: float | None = None, n_landmarks: int = 224, l2: float = 1.0,
        seed: int = 3) -> ToxicityModel:
    """Train on labelled texts. One class only, or none, gives a constant score.

    ``share`` is the share of toxic documents outside the sample, if classes were drawn differently.
    """
    y = np.array(toxic, np.int64)
    own = float(y.mean()) if len(y) else 0.0
    share = own if share is None or not 0 < own < 1 else share
    if not 0 < share < 1:
        const = np.log((share + 1e-3) / (1 - share + 1e-3))
        return ToxicityModel(np.zeros(FEATURES, np.float32), 0.0, np.r_[np.zeros(POOLED), const], np.zeros(POOLED), np.ones(POOLED))
    rng = np.random.default_rng(seed)
    fold = rng.permutation(len(texts)) % FOLDS
    # margins of documents that trained the words are too good, so the curve is fitted across folds
    x = np.zeros((len(texts), POOLED))
    for k in range(FOLDS):
        if len(set(y[fold != k].tolist())) == 2:
            part = _svm([texts[i] for i in np.flatnonzero(fold != k)], y[fold != k], n_landmarks, l2, rng)
            for i in np.flatnonzero(fold == k):
                x[i] = pooled(*classes_of([texts[i]]), *part)[0]
    weights, bias = _svm(texts, y, n_landmarks, l2, rng)
    center, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    cost = np.where(y == 1, share / own, (1 - share) / (1 - own))
    return ToxicityModel(weights, bias, logistic((x - center) / scale, y, cost), center, scale)


def _svm(texts: list[str], y: np.ndarray, n_landmarks: int, l2: float, rng) -> tuple[np.ndarray, float]:
    words, df = _word_table(texts, y)  # columns: clean, toxic
    total = np.array([(y == 0).sum(), (y == 1).sum()], np.float64)
    rate = df / total
    lift = df[:, 1] * np.log((rate[:, 1] + 0.5 / total[1]) / (rate[:, 0] + 0.5 / total[0]))
    # landmarks: the words most typical of toxic sentences, frequent words of clean ones, and clean neighbours
    typical = np.argsort(-lift)[: n_landmarks // 2]
    common = np.argsort(-rate[:, 0])[: n_landmarks // 4]
    clean = np.flatnonzero(df[:, 0] >= 2)
    clean = clean[np.argsort(-df[clean, 0])][:MAX_WORDS]
    near = Landmarks([words[i] for i in typical]).kernel([words[i] for i in clean]).max(axis=1)
    near = clean[np.argsort(-near * np.log1p(df[clean, 0]))][: n_landmarks - len(typical) - len(common)]
    marks = Landmarks([words[i] for i in dict.fromkeys([*typical.tolist(), *common.tolist(), *near.tolist()])])
    inner = marks.kernel([words[i] for i in dict.fromkeys([*typical.tolist(), *common.tolist(), *near.tolist()])])
    vals, vecs = np.linalg.eigh((inner + inner.T).astype(np.float64) / 2)
    half = vecs / np.sqrt(np.maximum(vals, 1e-3)) @ vecs.T
    # examples: the words with the highest and with the lowest lift, and others at random
    order = np.argsort(-lift)
    used = np.unique(np.concatenate((order[:MAX_WORDS], clean, rng.permutation(len(words))[:MAX_WORDS])))
    x = marks.kernel([words[i] for i in used]) @ half.astype(np.float32)
    w, bias = squared_hinge(x, df[used, 1] * total[0] / total[1] / len(texts), df[used, 0] / len(texts), l2 / 100)
    return marks.collapse(half @ w), bias


def _score(shared, text: str, column: str, keep_below: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(batches, text, 1_000_000):
            scores = model.scores(part.column(text).to_pylist())
            names = part.schema.names
            columns = [pa.array(scores, pa.float64()) if n == column else part.column(k) for k, n in enumerate(names)]
            out = pa.RecordBatch.from_arrays(columns, names)
            yield out if keep_below is None else out.filter(pa.array(scores < keep_below))

    return run


def train(docs: DataFrame, labels: DataFrame, sample_docs: int = 3000, sample_chars: int = 16_000_000) -> ToxicityModel:
    """Fit on a bounded sample of labelled documents.

    At most ``sample_docs`` of each label, drawn by a hash of the id, and ``sample_chars`` in total.
    Documents with crc32(doc_id) mod 5 = 0 are held out.
    """
    known = labels.filter("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(crc_mod(F.col("doc_id"), 5) != 0)
    share = known.agg(F.avg("toxic")).first()[0]
    drawn = [
        known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs) for k in (0, 1)
    ]
    ids = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most 2 * sample_docs rows
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(ids, "doc_id")
    rows = rows.select("doc_id", "text", "toxic").filter("text is not null")
    texts, toxic, held = [], [], 0
    for row in rows.orderBy(F.xxhash64("doc_id", "text")).limit(2 * sample_docs).toLocalIterator():
        if texts and held + len(row.text) > sample_chars:
            continue
        held += len(row.text)
        texts.append(row.text)
        toxic.append(row.toxic)
    return fit(texts, toxic, share)


def toxicity(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id and ``score``; NULL and empty texts get the score of no words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_text"), F.lit(0.0).alias("score"))
    slim = slim.mapInArrow(_score(shared, "_text", "score", None), slim.schema)
    return slim.select("doc_id", "score")


def drop_toxic(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` with a score below ``threshold``; all columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed, unpacked = whole_rows(docs)
    slim = docs.select(F.col(text).cast("string").alias("_text"), F.lit(0.0).alias("_score"), packed)
    return slim.mapInArrow(_score(shared, "_text", "_score", threshold), slim.schema).select(*unpacked)


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labelled documents that are not held out."""
    docs = read(spark, sf_dir, "documents")
    scored = toxicity(docs, train(docs, read(spark, sf_dir, "labels")))
    held = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
