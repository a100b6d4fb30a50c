"""Kneser-Ney scores against a dictionary version."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from causeway.llm import common, lm_score

ODD = [(1, None), (2, ""), (3, "A b  c"), (3, "A b  c"), (None, "a\tB\x0bzz é"), (4, "x " * 5000), (5, "q" * 100_000), (6, "c b a"), (9, "b c new")]


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans(common.UPPER, common.LOWER))), None]


def held(key):
    return key is not None and zlib.crc32(str(key).encode()) % 7 == 2


class Plain:
    def __init__(self, texts):
        seqs = [tokens(t) for t in texts]
        self.count = Counter(w for s in seqs for w in s)
        self.n, self.v = sum(self.count.values()), len(self.count)
        self.pair = Counter((a, b) for s in seqs for a, b in zip([None, *s[:-1]], s))
        self.cont = Counter(b for _, b in self.pair)
        self.after = {}
        for (a, _), c in self.pair.items():
            self.after.setdefault(a, Counter())[min(c, 3)] += 1
        self.total = Counter()
        for (a, _), c in self.pair.items():
            self.total[a] += c
        self.d = lm_score.discounts(*(sum(c == k for c in self.pair.values()) for k in (1, 2, 3, 4)))
        self.d1 = lm_score.discounts(*(sum(c == k for c in self.cont.values()) for k in (1, 2, 3, 4)))

        self.mass = sum(self.d1[min(c, 3) - 1] for c in self.cont.values()) / max(1, len(self.pair))

    def unigram(self, w):
        if not self.pair:
            return 1.0
        c = self.cont[w]
        return (c - (self.d1[min(c, 3) - 1] if c else 0)) / len(self.pair) + self.mass / (self.v + 1)

    def p(self, w, a):
        if not self.total[a]:
            return self.unigram(w)
        c = self.pair[a, w]
        back = sum(self.d[k - 1] * n for k, n in self.after[a].items())
        return (c - (self.d[min(c, 3) - 1] if c else 0) + back * self.unigram(w)) / self.total[a]

    def row(self, text):
        s = tokens(text)
        base = sum(math.log10((self.count[w] + 1) / (self.n + self.v + 1)) for w in s)
        return len(s), sum(self.count[w] > 0 for w in s), self.n, base, sum(math.log10(self.p(w, a)) for a, w in zip([None, *s[:-1]], s))


def compare(df, rows, chunk, **options):
    out = F.coalesce(common.crc_mod(F.col("doc_id"), 7) == 2, F.lit(False))
    model = lm_score.train(df.filter(~out), chunk=chunk, **options)
    plain = Plain([t for k, t in rows if not held(k)])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm_score.lm_scores(df, model, out, chunk=chunk).collect()), key=str)
    want = sorted(((k, held(k), *plain.row(t)) for k, t in rows), key=str)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    return plain


def test_odd_rows(spark):
    df = spark.createDataFrame([(k, t, 1.0) for k, t in ODD], "doc_id long, text string, score double").repartition(3)
    plain = compare(df, ODD, 8_000_000)
    for a in [*plain.total, "never"]:  # a distribution over all known words and one unknown
        assert sum(plain.p(w, a) for w in [*plain.count, "unknown"]) == pytest.approx(1)
    empty = df.limit(0)
    assert lm_score.lm_scores(empty, lm_score.train(empty), F.lit(False)).count() == 0
    assert lm_score.lm_scores(df, lm_score.train(empty), F.lit(False)).agg(F.sum("score")).first()[0] == 0


def test_documents_in_many_chunks_and_shards(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    compare(df, [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()], 150_000, shard_keys=15_000)


def test_packed_keys_round_trip():
    rng = np.random.default_rng(0)
    for keys in (np.zeros(0, np.uint64), np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2)), np.array([0, 5, 2**64 - 1], np.uint64)):
        assert (lm_score._unpack(lm_score._pack(keys)) == keys).all()
