"""String kernel against its definition, held-out quality, obfuscation and edge cases."""

import itertools
import zlib

import numpy as np
import pytest

from causeway.llm import toxicity


def test_kernel_by_definition():
    rng = np.random.default_rng(0)
    words = [bytes([1, *rng.integers(2, 6, rng.integers(1, 7)).tolist()]) for _ in range(12)]

    def features(w):
        c, out = [*w, 0], {}
        for start in range(len(w)):
            for offsets in toxicity.OFFSETS:
                if start + offsets[-1] < len(c):
                    key = tuple(c[start + o] for o in (0, *offsets))
                    out[key] = out.get(key, 0) + toxicity._strength(offsets)
        norm = toxicity._norm(np.array([len(c)]))[0]
        return {k: v / norm for k, v in out.items()}

    got = toxicity.Landmarks(words).kernel(words)
    for i, j in itertools.product(range(len(words)), repeat=2):
        a, b = features(words[i]), features(words[j])
        assert got[i, j] == pytest.approx(sum(v * b.get(k, 0) for k, v in a.items()), rel=1e-4)


def test_inserted_characters_are_joined():
    one = toxicity.classes_of(["an idiot here"])[0].tolist()
    for text in ("an i-d-i-o-t here", "an i d i o t here", "AN I*D*I*O*T HERE"):
        assert toxicity.classes_of([text])[0].tolist() == one
    kinds, bounds = toxicity.classes_of(["a b", None, "", "c d e", "x"])
    assert len(bounds) == 6 and (kinds[bounds[1:] - 1] == 0).all()


@pytest.fixture(scope="module")
def trained(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    return docs, labels, toxicity.train(docs, labels)


def test_held_out_quality(trained):
    docs, labels, model = trained
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "toxic").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    score, y = model.scores([r.text for r in held]), np.array([r.toxic for r in held])
    found = score >= 0.5
    assert (found & (y == 1)).sum() >= 0.85 * (y == 1).sum()
    assert (found & (y == 0)).sum() <= 0.02 * (y == 0).sum()


def test_gapped_words_score_higher(trained):
    model = trained[2]
    for word, gapped in (("worthless", "worth-less"), ("stupid", "stuupid"), ("moron", "mor.on"), ("pathetic", "patthetic")):
        plain, odd, clean = (toxicity.word_margins(toxicity.classes_of([w])[0], model.weights, model.bias)[0].max() for w in (word, gapped, "within"))
        assert plain > 0.5 and odd > 0.35 > clean


def test_odd_rows(spark, trained):
    model = trained[2]
    rows = [(1, None), (2, ""), (3, "..."), (None, "the and"), (4, "you idiot worthless scum"), (4, "you idiot worthless scum"), (5, "the of " * 60_000), (6, "x" * 200_000)]
    df = spark.createDataFrame([(k, t, 0.0) for k, t in rows], "doc_id long, text string, score double")
    got = toxicity.toxicity(df, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    left = toxicity.drop_toxic(df, model)
    assert left.columns == df.columns and left.count() == sum(r.score < 0.5 for r in got)
    assert toxicity.toxicity(df.limit(0), model).count() == 0
    none = toxicity.train(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.toxicity(df, none).collect()] == pytest.approx([0.001] * len(rows), rel=0.01)
