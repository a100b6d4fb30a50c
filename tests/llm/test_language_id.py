"""Recurrent network: gradients, whole texts, held-out accuracy, edge cases."""

import numpy as np
import pytest

from causeway.llm import gru, language_id


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in gru.init(3, 4, 1).items()}
    data, y = rng.integers(97, 105, (5, 6)).astype(np.uint8), rng.integers(0, 3, 5)
    p32 = {k: v.astype(np.float32) for k, v in p.items()}
    _, grad = gru.gradients({k: v.copy() for k, v in p32.items()}, data, y)
    for k in p32:
        for at in list(np.ndindex(p32[k].shape))[:: max(1, p32[k].size // 12)]:
            losses = []
            for e in (1e-2, -1e-2):
                q = {n: v.copy() for n, v in p32.items()}
                q[k][at] += e
                losses.append(gru.gradients(q, data, y)[0])
            assert grad[k][at] == pytest.approx((losses[0] - losses[1]) / 2e-2, abs=2e-3)


def test_padding_changes_nothing():
    p = gru.init(3, 4, 1)
    data = np.frombuffer(b"some bytes of a text", np.uint8)[None, :]
    padded = np.zeros((1, 64), np.uint8)
    padded[0, :data.shape[1]] = data[0]
    valid = (np.arange(64) < data.shape[1])[None, :].astype(np.float32)
    assert np.allclose(gru.label_probabilities(p, padded, valid)[:data.shape[1]], gru.label_probabilities(p, data, None), atol=1e-5)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    from causeway.llm.common import crc_mod
    from pyspark.sql import functions as F

    return language_id.train(docs.filter(crc_mod(F.col("doc_id"), 4) != 2))


def test_held_out_accuracy(docs, model):
    import zlib

    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    got = {r.doc_id: r for r in language_id.languages(docs, model).collect()}
    held = [k for k in truth if zlib.crc32(str(k).encode()) % 4 == 2]
    assert len(got) == len(truth) and np.mean([got[k].lang_pred == truth[k] for k in held]) > 0.97
    some = got[held[0]]
    assert some.spans[0].start == 0 and all(a.end == b.start for a, b in zip(some.spans, some.spans[1:]))


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "123 --- ..."), (None, "the and of that with"), (4, "der und die ist nicht von dem und auf der"), (4, "der und die ist nicht von dem und auf der"), (5, "the of and " * 30_000)]
    df = spark.createDataFrame([(k, t, "zz") for k, t in rows], "doc_id long, text string, lang_pred string")
    got = sorted(((r.doc_id, r.lang_pred) for r in language_id.languages(df, model, spans=False).collect()), key=str)
    assert got == sorted([(1, "und"), (2, "und"), (3, "und"), (None, "en"), (4, "de"), (4, "de"), (5, "en")], key=str)
    assert language_id.languages(df.limit(0), model).count() == 0
    none = language_id.train(df.limit(0), label="lang_pred")
    assert {r.lang_pred for r in language_id.languages(df, none).collect()} == {"und"}
