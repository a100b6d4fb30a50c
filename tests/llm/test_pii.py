"""Personal data: base spans against the plain patterns, boosted trees, edge cases."""

import hashlib
import re

import numpy as np
import pytest

from causeway.llm import pii
from causeway.llm.boosting import BoostedTrees

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_equal_the_patterns(spark, sf):
    rng = np.random.default_rng(3)
    pieces = list("0123456789.@+- ()ab%_é") + ["1.2.3.4", "4111111111111111", "+1 (555) 010-9999", "a.b@c.de", "@", "256", "..", "--"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces, rng.integers(0, 25)))
        assert pii.base_spans(text) == plain(text), text
    for row in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect():
        assert pii.base_spans(row.text) == plain(row.text)


def test_long_runs_are_linear():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "a@" * 100_000, "+1" * 100_000, "1." * 100_000, "1 " * 100_000):
        pii.base_spans(text)
        pii.proposals(text)


def test_boosted_trees_learn():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    p = BoostedTrees().fit(x[:2000], y[:2000]).probability(x[2000:])
    assert ((p > 0.5) == y[2000:]).mean() > 0.95


@pytest.fixture(scope="module")
def model(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_method_adds_disguised_spans(model):
    lead = "the ander thing of "
    base, more = model.spans(lead + "jo.doe7 [at] mail3 [dot] example [dot] com and so on")
    assert base == [] and [s[0] for s in more] == ["email"]
    assert model.spans("on 2021-03-04 there were 17 of 23 and version 3.11 of it") == ([], [])


def test_query_rows(spark, model):
    rows = [(1, None), (2, ""), (3, "mail a.b@c.de, 10.0.0.1 x"), (3, "mail a.b@c.de, 10.0.0.1 x"), (None, "+49 170 1234567"), (4, "é 4111 1111 1111 1111")]
    df = spark.createDataFrame([(k, t, "s") for k, t in rows], "doc_id long, text string, spans string")
    got = pii.personal_data(df, model).collect()
    assert sorted(((r.doc_id, r.base_sha256) for r in got), key=str) == sorted(
        ((k, hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in plain(t or "")).encode()).hexdigest()) for k, t in rows), key=str)
    for r in got:
        assert "@c.de" not in r.redacted and "4111" not in r.redacted and "170" not in r.redacted
    assert pii.personal_data(df.limit(0), model).count() == 0


def test_many_spans_in_one_text(model):
    text = "a@b.cd 10.0.0.1 x at y dot org " * 200
    base, more = model.spans(text)
    spans = sorted(base + more, key=lambda s: s[1])
    assert base == plain(text)
    assert all(not (a[1] < m[2] and m[1] < a[2]) for m in more for a in base)


def test_gate_passes_what_generators_propose():
    for text in ("write to jane.doe(at)example.org", "mail jane.doe [at] example.org", "jane AT example DOT org", "jane at example dot org",
                 "jane {AT} example {dot} org", "at fe:ed:beef:cafe it"):
        assert pii.proposals(text), text
    rng = np.random.default_rng(12)
    pieces = ["a", "jo", "ab", "example", "org", " ", " ", ".", ":", "::", " at ", " AT ", "(at)", "[ AT ]", "{at}", " dot ", " DOT ", "[dot]", "( DOT )", "-", "+", "@", "7", "fe"]
    odds = np.array([1] * (len(pieces) - 3) + [0.05, 0.05, 1])
    hits = 0
    for _ in range(30_000):
        text = "".join(rng.choice(pieces, rng.integers(1, 14), p=odds / odds.sum()))
        if any(pattern.search(text) for _, pattern in pii.GENERATORS):
            hits += not any(c in "0123456789@" for c in text)
            assert pii.HINT.search(text), text
    assert hits > 500


def test_disguises_of_an_address_are_learned_without_digits(monkeypatch):
    seen = []
    monkeypatch.setattr(pii, "features", lambda text, span, f=pii.features: (seen.append(text[span[1]:span[2]]), f(text, span))[1])
    pii.fit(["please write to jane.doe@example.org and wait for the answer"])
    assert "jane.doe(at)example.org" in seen
