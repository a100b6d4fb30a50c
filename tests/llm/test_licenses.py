"""Licence rules against a plain scan in Python."""

import re

import pytest

from causeway.llm import common, licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [
    (1, None), (2, ""), (3, "MIT License"), (3, "MIT License"), (None, "Licensed under CC BY-NC 4.0."),
    (4, "mit\nlicense mit; LICENSE mit x license"), (5, "This work is licensed under the GNU General Public License, version 3."),
    (6, "apache license " * 3000), (7, "cc by cc by cc-by ccby gnu general public licence"), (8, "Gegeben mit Lizenz"),
    (9, "Apache License, Version 2.0 and GNU Lesser General Public License v2.1 or the MIT License"), (10, "SPDX-License-Identifier: 0BSD License"),
    (11, "mit lİcense mit-licenſe"), (12, "in the public domain; copyleft"),
]


def words(text):
    return WORD.findall((text or "").translate(str.maketrans(common.UPPER, common.LOWER)))


def brute(text):
    w = words(text)
    places = [(i, label) for phrase, label in licenses.BASE for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    marked = " " + " ".join(f"{x}:{i}" for i, x in enumerate(w)) + " "
    found = set()
    for label, level, _, pattern in licenses.rules():
        for m in re.finditer(pattern, marked):
            found.add((level, int(m[1]), int(m[2]), label))
    by = {}
    for level, a, b, label in found:
        by[level, a, b] = min(label, by.get((level, a, b), label))
    kept = [(k, a, b, label) for (k, a, b), label in by.items() if k == 0 or not any(
        j and c <= a and d >= b and (j < k or (j == k and (c, d) != (a, b))) for j, c, d in by)]
    at = [i for i, _ in places]
    return (len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})),
            ",".join(sorted({x[3] for x in kept})), len(kept))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("licences") / "documents.parquet")
    spark.createDataFrame([(k, t, 0) for k, t in ODD], "doc_id long, text string, label int").repartition(2).write.parquet(path)
    return spark.read.parquet(path)


def rows(df):
    return sorted(((r.doc_id, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.detections) for r in df.collect()), key=str)


def test_odd_rows(spark, odd):
    fast = [(k, t) for k, t in ODD if k != 6]
    got = rows(licenses.licenses(odd))
    assert [r for r in got if r[0] != 6] == sorted(((k, *brute(t)) for k, t in fast), key=str)
    assert [r for r in got if r[0] == 6][0][:5] == (6, 3000, 0, 5998, "apache")
    assert licenses.licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    df = licenses.licenses(docs)
    want = sorted(((r.doc_id, *brute(r.text)) for r in docs.select("doc_id", "text").collect()), key=str)
    assert rows(df) == want
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in df.collect())


def test_rules_are_many_and_gated():
    found = licenses.rules()
    assert len(found) > 300
    for phrase, _ in licenses.BASE:
        assert re.search(licenses.GATE, phrase)


def test_words_are_counted_in_every_text(odd):
    got = sorted(((r.doc_id, r.n_words) for r in licenses.licenses(odd).collect()), key=str)
    assert got == sorted(((k, len(words(t))) for k, t in ODD), key=str)


def shortest(pattern):
    """The words of a rule's pattern, without optional ones and with the first of alternatives."""
    text = re.sub(r"\(\?:(?:[^()]|\([^()]*\)|\(\([^()]*\)\))* \)\?", "", pattern).replace("(?= )", "")
    text = re.sub(r":\(*\\d\+\)*", "", text)
    text = re.sub(r"\(\?:([^|()]*)[^()]*\)", r"\1", text).replace("[ce]", "c").replace("[cs]", "c").replace("v?", "")
    return text.split()


def test_every_rule_passes_the_gate(spark):
    texts = {" ".join(shortest(pattern)) for _, _, _, pattern in licenses.rules()}
    for label, _, _, pattern in licenses.rules():
        w = shortest(pattern)
        marked = " " + " ".join(f"{x}:{i}" for i, x in enumerate(w)) + " "
        assert re.search(pattern, marked), (label, pattern, w)
    assert [t for t in texts if not re.search(licenses.GATE, t)] == []


def test_names_without_the_word_licence(spark):
    asked = [(1, "Released under the 2-clause BSD."), (2, "CC0 1.0 Universal"), (3, "under the terms of the cc0\n1.0"), (4, "THREE CLAUSE BSD")]
    got = {r.doc_id: r.labels for r in licenses.licenses(spark.createDataFrame(asked, "doc_id long, text string")).collect()}
    assert got == {1: "bsd-2-clause", 2: "cc0-1.0", 3: "cc0-1.0", 4: "bsd-3-clause"}
