"""Phrase index against plain counting; collocations against a dictionary version."""

import re
from collections import Counter

import numpy as np
import pytest
from plain import lowered

from causeway.llm import collocations as C
from causeway.llm.phrase_index import BothWays, suffix_order


def test_suffix_order():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 60, 300):
        text = rng.integers(0, 4, n)
        for depth in (1, 2, 3, 5, 8):
            ended = np.concatenate((text, np.zeros(depth, int)))
            assert suffix_order(text, depth).tolist() == sorted(range(n), key=lambda i: ended[i:i + depth].tolist())


def grams(pieces, k):
    return Counter(tuple(p[i:i + k]) for p in pieces for i in range(len(p) - k + 1))


def test_extension_both_ways():
    rng = np.random.default_rng(2)
    pieces = [rng.integers(1, 5, rng.integers(1, 12)).tolist() for _ in range(40)]
    text = np.array([x for p in pieces for x in (*p, 0)])
    index = BothWays.of(text, 5)
    found, names = index.symbols_once(), [(k + 1,) for k in range(int(text.max()))]
    for k in range(2, 6):
        parent, symbol, left = index.left(found)
        a = {(s, *names[p]): n for p, s, n in zip(parent.tolist(), symbol.tolist(), left.size.tolist())}
        parent_r, symbol_r, right = index.right(found)
        b = {(*names[p], s): n for p, s, n in zip(parent_r.tolist(), symbol_r.tolist(), right.size.tolist())}
        assert a == b == grams(pieces, k)
        # go on with either side: both keep the two intervals in step
        if k % 2:
            names, found = [(s, *names[p]) for p, s in zip(parent.tolist(), symbol.tolist())], left
        else:
            names, found = [(*names[p], s) for p, s in zip(parent_r.tolist(), symbol_r.tolist())], right


def test_longer_phrases():
    rng = np.random.default_rng(3)
    pieces = [rng.integers(1, 6, rng.integers(1, 15)).tolist() for _ in range(60)]
    text = np.array([x for p in pieces for x in (*p, 0)])
    index = BothWays.of(text, 5)
    second, first, pairs = index.left(index.symbols_once())
    at = np.sort(rng.choice(len(first), len(first) // 2, replace=False))
    kept = {(int(first[i]), int(second[i]) + 1): int(i) for i in at}
    for k, (chains, n) in enumerate(C.longer_phrases(index, at, 5), 3):
        got = {tuple(at[c].tolist()): m for c, m in zip(chains, n.tolist())}
        want = {}
        for g, m in grams(pieces, k).items():
            chain = tuple(kept.get(pair, -1) for pair in zip(g, g[1:]))
            if -1 not in chain:
                want[chain] = m
        assert got == want


def brute(docs, min_count, top, max_words=5):
    pieces = {}
    for text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            pieces.setdefault(lang if lang is not None else "und", []).append(re.findall(r"[^\x20\x09]+", piece))
    out = {}
    for lang, own in pieces.items():
        n = sum(map(len, own))
        f = Counter()
        for k in range(1, max_words + 1):
            f += grams(own, k)
        chosen = {g: a for g, a in f.items() if len(g) > 1 and a >= min_count}
        gone = {g[i:j] for g, a in chosen.items() for i in range(len(g)) for j in range(i + 2, len(g) + 1)
                if j - i < len(g) and a >= f[g[i:j]]}
        rows = []
        for g, a in chosen.items():
            if g not in gone:
                s, _, left, right = min((1000 * a * n // (f[g[:k]] * f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
                rows.append((" ".join(g), a, left, right, n, s))
        rows.sort(key=lambda r: (-r[5], -r[1], r[0].encode()))
        out |= {(lang, k): r for k, r in enumerate(rows[:top], 1)}
    return out


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(4)
    words = ["a", "B", "c'd", "é", "x-1", "zz"]
    say = lambda n: "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ", ", ".", "\n", " \x0b"], p=[.6, .1, .1, .05, .05, .05, .05]) for _ in range(n))
    rows = [(say(int(n)), rng.choice(["en", "de", "fr"], p=[.7, .2, .1]).item()) for n in rng.integers(0, 40, 120)]
    return rows + [(None, "en"), ("", "en"), (" . ,", None), ("one two three " * 400, None), ("a b", "und"), *[("same text again here", "de")] * 30]


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 300}, {"min_count": 40, "top": 3}])
def test_collocations(spark, docs, options):
    df = spark.createDataFrame([(t, g, "x", 1) for t, g in docs], "text string, lang string, phrase string, n int").repartition(4)
    options = {"min_count": 8, "top": 50} | options
    got = {(r.lang, r["rank"]): (r.phrase, r.a, r.l, r.r, r.n, r.score) for r in C.collocations(df, **options).collect()}
    assert got == brute(docs, options["min_count"], options["top"])


def test_two_words_only(spark, docs):
    df = spark.createDataFrame(docs, "text string, lang string")
    got = {(r.lang, r["rank"]): r.phrase for r in C.collocations(df, min_count=8, top=9, max_words=2).collect()}
    assert got == {k: r[0] for k, r in brute(docs, 8, 9, 2).items()}


def test_products_beyond_64_bits(spark):
    row = [([1], "en", 9 * 10**12, "a b", 2, 8 * 10**12, [8 * 10**12], [8 * 10**12])]
    df = spark.createDataFrame(row, "chain array<long>, lang string, n long, phrase string, words int, f long, firsts array<long>, rests array<long>")
    got = C.scored(C.maximal(df), 10).collect()
    assert [r.score for r in got] == [1000 * 8 * 10**12 * 9 * 10**12 // (8 * 10**12) ** 2]


def test_nothing(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert C.collocations(df).collect() == []
    df = spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")
    assert C.collocations(df, min_count=1).collect() == []


def test_pairs_travel_by_part_and_not_by_row():
    """However many pairs a shard has, it sends one row per part; keys are one to one and fall into all parts."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    ids = rng.integers(0, 400, 20_000).astype(np.int32)
    words = pa.table({"local": [C.steps(np.arange(1, 400))], "numbers": [C.packed(np.arange(399) * (np.arange(399) % 7 > 0))]})
    shard = pa.table({"shard": [5], "ids": [C.packed(ids)]})
    out = C._index(5, 8, 399)(shard, words).to_pylist()
    assert [r["part"] for r in out] == [None, *range(8)]
    keys, counts = (np.concatenate(x) for x in zip(*((C.from_steps(r["keys"]), C.unpacked(r["counts"], np.int32)) for r in out[1:])))
    known = np.where(np.arange(400) % 7 == 1, 0, np.arange(400))  # words whose number is 0 are breaks
    want = Counter((int(known[a]) - 2, int(known[b]) - 2) for a, b in zip(ids, ids[1:]) if known[a] and known[b])
    assert dict(zip(zip(*(w.tolist() for w in C.words_of_pairs(keys, 399))), counts.tolist())) == want
    sizes = [len(C.from_steps(r["keys"])) for r in out[1:]]
    assert max(sizes) < 2 * min(sizes)


def test_numbers_survive_packing():
    rng = np.random.default_rng(6)
    for kind in (np.int32, np.int64):
        for n in (0, 1, 1000):
            values = rng.integers(0, 2**30, n).astype(kind)
            assert C.unpacked(C.packed(values), kind).tolist() == values.tolist()
    rising = np.sort(rng.integers(0, 2**60, 500))
    assert C.from_steps(C.steps(rising)).tolist() == rising.tolist()


def test_blocks_of_a_shard_send_a_pair_once():
    """What several blocks of a shard hold is summed before it travels."""
    import pyarrow as pa

    rng = np.random.default_rng(7)
    blocks = [rng.integers(0, 40, 3000).astype(np.int32) for _ in range(3)]
    words = pa.table({"local": [C.steps(np.arange(1, 40))], "numbers": [C.packed(np.arange(1, 40))]})
    shard = pa.table({"shard": [5] * 3, "ids": [C.packed(b) for b in blocks]})
    built = C._index(4, 2, 39)(shard, words)
    rows = built.to_pylist()
    assert [r["text"] is not None for r in rows] == [True] * 3 + [False] * 2
    sent = [(k, n) for r in rows[3:] for k, n in zip(C.from_steps(r["keys"]).tolist(), C.unpacked(r["counts"], np.int32).tolist())]
    pieces = [[x for x in p if x] for b in blocks for p in np.split(b, np.flatnonzero(b == 0))]
    want = grams(pieces, 2)
    assert len(sent) == len(want)
    w1, w2 = C.words_of_pairs(np.array([k for k, _ in sent]), 39)
    assert {(a + 1, b + 1): n for a, b, (_, n) in zip(w1.tolist(), w2.tolist(), sent)} == want
    frequent = pa.table({"keys": [C.steps(np.sort([k for k, _ in sent]))]})
    texts = built.slice(0, 3).select(["shard", "text", "numbers"])
    out = C._longer(4, 2, 39)(texts, frequent).to_pylist()
    assert len(out) == 2 * 2
    for k in (3, 4):
        got = Counter()
        for r in out:
            if r["words"] == k:
                chains, n = C.unpacked(r["chains"], np.int32).reshape(k, -1), C.unpacked(r["counts"], np.int32).tolist()
                assert not got.keys() & set(map(tuple, (chains.T + 1).tolist()))
                got.update(dict(zip(map(tuple, (chains.T + 1).tolist()), n)))
        assert got == grams(pieces, k)


def test_words_are_numbered_over_blocks():
    spelling = C.Spelling()
    ids = [spelling.numbers(["A b. a"], ["en"]), spelling.numbers([None, "b c", "a"], ["en", "en", "de"])]
    assert [i.tolist() for i in ids] == [[1, 2, 0, 1, 0], [0, 2, 3, 0, 4, 0]]
    langs, lang_of, words = spelling.words()
    assert (langs, lang_of.tolist(), words) == (["en", "de"], [0, 0, 0, 1], [b"a", b"b", b"c", b"a"])
