"""FM-index against plain search, contamination against all windows."""

import hashlib
import re

import numpy as np

from causeway.llm import common, decontaminate
from causeway.llm.fm_index import FMIndex, WaveletTree, suffix_array

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(str.maketrans(common.UPPER, common.LOWER)))


def test_index_finds_all_places():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 400):
        text = rng.integers(1, 4, n)
        ended = np.concatenate((text, [0]))
        assert suffix_array(ended).tolist() == sorted(range(n + 1), key=lambda i: ended[i:].tolist())
        index = FMIndex(text, 3)
        for length in (1, 2, 5):
            patterns = rng.integers(1, 4, (20, length))
            for p, low, high in zip(patterns, *index.search(patterns)):
                want = [i for i in range(n - length + 1) if (text[i:i + length] == p).all()]
                assert sorted(index.locate(np.arange(low, high)).tolist()) == want


def test_wavelet_ranks():
    rng = np.random.default_rng(2)
    symbols = rng.integers(0, 37, 300)
    tree = WaveletTree(symbols, 6)
    at, s = rng.integers(0, 301, 200), rng.integers(0, 37, 200)
    assert tree.rank(s, at).tolist() == [int((symbols[:i] == c).sum()) for c, i in zip(s, at)]
    symbol, rank = tree.access(np.arange(300))
    assert symbol.tolist() == symbols.tolist()
    assert rank.tolist() == [int((symbols[:i] == symbols[i]).sum()) for i in range(300)]


def brute(text, items, n=10):
    w = words(text)
    hit, names = set(), set()
    for name, item in items:
        v = words(item)
        for k in range(max(1, len(v) - n + 1) if v else 0):
            window = v[k:k + n]
            for i in range(len(w) - len(window) + 1):
                if w[i:i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    names.add(str(name))
    names = sorted(names)
    return len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


def test_contamination(spark):
    rng = np.random.default_rng(3)
    say = lambda n: " ".join(rng.choice(["a", "b", "C", "d-e", "é"], n))
    items = [(1, say(12)), (2, "b b"), (2, "zz"), (10, say(10)), (11, None), (12, " ,"), (None, "a"), (13, say(30)), (14, say(30))]
    docs = [(k, say(int(n))) for k, n in enumerate(rng.integers(0, 60, 20))] + [
        (50, None), (51, ""), (52, "ZZ"), (52, "ZZ"), (None, f"x {items[7][1]} y {items[0][1]}"), (53, items[7][1] + " " + items[8][1]), (54, "q " * 9000 + items[3][1])]
    df = spark.createDataFrame([(k, t, 5) for k, t in docs], "doc_id long, text string, n_hit int").repartition(3)
    bench = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, doc_id int")
    named = [(k, t) for k, t in items if k is not None]
    want = sorted(((k, *brute(t, named)) for k, t in docs), key=str)
    for options in ({}, {"block_bytes": 40}, {"shard_bytes": 100}):
        got = decontaminate.contamination(df, bench, **options).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=str) == want
    clean = decontaminate.drop_contaminated(df, bench)
    assert clean.columns == df.columns and clean.count() == sum(not w[-1] for w in want)
    none = decontaminate.contamination(df, bench.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.contaminated for r in none)
    assert decontaminate.contamination(df.limit(0), bench).count() == 0
