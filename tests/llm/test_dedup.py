"""Exact copies, similar texts and packing against brute force, and the edge cases of every operator."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from causeway.llm import common, exact_dedup, ngram_join, packing

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ODD = [
    (1, None), (2, ""), (3, " \t"), (4, "one two three"), (4, "one two three"), (5, "one  two three\n"), (None, "one two three"),
    (6, "word " * 50_000), (7, "word " * 50_000 + "x"), (None, None), (8, "a b c d e f g h"), (9, "A-b c; d e f g h"), (10, "é ü ñ 漢字 ok"),
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    rows = [(k, t, "x", "y") for k, t in ODD]
    spark.createDataFrame(rows, "doc_id long, text string, _row string, _doc string").repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, n_links long")


def grams(text, n=5):
    w = WORD.findall((text or "").translate(str.maketrans(common.UPPER, common.LOWER)))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_links(texts, threshold=0.8):
    sets = [grams(t) for t in texts]
    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    links = {i: set() for i in range(len(sets))}
    for i, s in enumerate(sets):
        shared = {}
        for g in s:
            for j in where[g]:
                shared[j] = shared.get(j, 0) + 1
        for j, k in shared.items():
            if j != i and k >= threshold * (len(s) + len(sets[j]) - k) - 1e-9:
                links[i].add(j)
    return links


def classes(ids, links):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, other in links.items():
        for j in other:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    low = {}
    for i, k in enumerate(ids):
        low.setdefault(find(i), []).append(k)
    return [min(low[find(i)], key=lambda k: (k is None, k or 0)) for i in range(len(ids))]


def test_similar_groups_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    links = brute_links([r.text for r in rows])
    want = {r.doc_id: (c, len(links[i])) for i, (r, c) in enumerate(zip(rows, classes([r.doc_id for r in rows], links)))}
    for block_bytes in (1_500_000, 20_000):  # one block, and many
        got = ngram_join.similar_groups(docs, block_bytes=block_bytes).collect()
        assert {r.doc_id: (r.class_id, r.n_links) for r in got} == want
    kept = ngram_join.drop_similar(docs)
    assert kept.columns == docs.columns and kept.count() == len({c for c, _ in want.values()})


def test_similar_groups_odd_rows(spark, odd, empty):
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in ngram_join.similar_groups(odd).collect()), key=str)
    links = brute_links([t for _, t in ODD])
    want = sorted(((k, c, len(links[i])) for i, ((k, _), c) in enumerate(zip(ODD, classes([k for k, _ in ODD], links)))), key=str)
    assert got == want
    assert ngram_join.similar_groups(empty).count() == 0
    assert ngram_join.drop_similar(odd).columns == odd.columns


def test_bands_reach_the_recall():
    bands, rows = ngram_join.bands_for(0.8, 0.999)
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.999


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 30)] + [(40, 41), (42, 40), (50, 50)]
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 41: 40, 42: 40}


def bare(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def brute_exact(rows):
    groups = {}
    for k, t in rows:
        groups.setdefault(bare(t), []).append((-len(t or ""), k is None, k or 0, k))
    out = []
    for k, t in rows:
        g = groups[bare(t)]
        out.append((k, min(g)[3], len(g), hashlib.sha256(bare(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_groups(spark, odd, empty, sf):
    for bits in (1 << 26, 1 << 16):
        got = exact_dedup.exact_groups(odd, max_filter_bits=bits).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute_exact(ODD)
        per_text = {}
        for r in got:
            per_text[r.text_sha256] = per_text.get(r.text_sha256, 0) + r.kept
        assert set(per_text.values()) == {1}
    assert exact_dedup.exact_groups(empty).count() == 0
    left = exact_dedup.drop_copies(odd)
    assert left.columns == odd.columns and left.count() == len({bare(t) for _, t in ODD})


def test_filter_flags_every_repeat(spark):
    values = list(range(3000)) + [7, 9, 2999]
    df = spark.createDataFrame([(v * 7919 * 10**9,) for v in values], "h long").repartition(4)
    bits = exact_dedup.repeat_filter(df, 1 << 16)
    flagged = {r.h // (7919 * 10**9) for r in exact_dedup.mark_possible(df, "h", bits, "f").filter("f").collect()}
    assert {7, 9, 2999} <= flagged and len(flagged) < 300


def test_tournament_is_first_fit_decreasing():
    rng = np.random.default_rng(1)
    for _ in range(20):
        sizes = rng.integers(1, 101, rng.integers(0, 60))
        bins, offsets = packing.tournament(sizes, 100)
        room, want = [], {}
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            b = next((b for b, r in enumerate(room) if r >= sizes[i]), len(room))
            if b == len(room):
                room.append(100)
            want[i] = (b, 100 - room[b])
            room[b] -= sizes[i]
        assert [(int(b), int(o)) for b, o in zip(bins, offsets)] == [want[i] for i in range(len(sizes))]


def check_packing(rows, docs, path):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    want = {}
    for k, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want.setdefault(k, []).append(np.array(ids, "<u4").tobytes())
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        data = [d for d in want[r.doc_id] if len(d) == 4 * r.doc_tokens
                and zlib.crc32(d[4 * r.start:4 * (r.start + r.length)]) == r.ids_crc32]
        assert data and r.length > 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in rows) == sum(len(d) // 4 for ds in want.values() for d in ds)
    return sequences


def test_packing(spark, sf, odd, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = packing.pack(docs, path).collect()
    sequences = check_packing(rows, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], path)
    total = sum(r.length for r in rows)
    assert len(sequences) <= 1.02 * total / 2048 + 1
    check_packing(packing.pack(odd, path).collect(), ODD, path)
    assert packing.pack(empty, path).count() == 0


def test_word_tokenizer_equals_whole_texts():
    path = public_tokenizers.path("word_bpe_49k.json")
    own = packing.WordTokenizer(path)
    texts = ["a'S b's, <|endoftext|>x <|ENDOFTEXT|> É… é, ñ, café's. It's!! X.Y.Z... a1,2 ‘q’, ﬁ, Ä, ", None, "", "İ. K. 3.. Σας,\x85z",
             "don't, stop... (now)! 3.14, 5% #7;", "tab\tx,\ny.\x0b\x0cz"]
    for text, ids in zip(texts, own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == own.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_word_tokenizer_over_many_batches(monkeypatch):
    """The same ids whether words are new, met before, or forgotten as the table is full."""
    path = public_tokenizers.path("word_bpe_49k.json")
    batches = [[f"word{i}, w{i}x! “q{i}” word{i - 7}... {i}", None, "", " \t ", f"{i} " * 300] for i in range(40)]
    for bound in (packing.TABLE_BYTES, 2_000, 0):
        monkeypatch.setattr(packing, "TABLE_BYTES", bound)
        own = packing.WordTokenizer(path)
        for batch in batches:
            want = [own.tokenizer.encode(t or "", add_special_tokens=False).ids for t in batch]
            assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(batch)] == want
            assert (own.hashes[1:] > own.hashes[:-1]).all()
