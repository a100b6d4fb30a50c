"""Phrase collocations from FM-indexes over word numbers, one per shard of documents.

1. Every shard numbers its words per language. They are dealt by hash to parts, in one row for each
   shard and part; a part sums the counts and sends each shard the numbers of its frequent words. Words
   below the least count can be in no candidate, so they become breaks.
2. Every shard indexes what is left, block by block, in both directions and extends all words to the left
   by one: its word pairs with counts. They are summed in the shard, go to parts and back in the same way.
3. The index is built anew, since it is larger than the text. Intervals of a shard's frequent pairs are
   extended by turns to the left and to the right up to ``max_words``. An extension is kept if the pair
   it adds is frequent; that pair is the one whose interval holds the new one. Phrases go to parts and
   are summed there by their words' numbers, so sums over shards need no texts; the frequent ones are
   named by their pairs.
4. Counts of all first and last parts come from joins of each length with the one below.

Between the steps only distinct words or phrases per shard are shuffled, with their counts, and each
shard's numbers. A shard holds up to ``BLOCKS`` blocks of about ``shard_bytes`` of text, and what occurs in
several of them travels once. A part has as many words or pairs as two shards and a half on average; no
step brings a language, a word or a phrase into one task.

NULL texts are empty, a NULL language is ``und``, repeated rows count each, an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import LOWER, UPPER, mix, query, read, slices, top_rows
from causeway.llm.phrase_index import BothWays, Intervals, holder
from causeway.session import broadcast_if_small, durable

# UTF-8 bytes: A-Z become a-z, a tab a blank, and all that ends a piece a full stop (no word holds one)
BREAK = b"."
PIECE_BYTES = bytes.maketrans(
    (UPPER + ".,;:!?\n\x0b\x0c\r\t").encode(), (LOWER + "." * 10 + " ").encode())
SHARDS = "shard long, langs array<string>, lang_of binary, words binary, counts binary, ids binary"
SHARD = pa.schema([("shard", pa.int64()), ("langs", pa.list_(pa.string())), *((c, pa.binary()) for c in ("lang_of", "words", "counts", "ids"))])
LISTED = pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("langs", pa.list_(pa.string())),
                    *((c, pa.binary()) for c in ("lang_of", "words", "counts", "local"))])
LISTED_ROWS = "part int, shard long, langs array<string>, lang_of binary, words binary, counts binary, local binary"
# of a part: the words of each language, its frequent words, and for each shard the numbers of those it has
NUMBERED = pa.schema([("kind", pa.string()), ("lang", pa.string()), ("word", pa.string()), ("f", pa.int64()), ("word_id", pa.int64()),
                      ("of", pa.int64()), ("local", pa.binary()), ("numbers", pa.binary())])
NUMBERED_ROWS = "kind string, lang string, word string, f long, word_id long, of long, local binary, numbers binary"
INDEXES = pa.schema([("shard", pa.int64()), ("part", pa.int32()), *((c, pa.binary()) for c in ("keys", "counts", "text", "numbers"))])
INDEX_ROWS = "shard long, part int, keys binary, counts binary, text binary, numbers binary"
FREQUENT = pa.schema([("pair", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64()), ("f", pa.int64()), ("shard", pa.int64()), ("keys", pa.binary())])
FREQUENT_ROWS = "pair long, w1 long, w2 long, f long, shard long, keys binary"
CHAINS = pa.schema([("part", pa.int32()), ("words", pa.int32()), ("chains", pa.binary()), ("counts", pa.binary())])
CHAIN_ROWS = "part int, words int, chains binary, counts binary"
BLOCKS, PARTS_PER_SHARD = 4, 0.4
ODD = 0x9E3779B97F4A7C15
INVERSE = pow(ODD, -1, 1 << 64)


def squeezed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def expanded(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def packed(values: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second bytes, ..., compressed: the high ones are nearly all 0."""
    return squeezed(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes())


def unpacked(data: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(expanded(data), np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def steps(values: np.ndarray) -> bytes:
    """Rising numbers by their differences."""
    return packed(np.diff(values.astype(np.int64), prepend=0))


def from_steps(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, np.int64))


def stacked(schema: pa.Schema, *tables: dict) -> pa.Table:
    """Columns of several tables below each other, NULL where one has no such column."""
    def columns(table: dict) -> list:
        n = len(next(iter(table.values())))
        return [pa.array(table[f.name], f.type) if f.name in table else pa.nulls(n, f.type) for f in schema]

    return pa.concat_tables([pa.Table.from_arrays(columns(t), schema=schema) for t in tables])


class Numbers(dict):
    """Numbers words in the order of their first look-up, counting on over all languages of a shard."""

    def __init__(self, count: list[int]) -> None:
        super().__init__({BREAK: 0})
        self.count = count

    def __missing__(self, word: bytes) -> int:
        self.count[0] += 1
        self[word] = self.count[0]
        return self.count[0]


class Spelling:
    """Numbers the words 1, 2, ... of several blocks of texts, 0 between pieces."""

    def __init__(self) -> None:
        self.count = [0]
        self.tables: dict[str, Numbers] = defaultdict(lambda: Numbers(self.count))

    def numbers(self, texts: list[str | None], langs: list[str]) -> np.ndarray:
        parts = []
        for text, lang in zip(texts, langs):
            words = (text or "").encode().translate(PIECE_BYTES).replace(BREAK, b" . ").split()
            words.append(BREAK)
            parts.append(np.fromiter(map(self.tables[lang].__getitem__, words), np.int32, len(words)))
        return np.concatenate(parts or [np.zeros(0, np.int32)])

    def words(self) -> tuple[list[str], np.ndarray, list[bytes]]:
        """Languages; language (its place there) and spelling of the words."""
        lang_of, names = np.zeros(self.count[0] + 1, np.int32), [b""] * (self.count[0] + 1)
        for k, table in enumerate(self.tables.values()):
            for word, number in table.items():
                lang_of[number], names[number] = k, word
        return list(self.tables), lang_of[1:], names[1:]


def _shards(shard_bytes: int):
    """Per shard: a row for each block with the numbers of its words, and a last one with the words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = TaskContext.get().partitionId() << 32, 0
        spelling, counts = Spelling(), np.zeros(0, np.int64)

        def ended() -> pa.RecordBatch:
            langs, lang_of, words = spelling.words()
            blobs = {"lang_of": packed(lang_of), "words": squeezed(BREAK.join(words)), "counts": packed(counts[1:])}
            return pa.RecordBatch.from_pylist([{"shard": shard, "langs": langs, **blobs}], SHARD)

        for part in slices(batches, "text", shard_bytes):
            size = pa.compute.sum(pa.compute.binary_length(part.column("text"))).as_py() or 0
            if held and held + size > BLOCKS * shard_bytes:
                yield ended()
                shard, held, spelling, counts = shard + 1, 0, Spelling(), np.zeros(0, np.int64)
            ids = spelling.numbers(part.column("text").to_pylist(), part.column("lang").to_pylist())
            own = np.bincount(ids, minlength=spelling.count[0] + 1)
            own[:len(counts)] += counts
            counts, held = own, held + max(1, size)
            yield pa.RecordBatch.from_pylist([{"shard": shard, "ids": packed(ids)}], SHARD)
        if held:
            yield ended()

    return run


def _listed(parts: int):
    """The distinct words of each shard, one row for each part that has any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (row,) = batch.slice(k, 1).to_pylist()
                counts, lang_of = unpacked(row["counts"], np.int64), unpacked(row["lang_of"], np.int32)
                words = expanded(row["words"]).split(BREAK) if len(counts) else []
                names = np.array([crc32(g.encode()) for g in row["langs"]], np.uint64)
                part = mix(np.fromiter(map(crc32, words), np.uint64, len(words)) << np.uint64(32) | names[lang_of]) % np.uint64(parts)
                order = np.argsort(part, kind="stable")
                bounds = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
                out = []
                for p in np.flatnonzero(np.diff(bounds)).tolist():
                    own = order[bounds[p]:bounds[p + 1]]
                    langs, lang = np.unique(lang_of[own], return_inverse=True)
                    out.append({"part": p, "shard": row["shard"], "langs": [row["langs"][g] for g in langs.tolist()],
                                "lang_of": packed(lang.astype(np.int32)), "words": squeezed(BREAK.join([words[i] for i in own.tolist()])),
                                "counts": packed(counts[own]), "local": steps(own + 1)})
                yield pa.RecordBatch.from_pylist(out, LISTED)

    return run


def _numbered(min_count: int, parts: int):
    """Per part: sums of all words, numbers of the frequent ones, and for each shard the numbers of its words."""
    def run(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        langs = sorted({g for r in rows for g in r["langs"]})
        at = {g: i for i, g in enumerate(langs)}
        words = [expanded(r["words"]).split(BREAK) for r in rows]
        coded = pa.array([w for own in words for w in own], pa.binary()).dictionary_encode()
        lang = np.concatenate([np.array([at[g] for g in r["langs"]], np.int64)[unpacked(r["lang_of"], np.int32)] for r in rows])
        counts = np.concatenate([unpacked(r["counts"], np.int64) for r in rows])
        keys, place = np.unique(coded.indices.to_numpy() * np.int64(len(langs)) + lang, return_inverse=True)
        f, n = np.zeros(len(keys), np.int64), np.zeros(len(langs), np.int64)
        np.add.at(f, place, counts)
        np.add.at(n, lang, counts)
        often = np.flatnonzero(f >= min_count)
        number = np.zeros(len(keys), np.int64)
        number[often] = np.arange(len(often)) * parts + rows[0]["part"] + 1
        sent = [(r["shard"], r["local"], packed(own)) for r, own in zip(rows, np.split(number[place], np.cumsum([len(w) for w in words])[:-1]))]
        of, local, numbers = zip(*sent)
        return stacked(
            NUMBERED, {"kind": ["lang"] * len(langs), "lang": langs, "f": n},
            {"kind": ["word"] * len(often), "lang": [langs[k] for k in (keys[often] % len(langs)).tolist()],
             "word": coded.dictionary.take(pa.array(keys[often] // len(langs))).cast(pa.string()), "f": f[often], "word_id": number[often] - 1},
            {"kind": ["shard"] * len(of), "of": of, "local": local, "numbers": numbers})

    return run


def without_breaks_in_a_row(text: np.ndarray) -> np.ndarray:
    """``text`` with one 0 where several follow each other, none at the start and one at the end."""
    text = np.concatenate((text, [0]))
    keep = (text > 0) | (np.concatenate(([0], text[:-1])) > 0)
    return text[keep]


def _index(depth: int, parts: int, vocabulary: int):
    """Per shard: a row for each block, the first with the frequent words; then its word pairs, one row for each part that has any."""
    def run(shard: pa.Table, words: pa.Table) -> pa.Table:
        rows = []
        if shard.num_rows and words.num_rows:
            name = shard["shard"][0].as_py()
            local = np.concatenate([from_steps(b) for b in words["local"].to_pylist()])
            numbers = np.concatenate([unpacked(b, np.int64) for b in words["numbers"].to_pylist()])
            new = np.zeros(int(local.max(initial=0)) + 1, np.int32)
            order = np.argsort(numbers)[np.count_nonzero(numbers == 0):]
            local, numbers = local[order], numbers[order] - 1
            new[local] = np.arange(1, len(local) + 1)
            found_keys, found_counts = [], []
            for blob in shard["ids"].to_pylist():
                text = without_breaks_in_a_row(new[unpacked(blob, np.int32)])
                rows.append({"shard": name, "text": packed(text.astype(np.int32)), "numbers": None if rows else steps(numbers)})
                index = BothWays.of(text, depth)
                second, first, found = index.left(index.symbols_once())
                found_keys.append(pair_keys(numbers[first - 1], numbers[second], vocabulary))
                found_counts.append(found.size)
            keys = np.concatenate(found_keys)
            order = np.argsort(keys)
            keys, counts = keys[order], np.concatenate(found_counts)[order]
            edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))[:len(keys)])
            keys, counts = keys[edge], (np.add.reduceat(counts, edge) if len(edge) else counts).astype(np.int32)
            edges = np.searchsorted(part_of(keys, parts, vocabulary), np.arange(parts + 1))
            rows += [{"shard": name, "part": p, "keys": steps(keys[edges[p]:edges[p + 1]]), "counts": packed(counts[edges[p]:edges[p + 1]])}
                     for p in np.flatnonzero(np.diff(edges)).tolist()]
        return pa.Table.from_pylist(rows, INDEXES)

    return run


def key_bits(vocabulary: int) -> int:
    bits = (vocabulary ** 2).bit_length()
    if bits > 62:
        raise ValueError("too many frequent words")
    return bits


def pair_keys(first: np.ndarray, second: np.ndarray, vocabulary: int) -> np.ndarray:
    """One number for each two words, spread evenly over ``key_bits`` bits."""
    with np.errstate(over="ignore"):
        spread = (first * vocabulary + second).astype(np.uint64) * np.uint64(ODD)
    return (spread & np.uint64((1 << key_bits(vocabulary)) - 1)).astype(np.int64)


def words_of_pairs(keys: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        both = keys.astype(np.uint64) * np.uint64(INVERSE)
    return np.divmod((both & np.uint64((1 << key_bits(vocabulary)) - 1)).astype(np.int64), vocabulary)


def part_of(keys: np.ndarray, parts: int, vocabulary: int) -> np.ndarray:
    """Equal ranges of keys, numbered from 0; at most 2**31."""
    cut = max(0, key_bits(vocabulary) - 31)
    return (keys >> cut) * parts >> (key_bits(vocabulary) - cut)


def _frequent(min_count: int, vocabulary: int):
    """Per part: a row for each frequent pair, then for each shard one with those it has."""
    def run(group: pa.Table) -> pa.Table:
        own = [from_steps(b) for b in group["keys"].to_pylist()]
        keys = np.concatenate(own)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        counts = np.concatenate([unpacked(b, np.int32) for b in group["counts"].to_pylist()])[order]
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        total = np.add.reduceat(counts, edge, dtype=np.int64)
        keys, total = keys[edge][total >= min_count], total[total >= min_count]
        back = [(s, k[np.isin(k, keys, assume_unique=True)]) for s, k in zip(group["shard"].to_pylist(), own)]
        back = [(s, k) for s, k in back if len(k)]
        w1, w2 = words_of_pairs(keys, vocabulary)
        return stacked(FREQUENT, {"pair": keys, "w1": w1, "w2": w2, "f": total},
                       {"shard": [s for s, _ in back], "keys": [steps(k) for _, k in back]})

    return run


def longer_phrases(index: BothWays, at: np.ndarray, max_words: int, pairs: Intervals | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length from 3: chains of pair places in ``at`` and the count of each phrase.

    ``at`` lists the pairs to use among all extensions of single words to the left (``pairs``, if known).
    """
    pairs = (pairs or index.left(index.symbols_once())[2]).take(at)
    by_low, by_back = np.argsort(pairs.low), np.argsort(pairs.back)
    found: Intervals = pairs
    chains = np.arange(len(at))[:, None]
    for length in range(3, max_words + 1):
        to_left = length % 2 == 1
        parent, _, found = (index.left if to_left else index.right)(found)
        by, starts, places = (by_low, pairs.low, found.low) if to_left else (by_back, pairs.back, found.back)
        pair = holder(starts[by], pairs.size[by], places)
        keep = np.flatnonzero(pair >= 0)
        found, added, chains = found.take(keep), by[pair[keep]][:, None], chains[parent[keep]]
        chains = np.concatenate((added, chains) if to_left else (chains, added), axis=1)
        yield chains, found.size


def sums(words: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct columns of ``words``, sorted, and the sum of ``n`` over each."""
    order = np.lexsort(words[::-1])
    words = words[:, order]
    edge = np.flatnonzero(np.concatenate(([True], (words[:, 1:] != words[:, :-1]).any(axis=0)))[:len(n)])
    return words[:, edge], np.add.reduceat(n[order], edge, dtype=np.int64) if len(edge) else np.zeros(0, np.int64)


def _longer(max_words: int, parts: int, vocabulary: int):
    """Per shard: its longer phrases as words, sorted, one row for each length and part that has any."""
    def run(shard: pa.Table, frequent: pa.Table) -> pa.Table:
        rows = []
        if shard.num_rows and frequent.num_rows:
            numbers = np.concatenate([from_steps(b) for b in shard["numbers"].to_pylist() if b is not None])
            wanted = np.concatenate([from_steps(b) for b in frequent["keys"].to_pylist()])
            found = defaultdict(list)
            for blob in shard["text"].to_pylist():
                index = BothWays.of(unpacked(blob, np.int32), max_words)
                second, first, pairs = index.left(index.symbols_once())
                w1, w2 = numbers[first - 1], numbers[second]
                at = np.flatnonzero(np.isin(pair_keys(w1, w2, vocabulary), wanted))
                w1, w2 = w1[at].astype(np.int32), w2[at].astype(np.int32)
                for chain, n in longer_phrases(index, at, max_words, pairs):
                    found[chain.shape[1] + 1].append((np.array([w1[chain[:, 0]], *w2[chain.T]]), n))
            for length, own in found.items():
                words, n = sums(np.concatenate([w for w, _ in own], axis=1), np.concatenate([n for _, n in own]))
                part = np.zeros(len(n), np.uint64)
                for w in words:
                    part = mix(part ^ w.astype(np.uint64))
                part = (part % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                words, n = words[:, order], n[order]
                edges = np.searchsorted(part[order], np.arange(parts + 1))
                rows += [{"part": p, "words": length, "chains": packed(words[:, edges[p]:edges[p + 1]].ravel()),
                          "counts": packed(n[edges[p]:edges[p + 1]].astype(np.int32))} for p in np.flatnonzero(np.diff(edges)).tolist()]
        return pa.Table.from_pylist(rows, CHAINS)

    return run


def _summed(min_count: int, vocabulary: int):
    """Per part: its frequent phrases by their pairs."""
    def run(group: pa.Table) -> pa.Table:
        chains, counts = [pa.array([], pa.list_(pa.int64()))], [np.zeros(0, np.int64)]
        by_length = defaultdict(list)
        for row in group.to_pylist():
            by_length[row["words"]].append((unpacked(row["chains"], np.int32).reshape(row["words"], -1), unpacked(row["counts"], np.int32)))
        for length, own in by_length.items():
            words, total = sums(np.concatenate([w for w, _ in own], axis=1), np.concatenate([n for _, n in own]))
            words = words[:, total >= min_count].astype(np.int64)
            pairs = pair_keys(words[:-1], words[1:], vocabulary).T
            offsets = pa.array(np.arange(len(pairs) + 1) * (length - 1), pa.int32())
            chains.append(pa.ListArray.from_arrays(offsets, pa.array(pairs.ravel(), pa.int64())))
            counts.append(total[total >= min_count])
        return pa.table({"chain": pa.concat_arrays(chains), "f": pa.array(np.concatenate(counts), pa.int64())})

    return run


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", max_words: int = 5, min_count: int = 100,
                  shard_bytes: int = 2_000_000) -> DataFrame:
    """All phrases of 2 to ``max_words`` words that occur ``min_count`` times in a language.

    One row per phrase: lang, n (words of the language), phrase, words, chain (its word
    pairs), f, firsts (counts of its first 1, 2, ... words), rests (counts of what is left of it then).
    """
    slim = docs.select(F.col(text).cast("string").alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    shards = durable(slim.mapInArrow(_shards(shard_bytes), SHARDS))
    named = shards.filter("words is not null").drop("ids")
    parts = max(1, int(named.count() * PARTS_PER_SHARD))
    listed = named.mapInArrow(_listed(parts), LISTED_ROWS)
    numbered = durable(listed.groupBy("part").applyInArrow(_numbered(min_count, parts), NUMBERED_ROWS), ["kind"])
    totals = numbered.filter("kind = 'lang'").groupBy("lang").agg(F.sum("f").alias("n"))
    words = numbered.filter("kind = 'word'").select("lang", "word", "f", "word_id")
    vocabulary = (words.agg(F.max("word_id")).first()[0] or 0) + 1
    own = numbered.filter("kind = 'shard'").select("of", "local", "numbers")
    blocks = shards.filter("ids is not null").select("shard", "ids")
    built = blocks.groupBy("shard").cogroup(own.groupBy("of")).applyInArrow(_index(max_words, parts, vocabulary), INDEX_ROWS)
    built = durable(built)
    index = built.filter("text is not null").select("shard", "text", "numbers")
    pairs = built.filter("keys is not null").select("shard", "part", "keys", "counts")
    pairs = durable(pairs.groupBy("part").applyInArrow(_frequent(min_count, vocabulary), FREQUENT_ROWS))
    frequent = pairs.filter("pair is not null").select("pair", "w1", "w2", "f")
    words = words.join(broadcast_if_small(totals), "lang")
    first = words.select(F.col("word_id").alias("w1"), "lang", "n", F.col("word").alias("first"), F.col("f").alias("f1"))
    second = words.select(F.col("word_id").alias("w2"), F.col("word").alias("last"), F.col("f").alias("f2"))
    level = durable(frequent.join(first, "w1").join(second, "w2").select(
        F.array("pair").alias("chain"), "lang", "n", F.concat_ws(" ", "first", "last").alias("phrase"), "last",
        F.lit(2).alias("words"), "f", F.array("f1").alias("firsts"), F.array("f2").alias("rests")))
    out = level
    if max_words > 2:
        here = pairs.filter("keys is not null").select(F.col("shard").alias("of"), "keys")
        longer = index.groupBy("shard").cogroup(here.groupBy("of")).applyInArrow(_longer(max_words, parts, vocabulary), CHAIN_ROWS)
        longer = durable(longer.groupBy("part").applyInArrow(_summed(min_count, vocabulary), "chain array<bigint>, f long"))
    for length in range(3, max_words + 1):
        size = length - 1
        own = longer.filter(F.size("chain") == size).withColumns({
            "_head": F.slice("chain", 1, size - 1), "_tail": F.slice("chain", 2, size - 1)})
        head = level.select(F.col("chain").alias("_head"), "lang", "n", F.col("phrase").alias("_phrase"), F.col("f").alias("_f"), F.col("firsts").alias("_firsts"))
        tail = level.select(F.col("chain").alias("_tail"), "last", F.col("f").alias("_g"), F.col("rests").alias("_rests"))
        level = durable(own.join(head, "_head").join(tail, "_tail").select(
            "chain", "lang", "n", F.concat_ws(" ", "_phrase", "last").alias("phrase"), "last", F.lit(length).alias("words"), "f",
            F.concat("_firsts", F.array("_f")).alias("firsts"), F.concat(F.array("_g"), "_rests").alias("rests")))
        out = out.unionByName(level)
    return out.drop("last")


def maximal(phrases: DataFrame) -> DataFrame:
    """Phrases without those that stand in a longer one of the same count.

    A longer phrase is as rare as its rarest part, so it is enough to look one word to the left and right.
    """
    size = F.size("chain")
    inner = phrases.filter(size > 1)
    parts = inner.select(F.slice("chain", F.lit(1), size - 1).alias("chain"), F.col("f").alias("_more")).unionByName(
        inner.select(F.slice("chain", F.lit(2), size - 1).alias("chain"), F.col("f").alias("_more")))
    most = parts.groupBy("chain").agg(F.max("_more").alias("_more"))
    return phrases.join(most, "chain", "left").filter("_more is null or _more < f").drop("_more")


def scored(phrases: DataFrame, top: int) -> DataFrame:
    """The ``top`` phrases of each language by their lowest cut; of cuts that tie the first."""
    wide = "cast({} as decimal(19, 0))"  # products of three counts fit 38 digits
    cut = F.expr(
        "array_min(transform(sequence(1, size(firsts)), k -> struct("
        f"(cast(1000 as decimal(4, 0)) * ({wide.format('f')} * {wide.format('n')}))"
        f" div ({wide.format('element_at(firsts, k)')} * {wide.format('element_at(rests, k)')}) as score, k as k,"
        " element_at(firsts, k) as l, element_at(rests, k) as r)))")
    rows = phrases.withColumn("_cut", cut).select(
        "lang", "phrase", F.col("f").alias("a"), "_cut.l", "_cut.r", "n", F.col("_cut.score").cast("long").alias("score"))
    ranked = top_rows(rows, ["lang"], [F.desc("score"), F.desc("a"), F.asc("phrase")], top, "rank")
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = 2000, **options) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    ``score`` is floor(1000 a n / (l r)) at the cut where it is lowest.
    """
    return scored(maximal(phrase_counts(docs, text, lang, **options)), top)


SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS piece, * FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[.,;:!?\x0A-\x0D]')) AS s
    FROM documents)),
w AS (SELECT piece, lang, regexp_extract_all(s, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS f
  FROM w, unnest(range(1, len(w) + 1)) AS r(i), unnest(range(1, 6)) AS q(k) WHERE i + k - 1 <= len(w) GROUP BY ALL),
c AS (SELECT lang, phrase, k AS words, f AS a, string_split(phrase, ' ') AS w FROM g WHERE k > 1 AND f >= 100),
parts AS (
  SELECT c.*, cut, array_to_string(c.w[:cut], ' ') AS head, array_to_string(c.w[cut + 1:], ' ') AS tail
  FROM c, unnest(range(1, 5)) AS q(cut) WHERE cut < c.words),
cuts AS (
  SELECT parts.lang, parts.phrase, parts.words, parts.a, x.f AS l, y.f AS r, n.n, cut,
         ((1000::HUGEINT * parts.a * n.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM parts JOIN n ON n.lang = parts.lang JOIN g x ON x.lang = parts.lang AND x.phrase = parts.head
  JOIN g y ON y.lang = parts.lang AND y.phrase = parts.tail),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT s.lang, array_to_string(s.w[i:j], ' ') AS phrase, max(s.a) AS more
  FROM c s, unnest(range(1, 5)) AS q(i), unnest(range(2, 6)) AS t(j)
  WHERE j > i AND j <= s.words AND j - i + 1 < s.words GROUP BY ALL)
SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) AS rank, best.phrase, a, l, r, n, score
FROM best LEFT JOIN inside ON inside.lang = best.lang AND inside.phrase = best.phrase WHERE more IS NULL OR more < a
QUALIFY row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, best.phrase) <= 2000
"""


@query("op13_collocations", SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest phrases of every language over all documents."""
    return collocations(read(spark, sf_dir, "documents"))
