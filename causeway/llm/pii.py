"""Personal data by proposals of high recall and gradient-boosted trees.

Strict patterns with checks give the base spans, which always stay. Loose generators propose further
spans that may overlap: written-out addresses ("name at host dot org"), spaced or hexadecimal network
addresses, and digit groups that may be cards or phone numbers. Trees score each proposal by its
format and its surroundings, a threshold per kind is calibrated on held-out proposals, and of
overlapping proposals above it the likeliest one is redacted.

The trees learn here: base spans are the positive examples, also disguised by rewriting rules, and
digit strings that fail the checks, identifiers and hexadecimal tokens are the negative ones.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.functions.hashing import hash_unit
from causeway.llm.boosting import BoostedTrees
from causeway.llm.common import query, read, slices

KINDS = ("email", "ip", "card", "phone")
LOCAL_RUN = re.compile(r"[A-Za-z0-9._%+-]+")
HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind, then start. All scans are linear in the text."""
    found = []
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL_CHARS:
            start -= 1
        host = HOST.match(text, at + 1) if start < at else None
        if host:
            found.append(("email", start, host.end()))
            floor = host.end()
        else:
            floor = at + 1  # the next local part cannot hold this sign
        at = text.find("@", floor)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in DIGITS.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


AT = r"(?:@|[(\[{] ?(?:at|AT) ?[)\]}]| at | AT )"
DOT = r"(?:\.|[(\[{] ?(?:dot|DOT) ?[)\]}]| dot | DOT )"
ADDRESS = rf"{AT} ?[A-Za-z0-9-]{{1,63}} ?{DOT} ?[A-Za-z0-9-]"  # what each address has after its local part
GENERATORS = [
    ("email", re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}} ?{AT} ?"
                         rf"[A-Za-z0-9-]{{1,63}}(?: ?{DOT} ?[A-Za-z0-9-]{{2,63}}){{1,4}}")),
    ("ip", re.compile(r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\.|\[\.\]|\(\.\)| dot ) ?[0-9]{1,3}){3}(?![0-9])")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4})(?::[0-9A-Fa-f]{1,4}){0,5}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9]{2,6}(?:[ ._/-]{0,2}[0-9]{2,6}){2,6}(?![0-9A-Za-z])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z])(?:\+ ?|00)?\(?[0-9]{1,4}\)?(?:[ ./-]{1,2}\(?[0-9]{2,5}\)?){1,4}(?![0-9A-Za-z])")),
]
# every match of a generator and every base span holds one of these; hexadecimal groups need no digit
HINT = re.compile(rf"[0-9@]|{ADDRESS}|[A-Fa-f]:[A-Fa-f]{{1,4}}:")


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Overlapping spans that may be personal data."""
    if not HINT.search(text):
        return []
    return sorted({(kind, m.start(), m.end()) for kind, pattern in GENERATORS for m in pattern.finditer(text)})


CUES = [("mail", "contact", "write", "correo"), ("call", "phone", "tel", "mobile", "fax", "anruf"), ("card", "visa", "credit", "pay", "iban"),
        ("ip", "host", "server", "address", "client", "login")]
KEYED = ("token", "key", "id", "hash", "sha", "version", "isbn", "order")


def features(text: str, span: tuple[str, int, int]) -> list[float]:
    """Format of the span and cues in the characters around it."""
    kind, a, b = span
    inner = text[a:b]
    digits = [c for c in inner if c in "0123456789"]
    groups = re.findall(r"[0-9]+", inner)
    before, after = text[max(0, a - 30):a].lower(), text[b:b + 12].lower()
    return [
        *(float(kind == k) for k in KINDS), len(inner), len(digits), len(groups), max(map(len, groups), default=0),
        min(map(len, groups), default=0), len(set(digits)), float(bool(digits) and luhn("".join(digits))),
        float(all(int(g) < 256 for g in groups)), inner.count("."), inner.count("-"), inner.count(" "), float("(" in inner),
        float(inner[:1] == "+"), float("@" in inner), float(" at " in inner.lower() or "at)" in inner.lower() or "at]" in inner.lower()),
        float("dot" in inner.lower()), inner.count(":"), sum(c.isalpha() for c in inner), int(digits[0]) if digits else -1,
        *(float(any(w in before for w in words)) for words in CUES), float(any(w in before for w in KEYED)),
        float(before[-1:] in "=\"'#:"), float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in "$€£"),
        float(after[:1] in "%€$"), len(groups[-1]) if groups else 0,
    ]


def _disguises(kind: str, text: str) -> list[str]:
    """Other ways to write a base span."""
    digits = "".join(c for c in text if c.isdigit())
    if kind == "email":
        name, _, host = text.partition("@")
        return [f"{name} at {host.replace('.', ' dot ')}", f"{name} [at] {host.replace('.', ' [dot] ')}", f"{name}(at){host}"]
    if kind == "ip":
        return [text.replace(".", " . "), text.replace(".", "[.]")]
    if kind == "card":
        return [".".join(digits[i:i + 4] for i in range(0, len(digits), 4)), "_".join(digits[i:i + 4] for i in range(0, len(digits), 4))]
    return [f"00{digits[:2]} {digits[2:5]} {digits[5:]}", f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}", f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}"]


def _decoys(rng: np.random.Generator) -> list[str]:
    """Digit strings that are no personal data."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    year = str(rng.integers(1900, 2100))
    while True:
        wrong = d(16)
        if not luhn(wrong):
            break
    return [
        f"{year}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", f"{rng.integers(1, 29)}.{rng.integers(1, 13)}.{year}",
        f"{rng.integers(300, 999)}.{d(3)}.{d(3)}.{rng.integers(300, 999)}", wrong, f"{d(1)}.{d(2)}", f"{d(3)} {d(3)} {d(3)}",
        f"{year}-{year}", f"token {d(12)}", f"{d(2)}:{d(2)}:{d(2)}", f"{wrong[:4]} {wrong[4:8]} {wrong[8:12]} {wrong[12:]}", f"{d(3)}.{d(3)}.{d(3)}",
    ]


@dataclass
class PiiModel:
    trees: BoostedTrees
    thresholds: dict[str, float]

    def spans(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """Base spans, and the spans added to them."""
        base = base_spans(text)
        options = _apart(proposals(text), base)
        if not options:
            return base, []
        p = self.trees.probability(np.array([features(text, s) for s in options]))
        chosen: list[tuple[str, int, int]] = []
        taken: list[tuple[int, int]] = []
        for q, (kind, a, b) in sorted(zip(p.tolist(), options), key=lambda x: (-x[0], x[1])):
            if q < self.thresholds[kind]:
                continue
            at = bisect.bisect(taken, (a, b))
            if (at and taken[at - 1][1] > a) or (at < len(taken) and taken[at][0] < b):
                continue
            taken.insert(at, (a, b))
            chosen.append((kind, a, b))
        return base, chosen


def _apart(options: list, base: list) -> list:
    """Proposals that touch no base span, by one sorted sweep."""
    starts, ends = np.array(sorted(s[1] for s in base)), np.array(sorted(s[2] for s in base))
    # a span is free of others if as many of them have started before its end as have ended by its start
    return [s for s in options if np.searchsorted(starts, s[2], side="left") == np.searchsorted(ends, s[1], side="right")]


def fit(texts: list[str], seed: int = 5, precision: float = 0.97) -> PiiModel:
    """Learn from texts: base spans, their disguises, proposals that fail, and decoys.

    The threshold of a kind is the lowest one at which held-out proposals above it reach ``precision``;
    a kind without such a threshold adds nothing.
    """
    rng = np.random.default_rng(seed)
    x, y, kinds = [], [], []

    def learn(text: str, span: tuple[str, int, int], label: int) -> None:
        x.append(features(text, span))
        y.append(label)
        kinds.append(span[0])

    def planted(text: str, at: int, word: str, positive: str | None) -> None:
        changed = f"{text[max(0, at - 60):at]}{word}{text[at:at + 60]}"
        lead = min(60, at)
        for s in proposals(changed):
            if s[1] < lead + len(word) and s[2] > lead:
                whole = s[1] <= lead and s[2] >= lead + len(word) and s[2] - s[1] <= len(word) + 2
                learn(changed, s, int(whole and s[0] == positive))

    for text in texts:
        base = base_spans(text)
        for kind, a, b in base:
            around, shift = text[max(0, a - 60):b + 60], max(0, a - 60)
            for s in proposals(around):
                if s[1] + shift < b and s[2] + shift > a:
                    learn(around, s, int(s[0] == kind and s[1] + shift <= a and s[2] + shift >= b))
            for word in _disguises(kind, text[a:b]):
                planted(text[:a] + text[b:], a, word, kind)
        if len(text) > 20:
            at = text.find(" ", int(rng.integers(0, len(text) - 10))) + 1
            for word in _decoys(rng):
                planted(text, at, word + " ", None)
        others = _apart(proposals(text), base)
        for k in rng.permutation(len(others))[:50]:
            learn(text, others[k], 0)
    never = {k: 2.0 for k in KINDS}
    y_all, kinds_all = np.array(y, np.float64), np.array(kinds)
    if len(y) < 50 or not 0 < y_all.mean() < 1:
        return PiiModel(BoostedTrees(trees=0).fit(np.zeros((2, 1)), np.array([0.0, 1.0])), never)
    x_all = np.array(x, np.float64)
    half = rng.random(len(y_all)) < 0.6
    trees = BoostedTrees().fit(x_all[half], y_all[half])
    p = trees.probability(x_all[~half])
    thresholds = dict(never)
    for kind in KINDS:
        own = kinds_all[~half] == kind
        order = np.argsort(-p[own])
        hits = y_all[~half][own][order]
        right = np.cumsum(hits) / np.arange(1, len(hits) + 1)
        good = np.flatnonzero(right >= precision)
        if len(good) and hits[: good[-1] + 1].sum() >= 5:
            thresholds[kind] = max(0.5, float(p[own][order][good[-1]]))
    return PiiModel(trees, thresholds)


def train(docs: DataFrame, text: str = "text", sample_docs: int = 1500, sample_chars: int = 8_000_000) -> PiiModel:
    """Fit on at most ``sample_docs`` texts with digits or an @, drawn by a hash, of ``sample_chars`` in total."""
    some = docs.select(F.col(text).cast("string").alias("t")).filter(F.col("t").rlike("[0-9@]"))
    total = some.count()
    some = some.filter(hash_unit(F.xxhash64("t")) * total < 2 * sample_docs)  # only what may be taken is moved
    texts, held = [], 0
    for row in some.orderBy(F.xxhash64("t")).limit(sample_docs).toLocalIterator():
        if not texts or held + len(row.t) <= sample_chars:
            texts.append(row.t)
            held += len(row.t)
    return fit(texts)


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


FOUND = ("doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, "
         "redacted string")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _scan(shared, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in slices(batches, "text", 2_000_000):
            rows = []
            for key, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                text = text or ""
                base, more = model.spans(text) if HINT.search(text) else ([], [])
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                sha = hashlib.sha256(_joined(base).encode()).hexdigest()
                rows.append((key, *counts, sha, _joined(base + more), redact(text, base + more) if keep_text else None))
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "redacted"]
            types = [pa.int64()] * 5 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def personal_data(docs: DataFrame, model: PiiModel, doc_id: str = "doc_id", text: str = "text", redacted: bool = True) -> DataFrame:
    """One row per document: doc_id, counts of base spans, base_sha256, spans and the redacted text.

    NULL counts as empty; positions are code points. Nothing is shuffled, and repeated rows and NULL ids
    are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(_scan(shared, redacted), FOUND)


@query("op7_pii")
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    docs = read(spark, sf_dir, "documents")
    return personal_data(docs, train(docs), redacted=False).drop("redacted")
