"""Licence scans by ordered signature rules, in Spark expressions only.

A rule is a phrase of word patterns with a label, a priority and a keyword. Texts without any sign of
a licence are gated out by one pattern. In the others every word carries its number ("mit:4 license:5"),
so that a match tells where it starts and ends. A rule runs only on texts that have its keyword.
A detection inside the interval of a detection of higher priority is suppressed, and so is one inside
a larger interval of its own priority. The base phrases are rules of their own and are never suppressed.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from causeway.llm.common import LOWER, UPPER, WORD, on_files, query, read, row_key
from causeway.session import durable

SEP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
ANY_CASE = r"[\p{Alnum}\P{ASCII}]++"  # the words of a text that is not lower-cased yet; SEP is its complement
# every rule's words imply this pattern
GATE = rf"(?i)licen[cs]|cc{SEP}+(?:by|0|zero)|cc0|clause{SEP}+bsd|creative{SEP}+commons|public{SEP}+domain|copyleft|gpl|wtfpl|spdx"

BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]

LIC = "licen[cs]e"
VER = "(?:v|ver|version)"
# label, keyword, phrase of word patterns; a pattern with a closing ? may be absent
NAMES = [
    ("gpl-1.0", "general", f"gnu? general public {LIC} {VER}? v?1"), ("gpl-2.0", "general", f"gnu? general public {LIC} {VER}? v?2"),
    ("gpl-3.0", "general", f"gnu? general public {LIC} {VER}? v?3"), ("gpl", "general", f"gnu general public {LIC}"),
    ("gpl-2.0", "gplv2", "gnu? gplv2"), ("gpl-3.0", "gplv3", "gnu? gplv3"), ("gpl-2.0", "gpl", f"gnu? gpl {VER}? v?2"),
    ("gpl-3.0", "gpl", f"gnu? gpl {VER}? v?3"), ("gpl", "gpl", "gnu gpl"),
    ("lgpl-2.1", "lesser", f"gnu? lesser general public {LIC} {VER}? v?2 1"), ("lgpl-3.0", "lesser", f"gnu? lesser general public {LIC} {VER}? v?3"),
    ("lgpl", "lesser", f"gnu? lesser general public {LIC}"), ("lgpl-2.0", "library", f"gnu? library general public {LIC}"),
    ("lgpl-2.1", "lgpl", f"gnu? lgpl {VER}? v?2 1"), ("lgpl-3.0", "lgpl", f"gnu? lgpl {VER}? v?3"), ("lgpl-3.0", "lgplv3", "gnu? lgplv3"),
    ("agpl-3.0", "affero", f"gnu? affero general public {LIC} {VER}? v?3"), ("agpl", "affero", f"gnu? affero general public {LIC}"),
    ("agpl-3.0", "agpl", f"gnu? agpl {VER}? v?3"), ("agpl-3.0", "agplv3", "gnu? agplv3"),
    ("gfdl", "documentation", f"gnu? free documentation {LIC}"),
    ("apache-1.0", "apache", f"apache software? {LIC} {VER}? v?1 0"), ("apache-1.1", "apache", f"apache software? {LIC} {VER}? v?1 1"),
    ("apache-2.0", "apache", f"apache software? {LIC} {VER}? v?2"), ("apache-2.0", "apache", f"apache 2 0? {LIC}"),
    ("apache", "apache", f"apache software {LIC}"), ("mit", "mit", f"mit x11? {LIC}"), ("mit", "expat", f"expat {LIC}"),
    ("mit", "mit", "mit licensed"), ("mit-0", "mit", f"mit no attribution {LIC}"), ("x11", "x11", f"x11 {LIC}"),
    ("bsd-2-clause", "bsd", f"(?:2|two) clause bsd "), ("bsd-3-clause", "bsd", f"(?:3|three) clause bsd "),
    ("bsd-4-clause", "bsd", f"(?:4|four) clause bsd "), ("bsd-2-clause", "bsd", f"bsd 2 clause {LIC}"),
    ("bsd-3-clause", "bsd", f"bsd 3 clause {LIC}"), ("bsd-2-clause", "simplified", f"simplified bsd {LIC}"),
    ("bsd-3-clause", "bsd", f"(?:new|revised|modified) bsd {LIC}"), ("bsd", "bsd", f"bsd style? {LIC}"), ("0bsd", "0bsd", f"0bsd {LIC}"),
    ("isc", "isc", f"isc {LIC}"), ("zlib", "zlib", f"zlib libpng? {LIC}"), ("libpng", "libpng", f"libpng {LIC}"),
    ("mpl-1.1", "mozilla", f"mozilla public {LIC} {VER}? v?1 1"), ("mpl-2.0", "mozilla", f"mozilla public {LIC} {VER}? v?2"),
    ("mpl", "mozilla", f"mozilla public {LIC}"), ("mpl-2.0", "mpl", f"mpl 2 0? {LIC}"),
    ("epl-1.0", "eclipse", f"eclipse public {LIC} {VER}? v?1"), ("epl-2.0", "eclipse", f"eclipse public {LIC} {VER}? v?2"),
    ("epl", "eclipse", f"eclipse public {LIC}"), ("edl-1.0", "eclipse", f"eclipse distribution {LIC}"),
    ("cddl-1.0", "development", f"common development and distribution {LIC}"), ("cpl-1.0", "common", f"common public {LIC}"),
    ("eupl-1.2", "union", f"european union public {LIC} {VER}? v?1 2"), ("eupl", "union", f"european union public {LIC}"),
    ("osl-3.0", "open", f"open software {LIC} {VER}? v?3"), ("afl-3.0", "academic", f"academic free {LIC} {VER}? v?3"),
    ("afl", "academic", f"academic free {LIC}"), ("artistic-1.0", "artistic", f"artistic {LIC} {VER}? v?1"),
    ("artistic-2.0", "artistic", f"artistic {LIC} {VER}? v?2"), ("artistic", "artistic", f"artistic {LIC}"),
    ("bsl-1.0", "boost", f"boost software {LIC}"), ("busl-1.1", "business", f"business source {LIC}"),
    ("ms-pl", "microsoft", f"microsoft public {LIC}"), ("ms-rl", "microsoft", f"microsoft reciprocal {LIC}"),
    ("psf", "python", f"python software foundation {LIC}"), ("php-3.0", "php", f"php {LIC}"), ("ruby", "ruby", f"ruby {LIC}"),
    ("postgresql", "postgresql", f"postgresql {LIC}"), ("ncsa", "illinois", f"university of illinois open source {LIC}"),
    ("openssl", "openssl", f"openssl {LIC}"), ("vim", "vim", f"vim {LIC}"), ("qpl-1.0", "q", f"q public {LIC}"),
    ("unlicense", "unlicense", "the unlicense"), ("wtfpl", "wtfpl", "wtfpl"), ("upl-1.0", "permissive", f"universal permissive {LIC}"),
    ("sspl-1.0", "side", f"server side public {LIC}"), ("elastic-2.0", "elastic", f"elastic {LIC} {VER}? v?2"),
    ("ecl-2.0", "educational", f"educational community {LIC}"), ("ofl-1.1", "font", f"(?:sil)? open font {LIC}"),
    ("odbl-1.0", "database", f"open database {LIC}"), ("odc-by-1.0", "attribution", f"open data commons attribution {LIC}"),
    ("pddl-1.0", "dedication", f"public domain dedication and {LIC}"), ("public-domain", "domain", "public domain dedication"),
    ("public-domain", "domain", "(?:in|into|to) the public domain"), ("cc0-1.0", "cc0", f"cc0 1 0 "),
    ("cc0-1.0", "zero", "creative commons zero"), ("cc0-1.0", "0", "cc 0"),
    ("cc-by", "commons", f"creative commons attribution "), ("cc", "commons", f"creative commons {LIC}"),
    ("proprietary", "proprietary", f"proprietary {LIC}"), ("copyleft", "copyleft", "copyleft"), ("dual", "dual", f"dual {LIC}d"),
]
# the variants of one family by rule: terms and versions
CC_TERMS = [((), "cc-by"), (("sa",), "cc-by-sa"), (("nc",), "cc-by-nc"), (("nd",), "cc-by-nd"), (("nc", "sa"), "cc-by-nc-sa"), (("nc", "nd"), "cc-by-nc-nd")]
CC_WORDS = {"sa": "sharealike", "nc": "noncommercial", "nd": "noderivatives"}
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
CONTEXTS = ["licensed under the?", "released under the?", "distributed under the?", "available under the?", "under the terms of the?",
            "subject to the terms of the?", "spdx license identifier"]
BASE_LEVEL, IN_CONTEXT, VERSIONED, NAMED = 0, 1, 2, 3
CONFIDENCE = {BASE_LEVEL: 0.8, IN_CONTEXT: 0.95, VERSIONED: 0.85, NAMED: 0.6}


def _compiled(phrase: str) -> str:
    """Pattern over numbered words; group 1 is the number of the first word, group 2 that of the last.

    The first and the last word are always there.
    """
    words = phrase.split()
    out = " "
    for k, w in enumerate(words):
        last = k == len(words) - 1
        number = r"((\d+))" if len(words) == 1 else r"(\d+)" if k == 0 or last else r"\d+"
        tail = "(?= )" if last else " "
        out += rf"(?:{w[:-1]}:{number} )?" if w.endswith("?") else rf"{w}:{number}{tail}"
    return out


def rules() -> list[tuple[str, int, str, str]]:
    """All rules: label, priority (0 first), keyword, pattern."""
    found = [(label, BASE_LEVEL, phrase.split()[-2 if phrase.endswith("license") else 0], phrase) for phrase, label in BASE]
    names = list(NAMES)
    for terms, label in CC_TERMS:
        short = " ".join(("cc", "by", *terms))
        full = " ".join(("creative commons attribution", *(CC_WORDS[t] for t in terms)))
        names.append((label, "cc", short))
        if terms:
            names.append((label, "commons", full))
        for version in CC_VERSIONS:
            names.append((f"{label}-{version.replace(' ', '.')}", "cc", f"{short} {version}"))
            names.append((f"{label}-{version.replace(' ', '.')}", "commons", f"{full} {version}"))
    for label, keyword, phrase in names:
        found.append((label, VERSIONED if label[-1].isdigit() else NAMED, keyword, phrase))
    for context in CONTEXTS:
        for label, keyword, phrase in names:
            found.append((label, IN_CONTEXT, keyword, f"{context} {phrase}"))
    out = []
    for label, level, keyword, phrase in found:
        first, _, rest = phrase.partition(" ")
        for form in (f"{first[:-1]} {rest}", rest) if first.endswith("?") else (phrase,):
            out.append((label, level, keyword, _compiled(form)))
    return out


def _rule_table() -> Column:
    """Rules by keyword, as one literal array."""
    by_word: dict[str, list] = {}
    for label, level, keyword, pattern in rules():
        by_word.setdefault(keyword, []).append({"label": label, "level": level, "pattern": pattern})
    table = [{"keyword": f" {k}:", "rules": r} for k, r in sorted(by_word.items())]
    return F.from_json(F.lit(json.dumps(table)),
                       "array<struct<keyword: string, rules: array<struct<label: string, level: int, pattern: string>>>>")


def detections(docs: DataFrame, text: str = "text") -> DataFrame:
    """All matches before suppression: ``_row``, label, level, first and last word."""
    gated = row_key(docs, "_row", F.col(text).cast("string").alias("text")).filter(F.col("text").rlike(GATE))
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0))
    numbered = F.concat(F.lit(" "), F.array_join(F.transform(words, lambda w, i: F.concat(w, F.lit(":"), i)), " "), F.lit(" "))
    gated = gated.select("_row", numbered.alias("marked"))
    by_word = gated.select("_row", "marked", F.explode(
        F.filter(_rule_table(), lambda k: F.contains(F.col("marked"), k["keyword"]))).alias("k"))
    runs = by_word.select("_row", "marked", F.explode("k.rules").alias("r"))
    places = F.arrays_zip(
        F.regexp_extract_all("marked", F.col("r.pattern"), F.lit(1)).alias("a"),
        F.regexp_extract_all("marked", F.col("r.pattern"), F.lit(2)).alias("b"))
    return runs.select("_row", "r.label", "r.level", F.explode(places).alias("p")).select(
        "_row", "label", "level", F.col("p.a").cast("long").alias("first"), F.col("p.b").cast("long").alias("last"))


def resolve(found: DataFrame) -> DataFrame:
    """Detections with ``suppressed``: inside one of higher priority, or inside a larger one of the same."""
    found = found.groupBy("_row", "level", "first", "last").agg(F.min("label").alias("label"))
    upto = Window.partitionBy("_row").orderBy("first").rangeBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("_row", "level").orderBy("first").rangeBetween(Window.unboundedPreceding, -1)
    levels = [IN_CONTEXT, VERSIONED]  # base detections neither suppress nor are suppressed
    reach = [F.coalesce(F.max(F.when(F.col("level") == k, F.col("last"))).over(upto), F.lit(-1)) for k in levels]
    higher = reduce(lambda a, b: a | b, [(F.col("level") > k) & (r >= F.col("last")) for k, r in zip(levels, reach)])
    longest = F.max("last").over(Window.partitionBy("_row", "level", "first"))
    same = (F.coalesce(F.max("last").over(before), F.lit(-1)) >= F.col("last")) | (longest > F.col("last"))
    return found.withColumn("suppressed", (F.col("level") > BASE_LEVEL) & (higher | same))


def licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    A NULL text counts as empty; rows are told apart by their place, so repeated and NULL ids are kept.
    ``n_words`` counts the words of every whole text, gated or not.
    The score joins the confidences of the detections that stay, as independent evidence.
    """
    docs = on_files(docs)
    found = resolve(durable(detections(docs, text))).filter("not suppressed")
    base = F.col("level") == BASE_LEVEL
    sure = reduce(lambda c, k: c.when(F.col("level") == k, F.log(F.lit(1 - CONFIDENCE[k]))), CONFIDENCE, F.when(F.lit(False), 0.0))
    per_doc = found.groupBy("_row").agg(
        F.sum(base.cast("long")).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        (1 - F.exp(F.sum(sure))).alias("score"), F.count("*").alias("detections"),
    ).withColumnRenamed("_row", "_found")
    none = F.lit(0).cast("long")
    n_words = F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(ANY_CASE)).cast("long"), none)
    every = row_key(docs, "_row", F.col(doc_id).alias("doc_id"), n_words.alias("n_words"))
    return every.join(per_doc, F.col("_row") == F.col("_found"), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", none).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("detections", none).alias("detections"))


@query("op3_licenses")
def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence labels of all documents."""
    return licenses(read(spark, sf_dir, "documents"))
