"""Parsing advisors' answers with built-in string functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the answer formats.
FIRST_LIST = r"\[([^\[\]]*)\]"
QUOTED = r"""['"]([^'"]*)['"]"""
INTEGER = r"-?\d+"
TUPLE = r"""\(\s*['"]([^'"]*)['"]\s*,\s*['"]([^'"]*)['"]\s*\)"""
TUPLE_LIST = r"(?s)\[[^\[\]]*\]"
EDIT = r"^(add_edge|delete_edge)\((.+),\s*(.+)\)"
NUMBER = r"-?\d+\.?\d*"
FENCE = r"```(?:json)?\s*|\s*```"
BIT = r"\b([01])\b"
CYCLE_EDIT = r"(?im)^\s*(Remove|Reverse)\s*:\s*(.+?)\s+and\s+(.+?)\s*$"


def strip(c: Column) -> Column:
    """Without white space (line breaks included) at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def unquote(c: Column) -> Column:
    return F.regexp_replace(strip(c), r"""^['"]+|['"]+$""", "")


def has_list(text: Column) -> Column:
    return F.regexp_like(text, F.lit(FIRST_LIST))


def parse_names(text: Column) -> Column:
    """Quoted names of the first bracketed list; NULL without a list."""
    inner = F.regexp_extract(text, FIRST_LIST, 1)
    return F.when(has_list(text), F.regexp_extract_all(inner, F.lit(QUOTED), F.lit(1)))


def parse_ints(text: Column) -> Column:
    """Integers of the first bracketed list; NULL without a list."""
    inner = F.regexp_extract(text, FIRST_LIST, 1)
    found = F.regexp_extract_all(inner, F.lit(INTEGER), F.lit(0))
    return F.when(has_list(text), F.transform(found, lambda s: s.cast("int")))


def known_names(names: Column, known: Column, target: Column) -> Column:
    """Known names other than the target, first mention of each."""
    kept = F.filter(names, lambda n: F.array_contains(known, n) & (n != target))
    return F.array_distinct(kept)


def parse_tuples(text: Column) -> Column:
    """(parent, confounder) pairs of the first list of tuples; empty without any."""
    span = F.regexp_extract(text, TUPLE_LIST, 0)
    firsts = F.regexp_extract_all(span, F.lit(TUPLE), F.lit(1))
    seconds = F.regexp_extract_all(span, F.lit(TUPLE), F.lit(2))
    return F.zip_with(firsts, seconds, lambda a, b: F.struct(a.alias("parent"), b.alias("confounder")))


def parse_edit(text: Column) -> Column:
    """(action, parent, child): add, delete or terminate; NULL if it is neither."""
    line = strip(text)
    verb = F.regexp_extract(line, EDIT, 1)
    edit = F.struct(
        F.when(verb == "add_edge", "add").otherwise("delete").alias("action"),
        unquote(F.regexp_extract(line, EDIT, 2)).alias("parent"),
        unquote(F.regexp_extract(line, EDIT, 3)).alias("child"),
    )
    stop = F.struct(
        F.lit("terminate").alias("action"), F.lit("").alias("parent"), F.lit("").alias("child")
    )
    return F.when(F.startswith(line, F.lit("terminate")), stop).when(verb != "", edit)


def parse_number(text: Column) -> Column:
    """First number of the text; NULL if there is none."""
    return F.nullif(F.regexp_extract(text, NUMBER, 0), F.lit("")).cast("double")


def parse_verdict(text: Column) -> Column:
    """KEEP, FLIP or REMOVE, the likeliest (first among equals); NULL if a number is missing."""
    body = strip(F.regexp_replace(text, FENCE, ""))
    fields = F.from_json(body, "KEEP string, FLIP string, REMOVE string")
    k = fields["KEEP"].try_cast("double")
    f = fields["FLIP"].try_cast("double")
    r = fields["REMOVE"].try_cast("double")
    best = F.greatest(k, f, r)
    full = k.isNotNull() & f.isNotNull() & r.isNotNull()
    return F.when(full & (k == best), "KEEP").when(full & (f == best), "FLIP").when(full, "REMOVE")


def parse_bit(text: Column) -> Column:
    """The digit 0 or 1 standing alone in the first line; NULL otherwise."""
    line = F.split(strip(text), r"\R")[0]
    return F.nullif(F.regexp_extract(line, BIT, 1), F.lit("")).cast("int")


def parse_cycle_edit(text: Column, cycle: Column) -> Column:
    """(action, a, b): first Remove / Reverse line naming two nodes of the cycle; NULL otherwise."""
    verbs = F.regexp_extract_all(text, F.lit(CYCLE_EDIT), F.lit(1))
    firsts = F.regexp_extract_all(text, F.lit(CYCLE_EDIT), F.lit(2))
    seconds = F.regexp_extract_all(text, F.lit(CYCLE_EDIT), F.lit(3))
    lines = F.transform(F.arrays_zip(verbs.alias("v"), firsts.alias("a"), seconds.alias("b")), lambda z: F.struct(
        F.initcap(z["v"]).alias("action"), strip(z["a"]).alias("a"), strip(z["b"]).alias("b")
    ))
    inside = F.filter(lines, lambda e: F.array_contains(cycle, e["a"]) & F.array_contains(cycle, e["b"]))
    return F.get(inside, 0)


def parse_tagged(text: Column, tag: str = "Answer") -> Column:
    """Comma-separated names between <tag> and </tag>; NULL without both tags."""
    body = rf"(?s)<{tag}>(.*?)</{tag}>"
    names = F.transform(F.split(F.regexp_extract(text, body, 1), ","), lambda s: strip(s))
    found = F.regexp_like(text, F.lit(body))
    return F.when(found, F.filter(names, lambda s: s != ""))


NODES = "array<struct<node_name: string, parents: array<string>>>"


def parse_network(text: Column) -> Column:
    """Nodes with their parents from a (fenced) JSON document; the nodes may lie under ``bn``."""
    body = strip(F.regexp_replace(text, FENCE, ""))
    outer = F.from_json(body, f"bn struct<nodes: {NODES}>, nodes {NODES}", {"allowUnquotedControlChars": "true"})
    return F.coalesce(outer["bn"]["nodes"], outer["nodes"])
