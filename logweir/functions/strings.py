"""Expressions on strings and attributes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sanitized(text: Column) -> Column:
    """Without NUL characters, which stores downstream refuse. Lone surrogates can't occur: decoding has replaced them."""
    return F.replace(text, F.lit("\0"), F.lit(""))


def contains_folded(text: Column, q: str) -> Column:
    """Whether the text holds q, whatever the case; % _ and backslash are ordinary. A plain contains, as an escaped pattern isn't optimised."""
    return F.contains(F.lower(text), F.lower(F.lit(q)))


def attribute_map(attributes: Column) -> Column:
    """A JSON object of scalars as map<string, string>: true, 7 and 1.5 in their text form; null and broken JSON give null."""
    return F.from_json(attributes, "map<string,string>")


def token(key: Column, value: Column) -> Column:
    """The hash of an attribute; the order counts. Collisions are harmless, as every hit is checked again."""
    return F.xxhash64(key, value)


def attribute_tokens(attrs: Column) -> Column:
    """The sorted distinct tokens of all attributes; an empty array for none."""
    found = F.transform(F.map_entries(F.coalesce(attrs, F.from_json(F.lit("{}"), "map<string,string>"))), lambda e: token(e["key"], e["value"]))
    return F.array_sort(F.array_distinct(found))


def copy_escaped(text: Column) -> Column:
    """Backslash, line end, carriage return and tab written as two characters, for tab-separated dumps."""
    for raw, mark in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(mark))
    return text
