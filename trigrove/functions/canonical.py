"""Canonical forms of values, as columns and (for literals) in Python."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Field

TRUE, FALSE = ("TRUE", "T", "YES", "Y", "1"), ("FALSE", "F", "NO", "N", "0")
#: What counts as a number: no blanks, suffixes or hexadecimals.
NUMBER = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf(inity)?|nan)$"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def enum_value(c: Column) -> Column:
    """Trimmed, upper case; blank is null."""
    return F.nullif(F.upper(trimmed(c)), F.lit(""))


def boolean_value(c: Column) -> Column:
    """True or false of the known spellings, null if blank, else an error."""
    v = F.upper(trimmed(c))
    bad = F.raise_error(F.concat(F.lit("invalid boolean value: "), c)).cast("boolean")
    return F.when(c.isNull() | (v == ""), F.lit(None).cast("boolean")).when(v.isin(*TRUE), True).when(v.isin(*FALSE), False).otherwise(bad)


def number_value(c: Column) -> Column:
    """The number that a text spells exactly, else 0."""
    return F.coalesce(F.when(c.rlike(NUMBER), c.try_cast("double")), F.lit(0.0))


def stored_value(f: Field, c: Column) -> Column:
    """A raw text in the form in which its field is stored."""
    if f.type == "number":
        return number_value(c)
    if f.type == "enum":
        return enum_value(c)
    if f.type == "boolean":
        return boolean_value(c)
    return F.nullif(c, F.lit(""))


def shown_value(f: Field, c: Column) -> Column:
    """A stored value as results show it: absent texts are empty, zero (and what
    isn't finite) is null, booleans stay."""
    if f.type == "number":
        return F.when((c != 0.0) & ~F.isnan(c) & (F.abs(c) != float("inf")), c)
    return c if f.type == "boolean" else F.coalesce(c, F.lit(""))


def parse_number(s: str) -> float | None:
    return float(s) if re.search(NUMBER, s) and not s.endswith("\n") else None


def filter_value(f: Field, value: str) -> str | None:
    """A filter's literal in canonical form; None takes no part."""
    v = value.strip()
    if f.type == "number" or not v:
        return None
    if f.type == "enum":
        return v.upper()
    if f.type == "boolean":
        up = v.upper()
        return "TRUE" if up in TRUE else "FALSE" if up in FALSE else up
    return v


def filter_values(f: Field, value: str) -> list[str]:
    """The pieces of a list, canonical, in order, repeated ones repeated."""
    return [v for piece in value.split(",") if (v := filter_value(f, piece)) is not None]


def query_trigrams(q: str) -> Counter:
    """How often each three characters follow each other in a query, lower case.
    Blanks count; shorter queries have none."""
    q = q.lower()
    return Counter(q[i : i + 3] for i in range(len(q) - 2))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: used as an expression within a
    lambda, it would be computed anew for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trigrams(text: Column) -> Column:
    """All trigrams of the lower-cased text, in order."""
    return F.when(text.isNotNull(), bound(F.split(F.lower(text), ""), _triples))


def _triples(chars: Column) -> Column:
    return F.filter(F.transform(chars, lambda c, i: F.concat(c, F.get(chars, i + 1), F.get(chars, i + 2))), lambda g: g.isNotNull())


def text_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits of less than 40 bytes."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: (w != "") & (F.octet_length(w) < 40))
