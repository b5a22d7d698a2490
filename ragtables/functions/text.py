"""Text semantics shared by every operator.

Lengths and slices count code points (Spark ``length``/``substring`` do). ``strip`` removes exactly
the characters Python's ``str.strip()`` removes; Spark's ``trim`` removes only U+0020.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters for which Python's str.isspace() is true, i.e. the set str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Java regex character class body for the same set (used inside [...] of patterns).
WHITESPACE_CLASS = r"\t\n\x0b\x0c\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Python ``str.strip()``: remove leading and trailing Unicode white space.

    Spark's trim with a set of characters walks the whole string character by character, so it runs only
    where the first or last character is white space.
    """
    c = col_(c)
    blank_end = lambda at: F.instr(F.lit(WHITESPACE), F.substring(c, at, 1)) > 0
    return F.when((F.length(c) > 0) & (blank_end(1) | blank_end(-1)), F.btrim(c, F.lit(WHITESPACE))).otherwise(c)


def normalize_newlines(c: Column | str) -> Column:
    """``\\r\\n`` and lone ``\\r`` become ``\\n``; a text without ``\\r`` is not searched by the expression."""
    c = col_(c)
    return F.when(F.contains(c, F.lit("\r")), F.regexp_replace(c, "\r\n?", "\n")).otherwise(c)


def clean_text(c: Column | str) -> Column:
    """Normalise newlines, then strip (the entry of every chunker). Each step is bound once: ``strip`` names its input
    four times, and a text that is cleaned again by the next operator would be searched sixteen times."""
    return let(col_(c), lambda raw: let(normalize_newlines(raw), strip))


def not_blank(c: Column | str) -> Column:
    """Whether a text has anything but white space, without cleaning it."""
    return F.rlike(col_(c), F.lit(f"[^{WHITESPACE_CLASS}]"))


def regex_quote(s: str) -> str:
    """A Java-regex literal for ``s`` (``split`` takes a pattern)."""
    return "\\Q" + s + "\\E" if s else s


def split_literal(c: Column | str, sep: str) -> Column:
    """Python ``str.split(sep)``: literal separator, trailing empties kept."""
    return F.split(col_(c), regex_quote(sep), -1)


def stripped_nonblank(arr: Column) -> Column:
    """``[x.strip() for x in arr if x.strip()]``."""
    return F.filter(F.transform(arr, strip), lambda s: F.length(s) > 0)


def nullif_blank(c: Column | str) -> Column:
    """Blank strings become null (the reference omits blank metadata keys)."""
    c = col_(c)
    return F.when(F.length(c) > 0, c)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (Spark does not share subexpressions inside
    lambdas, so a value used several times inside ``transform`` would be recomputed per element).

    Implemented as a one-element ``aggregate`` whose start value is the bound value.
    """
    return F.aggregate(F.array(F.lit(0)), value, lambda acc, _x: acc, body)
