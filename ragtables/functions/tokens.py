"""Keyword tokens and the keyword score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_, let

# Word tokens are ASCII letter/digit/underscore runs; CJK tokens are single characters
# of the range U+4E00..U+9FFF.
WORD_TOKEN_REGEX = "[a-zA-Z0-9_]+"
CJK_TOKEN_REGEX = "[\u4e00-\u9fff]"


def tokenize(text: Column | str) -> Column:
    """Lower-case, then all word runs followed by all CJK characters; duplicates kept."""
    low = F.lower(col_(text))
    return F.concat(F.regexp_extract_all(low, F.lit(WORD_TOKEN_REGEX), 0), F.regexp_extract_all(low, F.lit(CJK_TOKEN_REGEX), 0))


def keyword_score_tokens(tokens: Column, text: Column | str) -> Column:
    """R2 with pre-computed question tokens: share of tokens contained in the lower-cased text."""

    def body(v):
        toks, low = v["t"], v["low"]
        n = F.size(toks)
        hits = F.size(F.filter(toks, lambda t: F.contains(low, t)))
        return F.when(n > 0, hits.cast("double") / n).otherwise(F.lit(0.0))

    return let(F.struct(tokens.alias("t"), F.lower(col_(text)).alias("low")), body)


def keyword_score(question: Column | str, text: Column | str) -> Column:
    """R2: share of question tokens (with multiplicity) that occur as a substring of the text."""
    return keyword_score_tokens(tokenize(question), text)


def word_runs(text: Column | str) -> Column:
    """Distinct maximal word runs of the lower-cased text (a word token occurs iff it is inside one)."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col_(text)), F.lit(WORD_TOKEN_REGEX), 0))


def cjk_chars(text: Column | str) -> Column:
    """Distinct CJK characters of the lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(F.lower(col_(text)), F.lit(CJK_TOKEN_REGEX), 0))
