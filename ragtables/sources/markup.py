"""Markup to text (S4 HTML, S5 JSON, S6 XML, S7 CSV files) through Arrow-batched pandas UDFs over the standard parsers."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import col_

# Elements whose text is not part of the visible text.
HIDDEN_ELEMENTS = ("script", "style", "template")


class _VisibleText(HTMLParser):
    """Text nodes outside hidden elements; character references are decoded by the parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in HIDDEN_ELEMENTS

    def handle_endtag(self, tag):
        self.hidden -= tag in HIDDEN_ELEMENTS and self.hidden > 0

    def handle_startendtag(self, tag, attrs):
        pass

    def handle_data(self, data):
        if not self.hidden:
            self.nodes.append(data)


def visible_text(html: str) -> str:
    """The text nodes of a page, one per line, lines stripped, blank lines dropped."""
    parser = _VisibleText()
    parser.feed(html)
    parser.close()
    lines = (line.strip() for node in parser.nodes for line in node.splitlines())
    return "\n".join(line for line in lines if line)


@F.pandas_udf(T.StringType())
def html_to_text(html: pd.Series) -> pd.Series:
    """Visible text, one line per text node, lines stripped, blank lines dropped; markup comments, the
    doctype and hidden elements left out, all character references decoded. Null stays null."""
    return html.map(lambda v: None if v is None else visible_text(v))


def json_text(v: str) -> str:
    """Parsed and printed again with a 2-space indent, key order and non-ASCII kept."""
    import json

    return json.dumps(json.loads(v), ensure_ascii=False, indent=2)


def xml_text(v: str) -> str:
    """Pre-order walk: ``<tag>`` line then the element's own text, indent 2 per depth; attributes and tail text dropped."""
    import xml.etree.ElementTree as ET

    out, open_ = [], [(ET.fromstring(v), 0)]
    while open_:
        elem, depth = open_.pop()
        pad, text = "  " * depth, (elem.text or "").strip()
        out += [f"{pad}<{elem.tag}>", *([f"{pad}{text}"] if text else [])]
        open_ += [(child, depth + 1) for child in reversed(elem)]
    return "\n".join(out)


def json_to_text(s: Column | str) -> Column:
    """``json_text`` of a column; null stays null, and a text that cannot be parsed is null (``structured_to_text``
    tells why)."""
    return structured_to_text(F.lit(".json"), col_(s))["text"]


def xml_to_text(s: Column | str) -> Column:
    """``xml_text`` of a column; null as in S5."""
    return structured_to_text(F.lit(".xml"), col_(s))["text"]


def csv_to_text(text: str) -> str:
    """A CSV file as table text (S7): header and rows, missing values blank; a file without a column is blank."""
    import io

    try:
        table = pd.read_csv(io.StringIO(text))
    except pd.errors.EmptyDataError:
        return ""
    shown = table.astype(object).where(table.notna(), "").astype(str)
    shown.columns = [str(c) for c in shown.columns]
    return shown.to_csv(index=False).strip() or "(空表)"


PARSED = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


PARSERS = {".json": json_text, ".xml": xml_text, ".csv": csv_to_text}


def parsed_text(suffix: str, text: str) -> tuple[str | None, str | None]:
    """(text, error) of a JSON, XML or CSV text."""
    try:
        return PARSERS[suffix](text), None
    except (ValueError, SyntaxError, RecursionError) as e:  # what the three parsers raise
        return None, f"{type(e).__name__}: {e}"


@F.pandas_udf(PARSED)
def structured_to_text(suffix: pd.Series, text: pd.Series) -> pd.DataFrame:
    """struct(text, error): S5, S6 and CSV by file suffix in one UDF; other rows give nulls, and a text that cannot be
    parsed gives its error, not a failed job. The caller sends null texts for other formats: Spark evaluates a Python UDF
    for every row even under ``CASE WHEN``."""
    rows = [(None, None) if v is None or suf not in PARSERS else parsed_text(suf, v) for suf, v in zip(suffix, text)]
    return pd.DataFrame(rows, columns=["text", "error"], dtype=object)
