"""Sheets and workbooks as text (S7), with column types found from all cells.

The cells of a sheet are texts. A column's type follows from all its cells in the sheet, as a table reader infers it:

* whole numbers only: printed without sign or zeros in front; with missing cells, as floating-point numbers;
* numbers: printed as floating-point numbers; truth values only: ``True`` and ``False``;
* anything else: as written. Missing cells (blank, ``NA`` and the like) are blank.

What a cell is makes one bit, and the bits of a column are joined by ``bit_or``: an associative aggregate, computed in
parts wherever the rows of a sheet are. Lines are then joined per sheet and sheets per workbook, in order (S9's ordered
joins, which split a hot key). Whole numbers of more than 18 digits make a column text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip
from ..plans.joins import join_small
from ..plans.strings import ordered_join
from .tables import csv_cell

# Cells that count as missing, and truth values.
MISSING_CELLS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN",
                 "None", "n/a", "nan", "null")
TRUE_CELLS, FALSE_CELLS = ("True", "TRUE", "true"), ("False", "FALSE", "false")
WHOLE, NUMBER = r"^[+-]?[0-9]{1,18}$", r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
MISSING, INT, FLOAT, BOOL, TEXT = 1, 2, 4, 8, 16
SHEET_TITLE, EMPTY_TABLE = "工作表: ", "(空表)"


@F.pandas_udf(T.StringType())
def float_text(s: pd.Series) -> pd.Series:
    """Shortest text of floating-point numbers."""
    return s.map(lambda v: None if v is None else repr(float(v)))


def cell_bits(c: Column) -> Column:
    """What a cell may be, as one bit."""
    return (F.when(c.isNull() | c.isin(*MISSING_CELLS), MISSING).when(c.rlike(WHOLE), INT).when(c.rlike(NUMBER), FLOAT)
            .when(c.isin(*TRUE_CELLS, *FALSE_CELLS), BOOL).otherwise(TEXT))


def cell_text(c: Column, bits: Column) -> Column:
    """A cell as its column's type prints it; ``bits`` are those of all cells of the column."""
    has = lambda b: bits.bitwiseAND(b) > 0
    missing = c.isNull() | c.isin(*MISSING_CELLS)
    as_text = has(TEXT) | (has(BOOL) & has(INT | FLOAT))
    as_float = ~as_text & (has(FLOAT) | (has(INT) & has(MISSING)))
    as_int = ~as_text & ~as_float & has(INT)
    # Spark runs a Python function for every row, so other cells send it a null
    number = float_text(F.when(as_float & ~missing, c))
    return (F.when(missing, "").when(as_float, number).when(as_int, F.when(as_int, c.try_cast("long")).cast("string"))
            .when(~as_text & has(BOOL), F.when(c.isin(*TRUE_CELLS), "True").otherwise("False")).otherwise(c))


def sheet_texts(rows: DataFrame, *, columns: list[str], keys: list[str], order_by: list[str]) -> DataFrame:
    """(keys, content): each sheet (the rows of a key) as lines of comma-separated cells under a header."""
    bits = rows.groupBy(*keys).agg(*[F.bit_or(cell_bits(F.col(c).cast("string"))).alias(f"_bits_{i}") for i, c in enumerate(columns)])
    same = F.lit(True)
    for k in keys:
        bits = bits.withColumnRenamed(k, f"_key_{k}")
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    typed = join_small(rows, bits, same).drop(*[f"_key_{k}" for k in keys])
    line = F.concat_ws(",", *[csv_cell(cell_text(F.col(c).cast("string"), F.col(f"_bits_{i}"))) for i, c in enumerate(columns)])
    lines = typed.select(*keys, *[c for c in order_by if c not in keys], line.alias("_line"))
    quoted = ",".join(f'"{c.replace(chr(34), chr(34) * 2)}"' if any(ch in c for ch in '",\r\n') else c for c in columns)
    text = strip(F.concat(F.lit(quoted + "\n"), F.col("_body")))
    return ordered_join(lines, keys, order_by, "_line", "\n", "_body").select(*keys, F.when(F.length(text) > 0, text).otherwise(EMPTY_TABLE).alias("content"))


def workbook_texts(rows: DataFrame, *, columns: list[str], workbook: list[str], sheet: str, order_by: list[str], name: str | None = None) -> DataFrame:
    """(workbook keys, content): the sheets of a workbook in the order of ``sheet``, each under its title (``name``, else
    ``sheet``), with a blank line between."""
    keys = [*workbook, sheet, *([name] if name and name != sheet else [])]
    sheets = sheet_texts(rows, columns=columns, keys=keys, order_by=order_by)
    titled = F.concat(F.lit(SHEET_TITLE), F.col(name or sheet).cast("string"), F.lit("\n"), "content")
    return ordered_join(sheets.select(*workbook, sheet, titled.alias("_sheet")), workbook, [sheet], "_sheet", "\n\n", "content")
