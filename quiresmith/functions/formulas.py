"""Cell references in formulas."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Rows and columns of a sheet.
ROWS, COLUMNS = 1_048_576, 16_384
#: What a formula is read as: texts, quoted sheet names, bracketed parts of tables, references to columns or rows, to cells, and any other word.
_PART = re.compile(
    r"\"(?:[^\"]|\"\")*\"|'(?:[^']|'')*'!?|\[(?:[^\[\]]|\[[^\]]*\])*\]"
    r"|(?<![A-Za-z0-9_.$])(?P<c1>\$?)(?P<col1>[A-Za-z]{1,3}):(?P<c2>\$?)(?P<col2>[A-Za-z]{1,3})(?![A-Za-z0-9_.(!])"
    r"|(?<![A-Za-z0-9_.$])(?P<r1>\$?)(?P<row1>[0-9]{1,7}):(?P<r2>\$?)(?P<row2>[0-9]{1,7})(?![A-Za-z0-9_.(!])"
    r"|(?<![A-Za-z0-9_.$])(?P<dc>\$?)(?P<col>[A-Za-z]{1,3})(?P<dr>\$?)(?P<row>[0-9]{1,7})(?![A-Za-z0-9_.(!])"
    r"|[A-Za-z_\\][A-Za-z0-9_.]*"
)


def column_number(name: str) -> int:
    """The number of a column, from 1."""
    n = 0
    for letter in name.upper():
        n = 26 * n + ord(letter) - 64
    return n


def column_name(number: int) -> str:
    """The letters of a column."""
    name = ""
    while number:
        number, rest = divmod(number - 1, 26)
        name = chr(65 + rest) + name
    return name


def shift(formula: str, rows: int, columns: int) -> str:
    """A formula as it reads so many rows down and columns to the right: references move, but for those held by a dollar sign.

    What would lie outside the sheet becomes #REF!. Texts, names of sheets and
    functions, and columns of tables stay.
    """

    def col(held: str, name: str) -> str | None:
        n = column_number(name) + (0 if held else columns)
        return f"{held}{column_name(n) if not held else name}" if 1 <= n <= COLUMNS else None

    def row(held: str, number: str) -> str | None:
        n = int(number) + (0 if held else rows)
        return f"{held}{n}" if 1 <= n <= ROWS else None

    def one(m: re.Match) -> str:
        if m["col1"]:
            parts, between = (col(m["c1"], m["col1"]), col(m["c2"], m["col2"])), ":"
        elif m["row1"]:
            parts, between = (row(m["r1"], m["row1"]), row(m["r2"], m["row2"])), ":"
        elif m["col"] and column_number(m["col"]) <= COLUMNS and 1 <= int(m["row"]) <= ROWS:
            parts, between = (col(m["dc"], m["col"]), row(m["dr"], m["row"])), ""
        else:
            return m[0]
        return "#REF!" if None in parts else between.join(parts)

    return _PART.sub(one, formula)


@F.pandas_udf(StringType())
def shifted(formula: pd.Series, rows: pd.Series, columns: pd.Series) -> pd.Series:
    """``shift`` by row; null for null."""
    return pd.Series([None if f is None else shift(f, int(r), int(c)) for f, r, c in zip(formula, rows, columns)], dtype=object)
