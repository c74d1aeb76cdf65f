"""Rows as text and CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import row_text

#: Results of this many rows or more aren't printed.
MOST_PRINTED = 80_000


def as_text(df: DataFrame) -> DataFrame:
    """A column s: each row's values joined by commas."""
    return df.select(row_text(*df.columns).alias("s"))


def printable(df: DataFrame, most: int = MOST_PRINTED) -> DataFrame:
    """as_text() of a result with fewer than `most` rows, else no rows; no more than `most` rows are counted."""
    few = df.limit(most).count() < most
    return as_text(df if few else df.limit(0))


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """With a header and without quotes; `one_file` is for small fixtures."""
    df = df.coalesce(1) if one_file else df
    df.write.option("header", True).option("quote", "").csv(path)


def write_lines(lines: DataFrame, path: str, header: str, one_file: bool = False) -> None:
    """A column of lines as they are, each file with the header as its first line. Empty lines are left out."""
    lines = lines.toDF(header)
    lines = lines.coalesce(1) if one_file else lines
    lines.write.option("header", True).option("quote", "").option("sep", "\u0001").option("emptyValue", "").csv(path)


def lines_between(lines: DataFrame, least: int, most: int, n: int, *order: str) -> DataFrame:
    """The first n of the lines with a length from `least` to `most`: by these columns (csv_source.POSITION: as in the file), else by their text."""
    fit = lines.where(F.length("value").between(least, most))
    return fit.orderBy(*(order or ["value"])).limit(n).select("value")
