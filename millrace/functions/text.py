"""Strings: bytes, run lengths, prefixes, rows as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate_bytes(c: Column, width: int) -> Column:
    """The first `width` bytes; a cut character is kept as the bytes that are left of it."""
    return F.substring(c.cast("binary"), 1, width).cast("string")


def run_length(c: Column) -> Column:
    """Runs as the character, and `*n` after it for n > 1. Only texts that begin with 1 are encoded; others stay as they are."""
    runs = F.regexp_extract_all(c, F.lit(r"(?s)((.)\2*)"), F.lit(1))
    short = F.transform(runs, lambda r: F.concat(F.substring(r, 1, 1), F.when(F.length(r) > 1, F.concat(F.lit("*"), F.length(r))).otherwise("")))
    return F.when(c.startswith("1"), F.array_join(short, "")).otherwise(c)


def prefixes(c: Column, lengths: Column) -> Column:
    """The text's prefixes of the given lengths, as an array of (len, prefix); lengths beyond the text's are left out."""
    fit = F.filter(lengths, lambda n: n <= F.length(c))
    return F.transform(fit, lambda n: F.struct(n.alias("len"), F.substring(c, F.lit(1), n).alias("prefix")))


def leading_int(c: Column) -> Column:
    """The 32-bit integer that a text begins with after blanks, whatever follows; null if there is none or it is out of range."""
    return F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("int")


def row_text(*columns: str) -> Column:
    """A row as text: values joined by commas, without quotes; a null is an empty field, so each row has as many fields as columns."""
    return F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
