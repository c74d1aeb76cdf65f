"""The result checker: a join's result against that of another strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.sources.schemas import RESULT_COLUMNS


def rows_equal(left: str, right: str, columns: list[str] | None = None, ignore: tuple[str, ...] = ("movie_id",)) -> Column:
    """Equality of rows under two aliases; nulls are equal, and the columns in `ignore` don't count."""
    out = F.lit(True)
    for c in columns or RESULT_COLUMNS:
        if c not in ignore:
            out &= F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def matching(result: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Result rows whose key is expected."""
    return result.join(expected.select(key).distinct(), key, "left_semi")


def unexpected(result: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    return result.join(expected.select(key).distinct(), key, "left_anti")


def repeated(df: DataFrame, *keys: str) -> DataFrame:
    """Keys with more than one row, and how many."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_result(result: DataFrame, expected: DataFrame, key: str = "cast_info_id", ignore: tuple[str, ...] = ("movie_id",)) -> DataFrame:
    """One row: correct, duplicate, wrong and missing.

    A result row is correct if an expected row with its key equals it but for the columns in `ignore`, else wrong; duplicate counts rows beyond
    a key's first, missing the expected rows whose key the result lacks. A wrong row can also count as a duplicate.
    """
    r, e = result.alias("r"), expected.dropDuplicates([c for c in expected.columns if c not in ignore]).alias("e")
    same = (F.col(f"r.{key}") == F.col(f"e.{key}")) & rows_equal("r", "e", result.columns, ignore)
    correct = r.join(e, same, "left_semi").agg(F.count(F.lit(1)).alias("correct"))
    total = result.agg(F.count(F.lit(1)).alias("total"))
    more = repeated(result, key).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate"))
    missing = unexpected(expected, result, key).agg(F.count(F.lit(1)).alias("missing"))
    one = total.select("total", correct.scalar().alias("correct"), more.scalar().alias("duplicate"), missing.scalar().alias("missing"))
    return one.select("correct", "duplicate", (F.col("total") - F.col("correct")).alias("wrong"), "missing")
