"""Orders and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.operators.partitioning import ranked


def by_key(df: DataFrame, key: str, within_partitions: bool = False, position: str | None = None) -> DataFrame:
    """Ordered by the key; with `position` a column of that name says each row's place, from 0, and the rows may come in any order."""
    if position:
        return ranked(df, [key], position)
    return df.sortWithinPartitions(key) if within_partitions else df.orderBy(key)


def total_order(df: DataFrame, *columns: str) -> DataFrame:
    """By these columns, else by all in turn; texts by unsigned bytes."""
    return df.orderBy(*(columns or df.columns))


def first_n(df: DataFrame, n: int, *columns: str) -> DataFrame:
    return df.orderBy(*columns).limit(n)
