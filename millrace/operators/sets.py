"""Set operations on multisets of rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def except_all(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left rows without right rows, each of which takes one away."""
    return left.exceptAll(right)


def gathered(*parts: DataFrame) -> DataFrame:
    """All rows of all parts."""
    return reduce(DataFrame.unionByName, parts)
