"""Aggregates over relations and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.partitioning import radix_histogram


def min_max(df: DataFrame, key: str) -> DataFrame:
    """The key's ends; null for an empty relation."""
    return df.agg(F.min(key).alias("mn"), F.max(key).alias("mx"))


def average_partition_size(df: DataFrame, key: str, bits: int) -> DataFrame:
    """Rows by non-empty radix partition, divided as integers."""
    return radix_histogram(df, key, bits).agg(F.expr("cast(sum(n) div count(*) as bigint)").alias("a"))


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def longest(df: DataFrame, text: str) -> DataFrame:
    return df.agg(F.max(F.length(text)).cast("long").alias("m"))


def payloads(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Each key's payloads in ascending order, repeats included. A key's list has to fit into memory; join where one may be hot."""
    return df.where(F.col(key) != "").groupBy(key).agg(F.array_sort(F.collect_list(payload)).alias("payloads"))


def skewness(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.skewness(column).alias("skew"))


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """Each value's rows and share of all."""
    n = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / n)
