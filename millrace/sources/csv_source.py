"""Strict positional CSV loader: no quotes, exact field counts, malformed rows skipped and counted."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import leading_int, truncate_bytes
from millrace.sources.schemas import CAST_INFO, TITLE, Field, struct_type


@dataclass(frozen=True)
class Loaded:
    """The good rows and the lines that were skipped."""

    rows: DataFrame
    rejected: DataFrame


#: Columns that say where a line is: order by them for the order of the files.
POSITION = ["file", "block", "line"]


def raw_lines(spark: SparkSession, path: str, position: bool = False) -> DataFrame:
    """Every line of a text file, the header included: value, and with `position` the columns of POSITION."""
    lines = spark.read.text(path)
    if not position:
        return lines
    return lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def raw_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Files as bytes: path, length, content."""
    return spark.read.format("binaryFile").load(path).select("path", "length", "content")


def body_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines after each file's header: value. Empty lines are left out."""
    return spark.read.schema("value string").option("header", True).option("sep", "\u0001").option("quote", "").csv(path)


def decoded(field: Field, text: Column) -> Column:
    if field.real:
        return text.try_cast("float")
    return leading_int(text) if field.width is None else truncate_bytes(text, field.width)


def load(spark: SparkSession, path: str, fields: tuple[Field, ...], strict: bool = False, missing: str = "error") -> Loaded:
    """Lines split at commas, one trailing empty field lost, columns by position.

    A row needs exactly the relation's number of fields, a 32-bit integer at the beginning of each integer field (blanks before and anything after
    it are allowed) and a number in each real one; others are rejected, or fail the query if `strict`. Texts are cut at their width in bytes.
    `missing="empty"` makes a file that doesn't exist an empty relation. Files are split between tasks; rows have no order.
    """
    if missing not in ("error", "empty"):
        raise ValueError(f"missing: {missing}")
    try:
        lines = body_lines(spark, path)
    except AnalysisException:
        if missing == "error":
            raise
        lines = spark.createDataFrame([], "value string")
    parts = F.split(F.regexp_replace("value", ",$", ""), ",", -1)
    rows = lines.select("value", parts.alias("p"))
    values = [decoded(f, F.get("p", F.lit(i))).alias(f.name) for i, f in enumerate(fields)]
    numbers = [F.col(f.name).isNotNull() for f in fields if f.width is None]
    good = F.size("p") == len(fields)
    for n in numbers:
        good &= n
    rows = rows.select("value", "p", *values).withColumn("good", good)
    if strict:
        rows = rows.withColumn("good", F.when(F.col("good"), True).otherwise(F.raise_error(F.concat(F.lit("malformed row: "), F.col("value"))).cast("boolean")))
    kept = rows.where("good").select(*[f.name for f in fields])
    return Loaded(spark.createDataFrame([], struct_type(fields)).unionByName(kept), rows.where("not good").select("value"))


def load_title(spark: SparkSession, path: str, limit: int | None = None, **options) -> DataFrame:
    return first_rows(load(spark, path, TITLE, **options).rows, "title_id", limit)


def load_cast_info(spark: SparkSession, path: str, limit: int | None = None, **options) -> DataFrame:
    return first_rows(load(spark, path, CAST_INFO, **options).rows, "cast_info_id", limit)


def first_rows(rows: DataFrame, key: str, limit: int | None) -> DataFrame:
    """The rows with the smallest keys; a limit of 0 still gives one, as the count is looked at after a row is kept."""
    return rows if limit is None else rows.orderBy(key).limit(max(1, limit))
