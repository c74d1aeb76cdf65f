"""Seeded generators. Values are functions of seed, row and column, so partitions and repeated tasks don't change them."""

from __future__ import annotations

import argparse
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.schemas import CAST_INFO, ROW_BYTES, TITLE, Field

#: Key ranges of the generators: uniform and other integers lie in [LOW, HIGH), Zipf keys in [LOW, HIGH].
LOW, HIGH = 1, 1001
ALPHA = 2.0
#: Added to the largest key for rows that are to match nothing.
BEYOND = 1000
#: Cells of the guide table for Zipf keys.
GUIDE = 1024
DIGITS = 60


def rows_for(size_bytes: int, relation: str) -> int:
    return -(-size_bytes // ROW_BYTES[relation])


def uniform(seed: int, *what: Column | str) -> Column:
    """A number in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.lit(w) if isinstance(w, str) else w for w in what]), 11) / float(1 << 53)


def between(seed: int, name: str, low: int, high: int, row: Column) -> Column:
    return (F.floor(uniform(seed, name, row) * (high - low)) + low).cast("int")


def letters(seed: int, name: str, n: int, row: Column) -> Column:
    """Exactly n letters a to z."""
    one = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.char(F.pmod(F.xxhash64(F.lit(seed), F.lit(name), row, i), F.lit(26)) + 97))
    return F.array_join(one, "")


def filled(spark: SparkSession, n: int, fields: tuple[Field, ...], seed: int, low: int, high: int, key: str | None = None, value: Column | None = None) -> DataFrame:
    """Rows 1 to n: the first column counts, `key` has `value`, others are uniform integers or floats, or letters. Counts have 32 bits, so more rows raise."""
    if n >= 1 << 31:
        raise ValueError("ids have 32 bits")
    row = F.col("row")
    columns = []
    for i, f in enumerate(fields):
        if i == 0:
            c = row.cast("int")
        elif f.name == key:
            c = value.cast("int")
        elif f.real:
            c = (uniform(seed, f.name, row) * (high - low) + low).cast("float")
        else:
            c = between(seed, f.name, low, high, row) if f.width is None else letters(seed, f.name, f.width, row)
        columns.append(c.alias(f.name))
    return spark.range(1, n + 1).withColumnRenamed("id", "row").select(*columns)


def uniform_cast_info(spark: SparkSession, n: int, seed: int = 42, low: int = LOW, high: int = HIGH) -> DataFrame:
    return filled(spark, n, CAST_INFO, seed, low, high, "movie_id", between(seed, "movie_id", low, high, F.col("row")))


def title(spark: SparkSession, n: int, seed: int = 42, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Keys 1 to n."""
    return filled(spark, n, TITLE, seed, low, high)


def zipf_cast_info(spark: SparkSession, n: int, seed: int = 42, low: int = LOW, high: int = HIGH, alpha: float = ALPHA) -> DataFrame:
    """Keys v in [low, high] with probabilities in proportion to v ** -alpha, by inverting their distribution.

    A guide table says for each of GUIDE equal cells of [0, 1) which keys' intervals reach into it; it has at most high - low + GUIDE + 1 rows.
    """
    if low < 1:
        raise ValueError("Zipf keys begin at 1 or above")
    weights = [v**-alpha for v in range(low, high + 1)]
    total, at, table = sum(weights), 0.0, []
    for v, w in zip(range(low, high + 1), weights, strict=True):
        end = at + w / total if v < high else 1.0
        table += [(cell, at, end, v) for cell in range(int(at * GUIDE), min(GUIDE - 1, math.ceil(end * GUIDE) - 1) + 1)]
        at = end
    guide = F.broadcast(spark.createDataFrame(table, "cell int, from double, to double, v int"))
    rows = filled(spark, n, CAST_INFO, seed, low, high, "movie_id", F.lit(0)).drop("movie_id")
    u = uniform(seed, "movie_id", F.col("cast_info_id").cast("long"))
    rows = rows.withColumn("u", u).withColumn("cell", F.floor(u * GUIDE).cast("int"))
    rows = rows.join(guide, "cell").where((F.col("u") >= F.col("from")) & (F.col("u") < F.col("to")))
    return rows.select(*[F.col("v").alias("movie_id") if f.name == "movie_id" else F.col(f.name) for f in CAST_INFO])


def smallest(spark: SparkSession, n: int, k: int, seed: int, cells: int = 4096, few: int = 10_000) -> tuple[int, int]:
    """The k-th smallest (hash, row) of rows 1 to n: histograms of hashes, each within the cell that the one before ended in, until a cell has few rows."""
    rows = spark.range(1, n + 1).select(lot(seed, F.col("id")).alias("h"), F.col("id").alias("row"))
    low, width, before = 0, 1 << 62, 0
    while True:
        inside = rows.where((F.col("h") >= low) & (F.col("h") < low + width))
        width = max(1, width // cells)
        for r in sorted(inside.groupBy(F.floor((F.col("h") - low) / F.lit(width)).alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect()):
            if before + r.n >= k:
                break
            before += r.n
        low += r.cell * width
        if r.n <= few or width == 1:
            found = inside.where((F.col("h") >= low) & (F.col("h") < low + width)).orderBy("h", "row").limit(k - before).collect()
            return tuple(found[-1])


def lot(seed: int, row: Column) -> Column:
    """A hash of 62 bits."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit("match"), row), 2)


def match_rate_cast_info(spark: SparkSession, n: int, rate: float, seed: int = 42, low: int = LOW, high: int = HIGH) -> DataFrame:
    """Uniform keys, but for exactly floor(n * (1 - rate)) random rows whose key, high + BEYOND, matches nothing.

    Those are the rows with the smallest hashes; histograms find where they end, so no row is sorted or moved.
    """
    if not 0 <= rate <= 1:
        raise ValueError("the rate lies between 0 and 1")
    k = math.floor(n * (1 - rate))
    key = between(seed, "movie_id", low, high, F.col("row"))
    if k:
        h, last = smallest(spark, n, k, seed)
        own = lot(seed, F.col("row"))
        key = F.when((own < h) | ((own == h) & (F.col("row") <= last)), high + BEYOND).otherwise(key)
    return filled(spark, n, CAST_INFO, seed, low, high, "movie_id", key)


def string_tables(spark: SparkSession, n: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """cast_info and title whose note and title are the same 60-digit number in row i, 10 ** 59 + i from i = 0."""

    def with_text(fields: tuple[Field, ...], name: str) -> DataFrame:
        rows = filled(spark, n, fields, seed, LOW, HIGH)
        row = (F.col(fields[0].name) - 1).cast("string")
        return rows.withColumn(name, F.concat(F.lit("1"), F.lpad(row, DIGITS - 1, "0")))

    return with_text(CAST_INFO, "note"), with_text(TITLE, "title")


def generate(spark: SparkSession, kind: str, n: int | None = None, size_bytes: int | None = None, rate: float = 1.0, seed: int = 42, low: int = LOW, high: int = HIGH) -> DataFrame:
    """By kind: Uniform, Zipfian, MatchRate, Title; rows by number or by bytes. Sorted is a name without a generator."""
    if kind == "Sorted":
        raise NotImplementedError("Sorted has no generator")
    if n is None:
        n = rows_for(size_bytes or 0, "title" if kind == "Title" else "cast_info")
    if kind == "MatchRate":
        return match_rate_cast_info(spark, n, rate, seed, low, high)
    return {"Uniform": uniform_cast_info, "Zipfian": zipf_cast_info, "Title": title}[kind](spark, n, seed, low, high)


def main(args: list[str] | None = None) -> None:
    """Write one generated relation, or both string tables, as CSV with a header."""
    from millrace.plans.session import session
    from millrace.sources.sinks import write_csv

    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("kind", choices=["Uniform", "Zipfian", "MatchRate", "Title", "Strings", "Sorted"])
    p.add_argument("out")
    p.add_argument("--rows", type=int)
    p.add_argument("--bytes", type=int, default=0)
    p.add_argument("--match-rate", type=float, default=1.0)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--min", type=int, default=LOW)
    p.add_argument("--max", type=int, default=HIGH)
    p.add_argument("--one-file", action="store_true")
    a = p.parse_args(args)
    spark = session()
    if a.kind == "Strings":
        for df, name in zip(string_tables(spark, a.rows or 0, a.seed), ("cast_info", "title"), strict=True):
            write_csv(df, f"{a.out}/{name}", a.one_file)
    else:
        write_csv(generate(spark, a.kind, a.rows, a.bytes, a.match_rate, a.seed, a.min, a.max), a.out, a.one_file)


if __name__ == "__main__":
    main()
