"""Radix and range partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.bits import radix_id
from millrace.plans.scratch import stored, unused


def radix_partition(df: DataFrame, key: str, bits: int) -> DataFrame:
    """Adds pid, the key's low bits; rows of partition number i lie in Spark's partition i. Null keys go to partition 0."""
    df = df.withColumn("pid", radix_id(F.col(key), bits).cast("int"))
    return df.repartitionById(1 << bits, F.coalesce("pid", F.lit(0)))


def radix_histogram(df: DataFrame, key: str, bits: int) -> DataFrame:
    return df.groupBy(radix_id(F.col(key), bits).alias("pid")).agg(F.count(F.lit(1)).alias("n"))


def ranked(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds `name`: each row's rank from 0 in the order, of any type that can be ordered; nulls come first and ties are numbered in any order.

    Rows are dealt out by ranges of all order columns together, so that neither a text, a date nor a frequent leading value puts them into one task.
    They are sorted and counted within ranges, in a stored table, and a range begins where those before it end.
    """
    part, at, before = (unused(f"__{x}", df) for x in ("part", "at", "before"))
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The lower 33 bits of the number count a partition's rows.
    rows = rows.withColumn(part, F.spark_partition_id()).withColumn(at, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    rows = stored(rows, "ranked")
    ends = Window.orderBy("of").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(F.col(part).alias("of")).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("of", F.coalesce(F.sum("n").over(ends), F.lit(0)).alias(before))
    out = rows.join(F.broadcast(sizes), rows[part] == sizes["of"])
    return out.select(*[rows[c] for c in df.columns], (F.col(at) + F.col(before)).alias(name))


def chunk_rows(n: int, threads: int, most: int | None = None) -> int:
    """Rows of a chunk: n / threads and one more, or `most` where that is no more than n / threads; 1 at least."""
    return most if most is not None and most <= n // threads else n // threads + 1


def range_chunk(df: DataFrame, order: list[str], chunks: int | None = None, size: int | None = None) -> DataFrame:
    """Adds chunk, from 1 by rank in the order.

    `chunks` alone: so many of nearly equal size, earlier ones a row larger where they don't come out even. `size` alone: chunks of so many rows. Both:
    chunks of `size` rows, the last of which takes all that are left.
    """
    rank = unused("__rank", df)
    out, r = ranked(df, order, rank), F.col(rank)
    if size is None:
        small, more = divmod(df.count(), chunks)
        early = more * (small + 1)
        chunk = F.when(r < early, F.floor(r / (small + 1))).otherwise(more + F.floor((r - early) / max(1, small))) + 1
    else:
        chunk = F.floor(r / F.lit(size)) + 1 if size else F.lit(chunks)
        chunk = F.least(chunk, F.lit(chunks)) if chunks else chunk
    return out.withColumn("chunk", chunk.cast("long")).drop(rank)
