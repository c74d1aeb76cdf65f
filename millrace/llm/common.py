"""Pieces that the corpus operators share: word classes, shared scratch tables, distributed numbering, components."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.plans.scratch import discard, fresh_dir, shared_dir, stored, unused


#: ASCII white space only: other Unicode spaces belong to words.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: numbered() gives a key one block per so many rows of the table, up to the limit.
BLOCK_ROWS, MOST_BLOCKS = 1000, 4096
#: A group with over one in so many rows, and more than LEAST_HOT, is hot: there can't be more than MOST_HOT of them.
MOST_HOT, LEAST_HOT = 1024, 64
#: A list of keys is broadcast up to so many rows, counted before; it is shuffled beyond.
MOST_KEYS = 1 << 17
#: Small tables of rounds are written in files of about so many rows: on a local file system each file costs processes that set its mode, and they count as an executor's memory again.
FILE_ROWS = 50_000


def give_back() -> None:
    """Return a worker's freed memory to the system, which idle workers would keep."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: What a worker process remembers between tasks that ask for it; tasks of other kinds forget it.
REMEMBERED: list[dict] = []


#: Most rows of an Arrow batch that workers are sent: ten thousand texts, Spark's default, cost a worker and its executor hundreds of megabytes.
MOST_BATCH = 2000


def forget() -> None:
    for kept in REMEMBERED:
        kept.clear()


def map_arrow(df: DataFrame, function: Callable, schema: str | StructType, remembers: bool = False) -> DataFrame:
    """mapInArrow with this package at hand: its source goes to the executors once a session, wherever they run.

    The session's Arrow batches are set to MOST_BATCH rows, unless they are smaller.
    """
    sc, rows = df.sparkSession.sparkContext, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(rows)) <= MOST_BATCH:
        df.sparkSession.conf.set(rows, str(MOST_BATCH))
    if not getattr(sc, "_millrace_sent", False):
        top = Path(__file__).resolve().parents[1]
        out = Path(tempfile.mkdtemp(prefix="millrace-"), "millrace.zip")
        with zipfile.ZipFile(out, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(str(out))
        sc._millrace_sent = True

    def run(batches: Iterator) -> Iterator:
        if not remembers:
            forget()
        yield from function(batches)
        give_back()

    return df.mapInArrow(run, schema)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def blocks_for(rows: int) -> int:
    return max(1, min(MOST_BLOCKS, -(-rows // BLOCK_ROWS)))


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, rows: int) -> DataFrame:
    """Add `name`: each key's rows counted from 0 without gaps, in an order fixed by hash blocks and then `order`.

    No task sees a whole key: rows are numbered within (key, hash block), and blocks get the sizes of those
    before them. Rows with equal `order` columns are interchangeable. `rows` is the table's row count.
    """
    b = f"__{name}_block"
    df = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(blocks_for(rows))).cast("int"))
    sizes = df.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy(*keys, b).orderBy(*order))
    sizes = sizes.select(*[F.col(c).alias(f"__key_{c}") for c in keys], F.col(b).alias("__block"), "__before")
    cond = [F.col(c).eqNullSafe(F.col(f"__key_{c}")) for c in keys] + [F.col(b) == F.col("__block")]
    out = df.withColumn("__in", inside.cast("long")).join(sizes, cond, "inner")
    return out.select(*[c for c in df.columns if c != b], (F.col("__in") - 1 + F.col("__before")).alias(name))


def text_key() -> list[Column]:
    """128 bits of the text as h1 and h2 (null as empty): two hashes whose seeds differ. Rows with equal doc_id, h1 and h2 are repeats of one document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]


def joined(rows: DataFrame, groups: DataFrame, keys: list[str], weight: str, total: int, how: str = "inner") -> DataFrame:
    """rows beside the one row of `groups` with their `keys`, by an inner or left join. `weight` says how many rows a group has, `total` is their sum at most.

    Hot groups are broadcast, at most MOST_HOT or total / LEAST_HOT of them, so rows that meet them aren't shuffled; no other key holds more than a
    small part of the rows.
    """
    limit = max(LEAST_HOT, total // MOST_HOT)
    hot = groups.where(F.col(weight) > limit).withColumn("__hot", F.lit(True))
    out = rows.join(F.broadcast(hot), keys, "left")
    cool = out.where("__hot is null").select(*rows.columns).join(groups.where(F.col(weight) <= limit), keys, how)
    order = [*rows.columns, *[c for c in groups.columns if c not in keys]]
    return out.where("__hot").select(*order).unionAll(cool.select(*order))


def kept_rows(docs: DataFrame, fates: DataFrame, name: str) -> DataFrame:
    """The rows of `docs`, with all columns, that `fates` keeps: (doc_id, h1, h2, kept, n), a row for each document by doc_id and text_key().

    Of n repeated rows of a document that is kept one stays. Documents that go, and kept ones with repeats, are lists of keys; each is broadcast if it has at most MOST_KEYS
    rows, else rows and list are shuffled by the key. Names that clash with columns of `docs` are avoided.
    """
    names = [unused(f"__{c}", docs) for c in ("id", "h1", "h2")]
    keyed = docs.select("*", *[c.alias(n) for c, n in zip([F.col("doc_id"), *text_key()], names, strict=True)])

    def matched(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select("doc_id", "h1", "h2").toDF(*[f"{n}_of" for n in names])
        keys = F.broadcast(keys) if keys.count() <= MOST_KEYS else keys
        cond = [rows[n].eqNullSafe(keys[f"{n}_of"]) for n in names]
        return rows.join(keys, cond, how)

    fates = stored(fates.where("not kept or n > 1"), name)
    out = matched(keyed, fates, "left_anti")
    again = fates.where("kept")
    if not again.isEmpty():
        out = out.unionAll(matched(keyed, again, "left_semi").dropDuplicates(names))
    return out.select(*[f"`{c}`" for c in docs.columns])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of `edges` (a long, b long): one row (node, component) per linked node.

    Alternating large-star and small-star steps; every node ends at the smallest node that it reaches. Each
    round's edges are a written table, deleted after the next round. Work is linear in the edges per round; only counts return to the
    driver. Edges of hubs aren't shuffled by the hub (joined).
    """

    def starred(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
        """Each edge (a, b) as (b, m), m what `least` has for a."""
        return joined(edges, least, ["a"], "n", total).select(F.col("b").alias("a"), F.col("m").alias("b"))

    def kept(edges: DataFrame, rows: int) -> DataFrame:
        """As a stored table; `rows` says how many there are at most."""
        return stored(edges.coalesce(max(1, -(-rows // FILE_ROWS))), "cc")

    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before, total = None, e.count()
    for _ in range(rounds):
        # Large star: each node sends its larger neighbours to the smallest of its neighbourhood.
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = starred(both.where("b > a"), least, 2 * total)
        # Small star: each node sends its smaller neighbours, and itself, to the smallest of them.
        large = kept(large, total)
        low = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = starred(large, low, total).unionAll(low.select("a", F.col("m").alias("b")))
        last, e = e, kept(small.where("a <> b").distinct(), 2 * total)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        discard(last)
        discard(large)
        if now == before:
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(
                e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before, total = now, now[0]
    raise RuntimeError(f"components did not settle in {rounds} rounds")
