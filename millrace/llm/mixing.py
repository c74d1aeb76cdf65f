"""Mix sources to target weights by hash thresholds read off histograms; no sort of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import stored, unused, word_count

#: The hash has 60 bits, read LEVEL_BITS at a time.
HASH_BITS, LEVEL_BITS = 60, 10


def source_targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...], share: float, cap: float) -> dict[str | None, float]:
    """Target of each source: `share` of all sizes dealt by weight; none above `cap` times its size, the excess dealt again."""
    order = sorted((s for s, _ in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [s for s, _ in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    most = {s: cap * n for s, n in sizes}
    left, free, out = share * sum(n for _, n in sizes), set(order), dict.fromkeys(order, 0.0)
    while free:
        total = sum(weight[s] for s in free)
        full = {s for s in free if left * weight[s] / total >= most[s]}
        if not full:
            return out | {s: left * weight[s] / total for s in free}
        for s in full:
            out[s] = float(most[s])
        left, free = left - sum(most[s] for s in full), free - full
    return out


def plan_mix(rows: DataFrame, weights: tuple[float, ...], share: float, cap: float, most_sources: int) -> DataFrame:
    """From rows (source, size, h): source, source_size, target, base, threshold, one row per source."""
    spark = rows.sparkSession
    sums = rows.groupBy("source").agg(F.sum("size").alias("n")).limit(most_sources + 1).collect()
    if len(sums) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    size = {r.source: r.n for r in sums}
    target = source_targets(list(size.items()), weights, share, cap)
    base = {s: int(target[s] // n) if n else 0 for s, n in size.items()}
    need = {s: target[s] - base[s] * n for s, n in size.items()}
    #: Hashes below it are taken once more; of a source in `open_`, the sum of those below the bucket that is split.
    threshold, below, open_ = dict.fromkeys(size, 0), dict.fromkeys(size, 0), [s for s in size if need[s] > 0]
    kind = "source string, need double, low long, below long"
    for level in range(HASH_BITS // LEVEL_BITS):
        if not open_:
            break
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        width = 1 << (shift + LEVEL_BITS)
        ends = spark.createDataFrame([(s, float(need[s]), threshold[s], below[s]) for s in open_], kind)
        cut = rows.join(F.broadcast(ends), rows.source.eqNullSafe(ends.source))
        cut = cut.where((rows.h >= ends.low) & (rows.h < ends.low + F.lit(width)))
        cut = cut.groupBy(rows.source.alias("source"), "need", "below", F.shiftright("h", shift).alias("bucket"))
        cut = cut.agg(F.sum("size").alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) + F.col("below")
        cut = cut.withColumn("upto", upto).where("upto >= need")
        found = cut.groupBy("source").agg(F.min_by(F.struct("bucket", "n", "lo", "hi", "upto"), "bucket").alias("e")).collect()
        open_ = []
        for r in found:
            s, e = r.source, r.e
            threshold[s], below[s] = e.bucket << shift, e.upto - e.n
            if e.lo < e.hi:
                open_.append(s)
            elif abs(e.upto - need[s]) < abs(e.upto - e.n - need[s]):
                threshold[s] = e.lo + 1
    table = [(s, size[s], float(target[s]), base[s], threshold[s]) for s in size]
    return spark.createDataFrame(table, "source string, source_size long, target double, base int, threshold long")


def mix_hash() -> Column:
    """The first HASH_BITS of the MD5 of doc_id and text, so that rows without a doc_id don't share one."""
    own = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("/"), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(own), 1, HASH_BITS // 4), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, most_sources: int = 100_000
) -> DataFrame:
    """How often each document goes into the mix: doc_id, source, size, source_size, target, repeats, taken.

    Sizes are words (null text: 0). Each source takes all its documents floor(target / size) times, and once more those
    whose hash lies below a threshold. A histogram of sizes by (source, hash bucket) finds the bucket in which the
    source's remaining budget ends; only that bucket is split by its next bits, until one hash value holds the boundary,
    which is taken if that comes nearer. The thresholds are nested: a larger budget takes a superset.

    Rows with equal doc_id and text share a hash and are decided together, so a source comes within half of them of its target. Null doc_ids, null sources (a
    source of their own, last), null and empty texts (size 0) are values like any other, and texts of any length count whole. Other columns aren't looked at, whatever their
    names. An empty table gives no rows. Only one row per source returns to the driver, `most_sources` at most (more raise ValueError).
    """
    rows = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), mix_hash().alias("h")), "mix")
    plan = plan_mix(rows, weights, share, cap, most_sources)
    out = rows.join(F.broadcast(plan), rows.source.eqNullSafe(plan.source))
    repeats = F.col("base") + (F.col("h") < F.col("threshold")).cast("int")
    return out.select(
        "doc_id", rows.source, "size", "source_size", "target", repeats.alias("repeats"), (F.col("size") * repeats).alias("taken")
    )


def take_mix(
    docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, most_sources: int = 100_000
) -> DataFrame:
    """The mix that mix_sources() describes: the rows of `docs` with all columns, each as often as it is taken. Texts aren't shuffled.

    Nulls, repeated rows and empty tables are treated as there; names that clash with columns of `docs` are avoided.
    """
    rows = stored(docs.select("source", word_count(F.col("text")).alias("size"), mix_hash().alias("h")), "mix")
    plan = plan_mix(rows, weights, share, cap, most_sources)
    source, base, threshold, copy = (unused(f"__{c}", docs) for c in ("source", "base", "threshold", "copy"))
    plan = plan.select(F.col("source").alias(source), F.col("base").alias(base), F.col("threshold").alias(threshold))
    out = docs.join(F.broadcast(plan), docs.source.eqNullSafe(plan[source]))
    repeats = F.col(base) + (mix_hash() < F.col(threshold)).cast("int")
    return out.withColumn(copy, F.explode(F.array_repeat(F.lit(1), repeats))).select(*[docs[f"`{c}`"] for c in docs.columns])
