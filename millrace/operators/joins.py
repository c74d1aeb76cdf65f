"""Inner equi-joins by strategy, with a policy for repeated build keys, and joins that pair rows one to one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.bits import radix_bits, radix_id
from millrace.operators.partitioning import range_chunk
from millrace.plans.inspect import estimated_bytes

#: Planner hint by strategy; the build side is the right one.
HINTS = {"auto": None, "broadcast": "broadcast", "shuffle_hash": "shuffle_hash", "merge": "merge", "nested_loop": "shuffle_replicate_nl", "radix": "shuffle_hash"}
# Names that strategies also go by.
STRATEGIES = {
    "NLJ": "nested_loop",
    "TNLJ": "nested_loop",
    "SHJ_MAP": "broadcast",
    "SHJ_UNORDERED_MAP": "broadcast",
    "CHJ_MAP": "shuffle_hash",
    "SMJ": "merge",
    "TSMJ": "merge",
    "TSMJv2": "merge",
}
#: A build side whose estimated size is above this isn't broadcast, whatever the strategy says. Estimates are of compressed files, which grow several times in memory.
MOST_BROADCAST = 64 << 20
#: Nested loops are for pairs of small inputs: more estimated bytes on either side raise.
MOST_NESTED = 64 << 20


def one_per_key(df: DataFrame, key: str, keep: str, order_by: list[str]) -> DataFrame:
    """The first or last row of each key by `order_by`; aggregated on the map side first, so a hot key costs no more than others."""
    lead = [c for c in order_by if c != key]
    rest = [c for c in df.columns if c != key and c not in lead]
    best = (F.min if keep == "first" else F.max)(F.struct(*lead, *rest)).alias("__row")
    return df.groupBy(key).agg(best).select(*[F.col(c) if c == key else F.col(f"__row.`{c}`").alias(c) for c in df.columns])


def equi_join(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    strategy: str = "auto",
    duplicates: str = "all",
    order_by: list[str] | None = None,
    threads: int = 8,
    most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """Rows of both sides with equal keys: the right side's columns, then the left side's. Column names are to differ.

    `right` is the build side. `duplicates` says which of its rows with one key count: all, the first or the last by
    `order_by`. Strategies are planner hints; "radix" joins on (low bits of the key, key), so that hash partitions hold whole radix partitions.
    "broadcast" is a wish: a build side that is estimated above `most_broadcast` bytes is shuffled instead, as skewed
    keys of shuffled joins are split at run time. Null keys match nothing.
    """
    strategy = STRATEGIES.get(strategy, strategy)
    if strategy not in HINTS:
        raise ValueError(f"strategy: {strategy}")
    if duplicates != "all":
        if not order_by:
            raise ValueError("first and last need an order")
        right = one_per_key(right, right_key, duplicates, order_by)
    names = [*right.columns, *left.columns]
    hint = HINTS[strategy]
    if strategy == "broadcast" and estimated_bytes(right) > most_broadcast:
        hint = "shuffle_hash"
    if strategy == "nested_loop" and max(estimated_bytes(left), estimated_bytes(right)) > MOST_NESTED:
        raise ValueError("nested loops are for small inputs")
    cond: Column = left[left_key] == right[right_key]
    if strategy == "radix":
        bits = radix_bits(threads)
        left, right = left.withColumn("__lp", radix_id(F.col(left_key), bits)), right.withColumn("__rp", radix_id(F.col(right_key), bits))
        cond = (F.col("__lp") == F.col("__rp")) & (F.col(left_key) == F.col(right_key))
    build = right.hint(hint) if hint else right
    return left.join(build, cond, "inner").select(*names)


def in_key_range(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """The left rows whose key lies between the right side's least and largest; none if the right side is empty.

    Both ends are scalar subqueries, which reach the left scan as a filter at run time.
    """
    ends = right.agg(F.min(right_key).alias("lo"), F.max(right_key).alias("hi"))
    return left.where((F.col(left_key) >= ends.select("lo").scalar()) & (F.col(left_key) <= ends.select("hi").scalar()))


def range_pruned_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, strategy: str = "merge") -> DataFrame:
    """equi_join() of sides that are cut to each other's key range first; disjoint ranges join nothing."""
    a = in_key_range(left, right, left_key, right_key)
    return equi_join(a, in_key_range(right, left, right_key, left_key), left_key, right_key, strategy)


def zip_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_order: list[str], right_order: list[str], left_also: list[str] | None = None) -> DataFrame:
    """Pairs the k-th rows of a key on both sides: min(nL, nR) rows for each key. Orders are to be total.

    `left_also` are more columns that left rows are counted within. A key's rows are ordered in one task, which can spill.
    """
    names = [*right.columns, *left.columns]
    a = left.withColumn("__ln", F.row_number().over(Window.partitionBy(*(left_also or []), left_key).orderBy(*left_order)))
    b = right.withColumn("__rn", F.row_number().over(Window.partitionBy(right_key).orderBy(*right_order)))
    return a.join(b, (F.col(left_key) == F.col(right_key)) & (F.col("__ln") == F.col("__rn"))).select(*names)


def zip_join_chunked(left: DataFrame, right: DataFrame, left_key: str, right_key: str, left_order: list[str], right_order: list[str], chunks: int) -> DataFrame:
    """zip_join() by chunk: the left side, in order of key, is cut into `chunks` nearly equal ranges of rows, each of which begins anew.

    Adds the column chunk, from 1; earlier chunks get the rows that are left over. Σ over chunks of min(nL in it, nR) rows for each key.
    """
    cut = range_chunk(left, [left_key, *[c for c in left_order if c != left_key]], chunks)
    return zip_join(cut, right, left_key, right_key, left_order, right_order, ["chunk"])


def chunked_build_join(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, order_by: list[str], chunks: int | None = None, size: int | None = None
) -> DataFrame:
    """A hash join with a build side cut into chunks by `order_by`: the last row of a key counts within each chunk, once for each chunk.

    `chunks` and `size` say where chunks end, as in range_chunk(); chunk_rows() is a size by threads and by what a cache holds.
    """
    names = [*right.columns, *left.columns]
    cut = range_chunk(right, order_by, chunks, size)
    lead = [c for c in order_by if c != right_key]
    rest = [c for c in right.columns if c != right_key and c not in lead]
    last = cut.groupBy(right_key, "chunk").agg(F.max(F.struct(*lead, *rest)).alias("__row"))
    build = last.select(*[F.col(c) if c == right_key else F.col(f"__row.`{c}`").alias(c) for c in right.columns])
    return left.join(build.hint("shuffle_hash"), F.col(left_key) == F.col(right_key)).select(*names)
