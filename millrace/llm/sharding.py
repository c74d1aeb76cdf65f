"""Vector bin packing of documents into shards: bytes, tokens and rows jointly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import numbered, stored, word_count

#: Pieces that a shard's capacity is thought in: a group larger than that is placed by itself. One larger than a shard is split
#: into pieces of BIG of them.
GRAIN, BIG = 256, 8


def place(units: np.ndarray, shards: int) -> np.ndarray:
    """A shard for each unit (rows of bytes, tokens, rows), largest first, where the dot product with residual capacity is highest.

    Both vectors are in shares of a shard's capacity. A unit goes only to shards that have room left in bytes for it,
    or, if none has, to the one with most bytes left.
    """
    total = units.sum(axis=0)
    need = units / np.maximum(total / shards, 1e-9)
    left = np.ones((shards, units.shape[1]))
    out = np.zeros(len(units), dtype=np.int64)
    for i in np.lexsort((np.arange(len(units)), -need.max(axis=1))):
        room = left[:, 0] >= need[i, 0]
        s = int(np.argmax(np.where(room, left @ need[i], -np.inf))) if room.any() else int(np.argmax(left[:, 0]))
        out[i] = s
        left[s] -= need[i]
    return out


def shard_documents(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Shard and slot of each document: doc_id, size, tokens, text_crc32, shard, slot; shards' sums of `size` come near equal.

    Tokens are words between blanks: a long text without blanks counts 1, a null one 0.

    Size is UTF-8 bytes plus 1 (null text: 1). Documents with equal texts form a group. Groups that hold more than 1/GRAIN
    of a shard in any dimension (at most 3 * GRAIN * shards can) are placed one by one; only those over a whole shard are split by
    document first, into pieces of about BIG / GRAIN of a shard. All others are gathered by hash into GRAIN * shards bundles, which are
    placed the same way, so each stays together. So the driver places a number of units that is bounded by the parameters, whatever the input. Shards differ by
    about the smallest unit where no group is large; a group of nearly a shard can make its shard larger by what is left of it.
    Null and empty texts are groups of their own, and a text of any length is one document. Repeated rows may take either's slot. Other columns aren't looked at,
    whatever their names. An empty table gives no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            word_count(F.col("text")).alias("tokens"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64("text", F.col("text").isNull()).alias("g"),
        ),
        "shard",
    )
    dims = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n")]
    t = rows.agg(*dims).first()
    caps = [max(1.0, (t[c] or 0) / shards) for c in ("size", "tokens", "n")]
    groups = rows.groupBy("g").agg(*dims)
    part = F.greatest(*[F.col(c) / F.lit(k) for c, k in zip(("size", "tokens", "n"), caps, strict=True)])
    heavy = groups.withColumn("part", part).where(F.col("part") > 1 / GRAIN)
    heavy = [(r.g, int(np.ceil(r.part * GRAIN / BIG)) if r.part > 1 else 1) for r in heavy.select("g", "part").collect()]
    table = spark.createDataFrame(heavy, "g long, pieces int")
    # A unit is (g, piece) for heavy groups and (bundle, -1) for the rest.
    rows = rows.join(F.broadcast(table), "g", "left")
    unit = F.when(F.col("pieces").isNull(), F.pmod(F.xxhash64("g"), F.lit(GRAIN * shards))).otherwise(F.col("g"))
    piece = F.when(F.col("pieces").isNull(), -1).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("pieces"))).cast("int")
    rows = rows.withColumn("unit", unit).withColumn("piece", piece)
    units = sorted(rows.groupBy("unit", "piece").agg(*dims).collect())
    to = place(np.array([[u[2], u[3], u[4]] for u in units], dtype=float).reshape(-1, 3), shards)
    plan = spark.createDataFrame([(u[0], u[1], int(s)) for u, s in zip(units, to, strict=True)], "unit long, piece int, shard int")
    rows = rows.join(F.broadcast(plan), ["unit", "piece"]).select("doc_id", "size", "tokens", "text_crc32", "shard")
    return numbered(rows, ["shard"], ["doc_id", "text_crc32"], "slot", t["n"] or 0)
