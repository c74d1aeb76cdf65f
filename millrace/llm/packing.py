"""Best-fit packing planned on the histogram of lengths; documents then take planned slots by rank within length."""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_arrow, numbered, stored
from millrace.llm.tokens import definition_of, encoder

#: A plan of more runs than this isn't broadcast.
MOST_BROADCAST = 500_000


def plan_runs(counts: dict[int, int], room: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, on counts: runs (length, first rank, pieces, first sequence, offset, pieces per sequence).

    Each piece goes into the sequence with least room left that still holds it, or a new one. Sequences with equal room are
    kept as ranges, so time and plan follow the number of different lengths, not of documents.
    """
    runs, free, rooms, fresh = [], {}, [], 0  # free: room -> ranges (first sequence, sequences); rooms: its keys in order

    def put(r: int, first: int, n: int) -> None:
        if r and n:
            if r not in free:
                free[r] = []
                insort(rooms, r)
            heapq.heappush(free[r], (first, n))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                r = rooms[at]
                first, n = heapq.heappop(free[r])
                if not free[r]:
                    del free[r]
                    rooms.pop(at)
            else:
                r, first, n = room, fresh, -(-left // (room // length))
                fresh += n
            each = r // length
            full = min(n, left // each)
            if full:
                runs.append((length, rank, full * each, first, room - r, each))
                put(r - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:  # fewer pieces than one sequence could take are left
                runs.append((length, rank, left, first + full, room - r, left))
                put(r - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            put(r, first + full, n - full)
    return runs


def token_pieces(docs: DataFrame, tokenizer: str, room: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Whole texts as pieces of at most `room` ids: doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary)."""
    definition = docs.sparkSession.sparkContext.broadcast(definition_of(tokenizer))
    end = int(end_id).to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            texts = (t.as_py() for t in batch.column(1))
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(definition.value).encode(texts), strict=True):
                ids += end
                for k in range(0, len(ids), 4 * room):
                    b = ids[k : k + 4 * room]
                    rows.append((doc_id, k // (4 * room), k // 4, len(b) // 4, zlib.crc32(b), *[b] * with_ids))
            columns = list(zip(*rows, strict=True)) or [[]] * (len(names) + with_ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, kinds + [pa.binary()] * with_ids, strict=True)], names + ["ids"] * with_ids
            )

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return map_arrow(docs.select("doc_id", "text"), cut, schema, remembers=True)


def pack_documents(docs: DataFrame, tokenizer: str, room: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """Pack whole documents into sequences of at most `room` ids: token_pieces() with sequence_id and offset.

    Null text is empty and still has its end id. Only documents longer than `room` are cut; repeated rows are packed as often as they
    occur, equal pieces in any order. The histogram of lengths (at most `room` rows) alone reaches the driver; best fit
    runs over its counts, and a piece takes the slot that its rank among pieces of its length was planned. Null doc_ids are values like any other, long texts are encoded whole, and
    other columns aren't looked at, whatever their names. An empty table gives no rows.
    """
    pieces = stored(token_pieces(docs, tokenizer, room, end_id, with_ids), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = plan_runs(counts, room)
    plan = docs.sparkSession.createDataFrame(runs, "__length long, first long, n long, sequence long, at long, each long")
    if len(runs) <= MOST_BROADCAST:
        plan = F.broadcast(plan)
    ranked = numbered(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "__rank", sum(counts.values()))
    within = F.col("__rank") - F.col("first")
    out = ranked.join(plan, (F.col("length") == F.col("__length")) & (within >= 0) & (within < F.col("n")))
    where = (F.col("sequence") + F.floor(within / F.col("each"))).cast("long").alias("sequence_id")
    return out.select(*pieces.columns, where, (F.col("at") + F.pmod(within, F.col("each")) * F.col("length")).cast("long").alias("offset"))
