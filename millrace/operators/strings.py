"""Joins of texts on prefixes and on bounded equality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import prefixes, run_length, truncate_bytes
from millrace.operators.joins import MOST_BROADCAST
from millrace.plans.inspect import estimated_bytes


def exact_lookup(left: DataFrame, right: DataFrame, text: str, note: str) -> DataFrame:
    """All right rows whose note is exactly the left row's text; a note that is only a prefix of others matches nothing else."""
    return left.join(right.where(F.col(note) != ""), F.col(text) == F.col(note))


def prefix_join(
    titles: DataFrame, notes: DataFrame, title_id: str, text: str, note: str, mode: str = "shortest", compress: bool = False, most_broadcast: int = MOST_BROADCAST
) -> DataFrame:
    """Title rows beside the note rows whose note is the shortest (or longest) prefix of the title that is a note at all.

    Every note row with that note counts, so duplicates multiply; empty notes match nothing. With `compress` both texts are
    run-length encoded first, which doesn't preserve prefixes and gives another result. Titles have unique `title_id`s.
    A title meets distinct notes on its prefixes of lengths that notes have, so the join is an equi-join and
    the best length is aggregated on the map side before rows of notes, of which one may be frequent, are joined. Distinct notes are broadcast if
    all notes are estimated at no more than `most_broadcast` bytes; else both sides are shuffled, and frequent prefixes split at run time.
    """
    if mode not in ("shortest", "longest"):
        raise ValueError(f"mode: {mode}")
    enc = run_length if compress else (lambda c: c)
    names = [*titles.columns, *notes.columns]
    small = estimated_bytes(notes) <= most_broadcast
    notes = notes.withColumn("__note", enc(F.col(note))).where(F.col("__note") != "")
    keys = notes.select(F.col("__note").alias("__key")).distinct()
    lengths = keys.agg(F.collect_set(F.length("__key")).alias("lengths")).scalar()
    tried = titles.select(F.col(title_id).alias("__id"), enc(F.col(text)).alias("__text"), lengths.alias("__lengths"))
    tried = tried.select("__id", F.explode(prefixes(F.col("__text"), F.col("__lengths"))).alias("__p"))
    met = tried.select("__id", "__p.len", "__p.prefix").join(F.broadcast(keys) if small else keys, F.col("prefix") == F.col("__key"))
    pick = F.min_by if mode == "shortest" else F.max_by
    best = met.groupBy("__id").agg(pick("prefix", "len").alias("__best"))
    out = titles.join(best, F.col(title_id) == F.col("__id")).join(notes, F.col("__best") == F.col("__note"))
    return out.select(*names)


def bounded_equal_join(left: DataFrame, right: DataFrame, left_text: str, right_text: str, width: int = 100) -> DataFrame:
    """Rows whose texts agree in their first `width` bytes, or are equal if both are shorter."""
    return left.join(right, truncate_bytes(F.col(left_text), width) == truncate_bytes(F.col(right_text), width))
