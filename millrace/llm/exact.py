"""Exact deduplication by content-defined chunk recipes, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import MOST_KEYS, SPACE, joined, kept_rows, stored, text_key

LEAST_CHUNK, MOST_CHUNK = 64, 2048


def characters(one_in: int) -> str:
    """A class of printable ASCII characters, one in so many by a multiplicative hash."""
    return "[" + "".join(rf"\x{c:02x}" for c in range(33, 127) if (c * 2654435761 >> 13) % one_in == 0) + "]"


#: A chunk may end before a blank that a pair of characters from these classes follows, or at its largest size.
CHUNK = rf"(?s).{{{LEAST_CHUNK},{MOST_CHUNK}}}?(?= {characters(6)}{characters(4)})|.{{1,{MOST_CHUNK}}}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def chunks(text: Column) -> Column:
    """Content-defined chunks of a text; joined, they are the text again. Equal text after a cut gives equal further chunks."""
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def chunk_hash(chunk: Column) -> Column:
    """128 bits of a chunk, as two hashes whose seeds differ."""
    return F.struct(F.xxhash64(chunk).alias("x"), F.xxhash64(F.lit(1), chunk).alias("y"))


def ordinals(found: DataFrame, met: DataFrame) -> DataFrame:
    """Of distinct chunks (h, c) those whose hash is in `met`, as others have it too: h, c, k (0, 1, ... by text). A table, however many there are."""
    met = F.broadcast(met) if met.count() <= MOST_KEYS else met
    return found.join(met, "h", "left_semi").select("h", "c", (F.row_number().over(Window.partitionBy("h").orderBy("c")) - 1).alias("k"))


def recipes(docs: DataFrame, hashed: Callable[[Column], Column] = chunk_hash) -> DataFrame:
    """Each row's chunks as identifiers, stored: row (a number), doc_id, h1, h2 (text_key), text_sha256, recipe (array of (h, k)).

    Chunk texts are deduplicated, on the map side first, and compared byte by byte under their hash. A chunk that is alone under its hash has
    ordinal 0; others get theirs by a join on the text, of the rows that hold such chunks only.
    """
    text = docs.select("doc_id", *text_key(), normalised(F.col("text")).alias("t"))
    found = text.select(F.explode(chunks(F.col("t"))).alias("c")).groupBy(hashed(F.col("c")).alias("h"), "c").agg(F.count(F.lit(1)).alias("n"))
    met = stored(found.groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("h"), "met")
    identifier = F.transform(chunks(F.col("t")), lambda c: F.struct(hashed(c).alias("h"), F.lit(0).alias("k")))
    plain = [F.sha2("t", 256).alias("text_sha256"), identifier.alias("recipe")]
    if met.isEmpty():
        rows = text.select("doc_id", "h1", "h2", *plain)
        return stored(rows.withColumn("row", F.monotonically_increasing_id()), "recipes")
    rows = stored(text.withColumn("row", F.monotonically_increasing_id()), "numbered")
    each = rows.select("row", F.posexplode(chunks(F.col("t"))).alias("at", "c")).withColumn("h", hashed(F.col("c")))
    named = each.join(ordinals(found, met).where("k > 0"), ["h", "c"]).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("at", "k"))).alias("ks"))
    rows = rows.select("row", "doc_id", "h1", "h2", *plain).join(named, "row", "left")
    ordinal = F.transform("recipe", lambda x, i: F.struct(x["h"].alias("h"), F.coalesce(F.try_element_at("ks", i), F.lit(0)).alias("k")))
    return stored(rows.withColumn("recipe", F.when(F.col("ks").isNull(), F.col("recipe")).otherwise(ordinal)).drop("ks"), "recipes")


def grouped(rows: DataFrame) -> DataFrame:
    """Rows of recipes() with group_size, and first: the row of their group that stays as (no, doc_id, h1, h2, row), null where a row is alone."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h1", "h2", "row"))
    groups = rows.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), first.alias("first")).where("group_size > 1")
    out = joined(rows, stored(groups, "groups"), ["recipe"], "group_size", rows.count(), "left")
    return out.withColumn("group_size", F.coalesce("group_size", F.lit(1)).cast("long"))


def exact_duplicates(docs: DataFrame, hashed: Callable[[Column], Column] = chunk_hash) -> DataFrame:
    """Groups of documents whose texts are equal up to runs of white space: doc_id, keep_id, group_size, kept, text_sha256.

    Every text is cut into content-defined chunks. Chunk texts are deduplicated and verified byte by byte, so that an identifier
    (hash, ordinal) stands for one text, however many chunks share a hash. Texts are equal exactly if their ordered identifier lists are, so only those
    lists are grouped and joined; a document's text moves once at most, in chunks, however long it is.

    Null counts as the empty text; those form one group. Of a group the row with the smallest doc_id stays (null doc_ids last; of
    repeated rows with that doc_id exactly one). Other columns of `docs` aren't looked at, whatever their names. An empty table gives no rows.
    """
    out = grouped(recipes(docs, hashed))
    return out.select(
        "doc_id",
        F.when(F.col("first").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        "group_size",
        F.coalesce(F.col("row") == F.col("first.row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that exact_duplicates() keeps, with all columns, whatever their names.

    Rows are told apart by doc_id and 128 bits of the text, so rows of one doc_id and different texts (null or not) both stay; of repeated rows of one that
    stays one does, whichever its other columns are. Null and empty texts are one group, very long ones are like others, an empty table gives no rows.
    """
    rows = grouped(recipes(docs))
    own = F.coalesce((F.col("row") == F.col("first.row")), F.lit(True))
    fates = rows.groupBy("doc_id", "h1", "h2").agg(F.max(own).alias("kept"), F.count(F.lit(1)).alias("n"))
    return kept_rows(docs, fates, "gone")
