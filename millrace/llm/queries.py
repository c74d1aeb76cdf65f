"""One query per corpus operator over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.ann import nearest_vectors
from millrace.llm.exact import exact_duplicates
from millrace.llm.langid import identify_languages
from millrace.llm.mixing import mix_sources
from millrace.llm.packing import pack_documents
from millrace.llm.quality import score_quality
from millrace.llm.sharding import shard_documents
from millrace.llm.simhash import simhash_components
from millrace.llm.token_files import read_token_files, write_token_files
from millrace.llm.warc import read_archives, record_table, write_archives

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"), shards=16)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens"
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_archives(write_archives(record_table(table(spark, sf_dir, "pages"))))
    return rows.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=1)
    out = read_token_files(manifest)
    return out.select(
        "doc_id", "start", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), room=4096, end_id=1)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_sharding": op2_sharding,
    "op3_simhash": op3_simhash,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_language": op5_language,
    "op6_warc": op6_warc,
    "op7_nearest": op7_nearest,
    "op8_token_ids": op8_token_ids,
    "op9_packing": op9_packing,
    "op10_mixing": op10_mixing,
}

ORACLES: dict[str, str] = {
    # Targets: in each step sources whose share is above twice their size are fixed. Thresholds: sums of sizes in order of hashes.
    "op10_mixing": r"""
        with recursive d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
                cast('0x' || left(md5(concat(coalesce(cast(doc_id as varchar), '-'), '/', coalesce(text, ''))), 15) as bigint) as h from documents),
            s as (select source, sum(size) as n, [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as w from d group by source),
            steps as (select 0 as step, source, n, w, false as fixed from s
                union all
                select step + 1, source, n, w, fixed or (1.5 * sum(n) over () - 2.0 * coalesce(sum(n) filter (fixed) over (), 0)) * w
                    / (sum(w) filter (not fixed) over ()) >= 2.0 * n
                from steps where step < (select count(*) from s)),
            goal as (select source, n, case when fixed then 2.0 * n else (1.5 * sum(n) over () - 2.0 * coalesce(sum(n) filter (fixed) over (), 0)) * w
                    / (sum(w) filter (not fixed) over ()) end as target
                from steps where step = (select count(*) from s)),
            need as (select *, case when n > 0 then cast(floor(target / n) as integer) else 0 end as base from goal),
            cells as (select source, h, sum(size) as k from d group by source, h),
            sums as (select *, sum(k) over (partition by source order by h) as upto from cells),
            ends as (select c.source, min_by(c.h + cast(abs(upto - (target - base * n)) < abs(upto - k - (target - base * n)) as integer), c.h) as threshold
                from sums as c join need on c.source is not distinct from need.source
                where target - base * n > 0 and upto >= target - base * n group by c.source)
        select doc_id, cast(size as bigint) as size, cast(n as bigint) as source_size, cast(target as double) as target, d.source,
            cast(base + cast(h < coalesce(threshold, 0) as integer) as integer) as repeats,
            cast(size * (base + cast(h < coalesce(threshold, 0) as integer)) as bigint) as taken
        from d join need on d.source is not distinct from need.source left join ends on d.source is not distinct from ends.source""",
    "op6_warc": """
        select page_id, strlen(h) as payload_bytes, sha1(h) as payload_digest,
            case when strlen(h) >= 1000 and page_id < last then 'revisit' else 'response' end as record_type,
            case when strlen(h) >= 1000 and page_id < last then last end as refers_to
        from (select page_id, h, max(page_id) over (partition by h) as last from (select page_id, coalesce(html, '') as h from pages))""",
    "op4_exact_dedup": r"""
        select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, sha256(t) as text_sha256
        from (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
        window w as (partition by t)""",
}
