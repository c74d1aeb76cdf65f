"""A training corpus from raw documents: quality, exact and near duplicates, mixture, packing.

Every stage takes whole texts, however long, and all but the last return the columns of their input, whatever their names. Null and empty texts are documents
like others: the classifier scores them, they form one group of exact duplicates, are mixed with size 0 and packed as an end id. Null doc_ids and sources are values of
their own. Rows of one doc_id with different texts are different documents; of rows that agree in both one stays in each deduplication. Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.llm.common import stored
from millrace.llm.exact import drop_exact_duplicates
from millrace.llm.mixing import take_mix
from millrace.llm.packing import pack_documents
from millrace.llm.quality import keep_quality
from millrace.llm.queries import tokenizer_path
from millrace.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; equal texts are decided alike."""
    return keep_quality(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal up to white space: that with the smallest doc_id, null ones last."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 of five-word shingles: that with the smallest doc_id, null ones last."""
    return drop_near_duplicates(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them: none, once or twice."""
    return take_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 4096 tokens; repeats from the mixture are packed as often as they occur."""
    return pack_documents(docs, tokenizer_path(), room=4096, end_id=1)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
