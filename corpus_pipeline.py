"""From raw documents to shards, in five stages; each takes what its predecessor kept and decides on all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contrail.llm.common import stage
from contrail.llm.decontamination import drop_leaks
from contrail.llm.minhash_dedup import keep_one
from contrail.llm.mixing import mixed_documents
from contrail.llm.ring import assign_shards
from contrail.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go. Null and empty texts score as the machine's bias, repeated rows go or stay together, null doc_ids are
    scored as any; texts of any length are read whole; an empty table gives no rows; other columns stay, whatever their names."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the row with the smallest doc_id stays, of rows equal in doc_id
    and text one. Null and wordless texts are copies of nothing, rows with a null doc_id all stay; texts of any length are read whole; an
    empty table gives no rows; other columns stay, whatever their names."""
    return keep_one(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and wordless texts hold none, repeated rows go or stay together, null doc_ids are
    read as any; texts of any length are read whole; an empty table gives no rows; other columns stay, whatever their names."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, 0 to 3 times. A null source is one of its own, a null text has no words, rows equal in
    doc_id, source and text share what they get; texts of any length are counted whole; an empty table gives no rows; other columns stay,
    whatever their names."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with size, text_crc32, law, shard, slot and grown_shard, which replace columns of these names. Null texts count as
    empty, null doc_ids and repeated rows are dealt as any; an empty table gives no rows; other columns stay."""
    return assign_shards(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: A trained classifier, hashed signatures and balanced sampling aren't SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES:
        docs = apply(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stage(docs)
    return docs
