"""From raw documents to packed training sequences: toxicity, near-duplicates, repeated substrings, packing.

Each stage gets what its predecessor kept, as a table written and read again, and decides about all of it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tariffloom.llm import neardup, packing, substrings, toxicity
from tariffloom.llm.common import shared_dir, ship, table

#: No SQL expresses a fitted classifier or a tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject."""
    ship(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8."""
    ship(spark)
    return neardup.keep_one(docs)


def distinct_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 20 words or more that also start earlier."""
    ship(spark)
    return substrings.rewrite(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 2048 ids."""
    ship(spark)
    pieces = packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("toxicity", clean), ("near-duplicates", distinct_documents), ("substrings", distinct_passages), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            path = shared_dir(spark)
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
