"""A corpus pipeline of five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept;
between stages the rows are written as Parquet and read again. All but the last
return the columns of `documents`.

1. language_id: documents without a recognisable language go; lang becomes the prediction.
2. simhash_near_dedup: of each group of near-duplicates (Jaccard 0.8 or more over
   five-word shingles, in chains) the smallest doc_id stays.
3. secret_scan: secrets in the text give way to a mark.
4. mix_sources: the texts are drawn to the target weights, at most three times each.
5. pack: pieces of documents in sequences of at most 4096 tokens.

A stage that gets no rows gives none. Extra columns pass through stages 1 to 4.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import Scratch, table
from tessera.llm.language import with_language
from tessera.llm.mixing import mixed_documents
from tessera.llm.nearcopies import near_copies
from tessera.llm.packing import pack
from tessera.llm.secrets import redacted
from tessera.llm.simhash import keep_one


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return with_language(spark, docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(spark, docs, near_copies)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted(spark, docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(spark, docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(spark, docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scan", secret_scan),
    ("mix_sources", mix_sources),
    ("pack", pack_sequences),
]

#: Tokens and fingerprints have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
