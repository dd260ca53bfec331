"""From raw documents to packed training sequences: each stage works on all that the one before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Null and empty texts pass
the filters by their score like any other; a table without rows gives tables without rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelattice.llm import base, jaccard, mixing, packing, quality, queries, toxicity

MIX = mixing.Mix(block=1024)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below one half stay."""
    model = toxicity.train(docs, base.table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where("score < 0.5").select(*docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.7 or more stay."""
    model = quality.train(docs, base.table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("score >= 0.7").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five words a shingle, similarity 0.8."""
    return jaccard.keep_one(docs, jaccard.Join(words=5, percent=80))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's texts, in shard order: one row per document and block that the mix takes."""
    return mixing.mix_texts(docs, MIX)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of at most 4096."""
    return packing.pack(docs, queries.vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_duplicates", drop_copies), ("mixing", mix_sources), ("packing", pack)]
# Learned filters, index permutations and tokens are beyond SQL: tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with base.small_batches(spark):
        for name, stage in STAGES[:-1]:
            docs = base.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
