"""The corpus pipeline: five stages over the table documents, each on what the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from anchorage.llm import mixing, packing, perplexity, superminhash, toxicity
from anchorage.llm.common import read, ready
from anchorage.llm.queries import SEQUENCE, vocabulary
from anchorage.session import stage_dir


#: Words of a shingle in the near-duplicate stage; the query op7 takes four.
DEDUP_WORDS = 5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from labelled rows of this input."""
    return toxicity.without_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return perplexity.passing(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return superminhash.deduplicated(docs, DEDUP_WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each draw; a document that is drawn twice is there twice."""
    ready(spark)
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), 0, SEQUENCE)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", apply_quality_rules),
    ("minhash_near_dedup", drop_near_duplicates),
    ("mixing_sources", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Scores and signatures cannot be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each result is written as Parquet and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES:
        path = f"{stage_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
