"""From raw documents to token ids: five stages, each over all that the one before kept.

Every stage takes a null text for an empty one, a null id for an id, and rows
that repeat for rows of their own unless it says otherwise; an empty table
gives an empty one. All columns of the documents go through, whatever their
names, and so may further ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import bpe, decontam, jaccard, quality, queries, secrets
from gridloom.runtime import Scratch, workspace


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose host is rejected, go. Null and empty texts fail for want of words; a null host is a host of its own."""
    return quality.keep(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates one document stays, that with the smallest id; of rows that repeat its id and text, one. Texts without words link with nothing and all stay; of a group with null ids only, its rows stay if their texts differ."""
    return jaccard.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go, rows that repeat them too. Null and empty texts leak nothing; items without words are leaked by nothing."""
    return decontam.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked, in whatever encoding; ``n_chars`` follows the text. Null texts stay null, with a null ``n_chars``."""
    return secrets.mask(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document: its id, its token ids, and digests of these and of the text decoded from them. Null and empty texts have no ids."""
    ids = bpe.encode(docs, queries.tokenizer())
    return bpe.digests(bpe.decode(ids, queries.tokenizer()).withColumn("ids", F.col("token_ids"))).withColumnRenamed("ids", "token_ids")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("BPE encoding and decoding", bpe_round_trip),
]

#: Decoding nested secrets and BPE are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each stage's rows written and read again; what a stage wrote besides is deleted after it."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with workspace(spark):
            docs = scratch.table(f"stage-{k}", stage(spark, docs, sf_dir))
        if k:
            scratch.drop(f"stage-{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
