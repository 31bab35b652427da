"""The subpackage's queries: ``opN_<name>`` over whole tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import bpe, decontam, jaccard, kneser, lengths, quality, secrets, tokenbin, urls, warc
from gridloom.runtime import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("doc_key")


def op2_url_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"))


def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_nested_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *quality.STATS, "base_failed", "kept")


def tokenizer() -> str:
    """The vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    path = Scratch(spark, "tokens").path
    manifest = tokenbin.write(docs, path, tokenizer(), end_id=2)
    return tokenbin.read(spark, path, manifest, docs.schema["doc_id"].dataType)


def op7_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lengths.histogram(_table(spark, sf_dir, "documents"), tokenizer())


def op9_vertical_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(_table(spark, sf_dir, "documents"))


def op10_word_table_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bpe.encode(_table(spark, sf_dir, "documents"), tokenizer())
    return bpe.digests(bpe.decode(ids, tokenizer()))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_leaked_items": op1_leaked_items,
        "op2_url_models": op2_url_models,
        "op3_arc_to_warc": op3_arc_to_warc,
        "op4_nested_secrets": op4_nested_secrets,
        "op5_host_rules": op5_host_rules,
        "op6_token_planes": op6_token_planes,
        "op7_kneser_ney": op7_kneser_ney,
        "op8_length_histogram": op8_length_histogram,
        "op9_vertical_jaccard": op9_vertical_jaccard,
        "op10_word_table_bpe": op10_word_table_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_leaked_items": decontam.SQL,
        "op3_arc_to_warc": warc.SQL,
        "op5_host_rules": quality.SQL,
        "op9_vertical_jaccard": jaccard.SQL,
    }
