"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

SHARDS = 24
NEIGHBOURS, QUERY_EVERY = 20, 20


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_rows

    return shard_rows(read_table(spark, sf_dir, "documents"), SHARDS)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract_pages

    return extract_pages(read_table(spark, sf_dir, "pages"))


def op3_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secret_scan import scan_secrets

    return scan_secrets(read_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit, toxicity

    docs = read_table(spark, sf_dir, "documents")
    return toxicity(docs, fit(docs, read_table(spark, sf_dir, "labels")))


def op5_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_packed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents")
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit, quality_rules

    docs = read_table(spark, sf_dir, "documents")
    return quality_rules(docs, fit(docs, read_table(spark, sf_dir, "labels")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_transducer import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op9_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merge_dropout import encoding_digests

    return encoding_digests(read_table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op10_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .multi_index import nearest

    return nearest(read_table(spark, sf_dir, "embeddings"), NEIGHBOURS, QUERY_EVERY)


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_codes import compress

    return compress(read_table(spark, sf_dir, "embeddings"))


def op12_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repeats import remove_repeats

    return remove_repeats(read_table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest

    return manifest(read_table(spark, sf_dir, "documents"))


# What SQL can express of the results above, as queries of their own.


def shard_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each shard: rows, slots from the least to the greatest, and how many slots and documents differ."""
    rows = op1_feistel_shards(spark, sf_dir)
    return rows.groupBy("shard", "law").agg(F.count("*").alias("rows"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count_distinct("slot").alias("slots"))


def document_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1 says of each document itself."""
    return op1_feistel_shards(spark, sf_dir).select("doc_id", "size", F.col("grown_shard").isNull().alias("no_grown_shard"))


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_secret_spans(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def quality_base_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7 that no model decides, and that what fails is not kept."""
    rows = op7_quality_rules(spark, sf_dir)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (F.col("base_failed") & F.col("kept")).alias("failed_but_kept"))


def fingerprint_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of op5's components by their smallest document: rows, and whether all have that id or a larger one."""
    rows = op5_simhash_components(spark, sf_dir)
    per = rows.groupBy("component_id").agg(F.min("doc_id").alias("least"), F.count("*").alias("rows"))
    return per.agg(F.sum("rows").alias("rows"), F.count_if(F.col("least") != F.col("component_id")).alias("wrongly_named"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_feistel_shards, op2_main_text, op3_secret_spans, op4_toxicity, op5_simhash_components,
        op6_packed_sequences, op7_quality_rules, op8_token_counts, op9_merge_dropout, op10_nearest_vectors,
        op11_vector_codes, op12_repeated_bytes, op13_merkle_manifest,
        shard_facts, document_sizes, secret_base_counts, quality_base_columns, fingerprint_classes,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express; the others are held against brute force in tests/llm."""
    from .oracles import all_sql

    return all_sql()
