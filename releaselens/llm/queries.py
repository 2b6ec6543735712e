"""Named queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from releaselens.llm import (
    config_packing,
    decontaminate,
    length_histogram,
    license_scan,
    line_dedup,
    ordinal_classifier,
    periodic_runs,
    prefix_trie,
    quality_rules,
    secret_links,
    simhash_pivots,
    suffix_dedup,
    token_shards,
)
from releaselens.llm.common import documents


def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judge(documents(spark, folder), keep=["doc_id"])
    return judged.select(
        "doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op2_token_shards(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    path = token_shards.write_shards(docs, "word_bpe_49k.json", end_id=2)
    return token_shards.read_shards(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op3_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(documents(spark, folder)).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"
    )


def op4_ordinal_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    found = ordinal_classifier.scored(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return found.select("doc_id", "expected_grade", "tail_probability", "kept")


def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(documents(spark, folder).select("doc_id", "text"))
    return out.select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        (F.col("n_removed") > 0).alias("lost_bytes"),
    )


def op6_simhash_pivots(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_pivots.near_duplicates(documents(spark, folder).select("doc_id", "text"))


def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.find_leaks(
        documents(spark, folder).select("doc_id", "text"), spark.read.parquet(f"{folder}/benchmark.parquet")
    )


def op8_length_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return length_histogram.limits(length_histogram.lengths(documents(spark, folder), "byte_bpe_50k.json"))


def op9_config_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = config_packing.pieces(documents(spark, folder), "byte_bpe_50k.json", end_id=0, size=2048)
    return config_packing.pack(pieces, size=2048).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op10_secret_links(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_links.scan(documents(spark, folder).select("doc_id", "text"))
    return secret_links.digest(found)


def op11_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.nodes(spark.read.parquet(f"{folder}/conversations.parquet"))


def op12_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    out = line_dedup.drop_recurring_lines(documents(spark, folder))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.find_runs(documents(spark, folder), loop=True))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from releaselens.llm import reference_sql

    return reference_sql.oracle_sql()
