"""Training text from raw documents: quality rules, near duplicates, benchmark passages, secrets, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from releaselens.llm import config_packing, decontaminate, quality_rules, secret_links, simhash_pivots
from releaselens.session import materialize

VOCABULARY, END_ID, SIZE = "byte_bpe_50k.json", 0, 2048
#: Workers of all stages live side by side in an executor's memory: bytes of whole texts sent to one at once, units that
#: an encoder keeps.
BATCH, KEPT = "4m", 200_000


def _lean(docs: DataFrame) -> DataFrame:
    """``docs``, with the session's Arrow batches bounded in bytes: 10,000 rows of texts would be some 30 MB."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH)
    return docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.kept_rows(_lean(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return simhash_pivots.keep_one(_lean(docs))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.clean(_lean(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts masked."""
    return secret_links.redact(_lean(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in training sequences."""
    pieces = config_packing.pieces(_lean(docs), VOCABULARY, END_ID, SIZE, kept=KEPT)
    return config_packing.pack(pieces, SIZE).drop("row")


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("secrets", secrets),
    ("packing", packing),
]
#: Tokenization, fingerprints and latent directions have no SQL; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
