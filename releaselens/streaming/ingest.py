"""Incremental ingest of landed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def ingest_incremental(
    spark: SparkSession,
    src: str,
    dst: str,
    checkpoint: str,
    schema: T.StructType,
    fmt: str = "parquet",
    max_files: int = 1000,
) -> DataFrame:
    """Append files not seen before to the table ``dst`` and return it.

    Progress lives in ``checkpoint``: an interrupted run resumes there, and a rerun without new files adds
    no rows. ``max_files`` bounds one micro-batch, not the run.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(src)
    query = (
        stream.writeStream.format("parquet")
        .option("path", dst)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(schema).parquet(dst)
