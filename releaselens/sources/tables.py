"""Typed scans of CSV and Parquet tables (timestamps always UTC)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ISSUES = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("key", "created", "resolved", "status", "resolution", "priority")]
    + [T.StructField(c, T.StringType()) for c in ("type", "fix_versions", "assignee", "reporter")]
)

#: Quoting of written and read CSV: quotes inside a cell are doubled.
CSV = {"header": True, "quote": '"', "escape": '"'}


def utc_timestamps(df: DataFrame) -> DataFrame:
    """Turn zone-less timestamps into instants of the session zone (UTC)."""
    zoneless = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zoneless})


def scan_typed(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    ts_cols: Sequence[str] = (),
    required: bool = True,
    fmt: str = "csv",
    multi_line: bool = True,
) -> DataFrame | None:
    """Read a table with a declared schema and parse ``ts_cols``; unparsable instants become NULL.

    A missing table raises when ``required``, else the result is None. CSV cells may hold quotes and, with
    ``multi_line``, line breaks; such files are read by one task each, so large tables belong in Parquet.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    try:
        if fmt == "csv":
            df = reader.options(**CSV, multiLine=multi_line).csv(path)
        else:
            df = reader.format(fmt).load(path)
    except AnalysisException as error:
        if required or error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return utc_timestamps(df.withColumns({c: F.try_to_timestamp(F.col(c)) for c in ts_cols}))


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return scan_typed(spark, f"{folder}/{name}.parquet", fmt="parquet")
