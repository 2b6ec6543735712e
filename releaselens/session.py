"""Session settings and the shared scratch space where long plans are cut."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split skewed join inputs even where that costs an extra exchange for the operator above the join.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Rounds of graph searches shuffle little data but compute a lot: keep all cores busy on them.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64KB",
}


def configure(spark: SparkSession) -> SparkSession:
    """Pin UTC and adaptive execution on an existing session."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Folder for written intermediates: the cluster's ``spark.checkpoint.dir``.

    Every executor must reach it, so only a local master may fall back to a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="releaselens-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/releaselens/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession) -> str:
    """A new folder name in the scratch space."""
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}"


def materialize_in(df: DataFrame, parts: int, split: str | None = None) -> DataFrame:
    """``materialize`` with ``parts`` tasks after each shuffle if cores are fewer, for rows that multiply inside a task.

    Adaptive execution sizes tasks by the bytes they read, which does not tell what a join makes of them. ``split``
    does the same for tasks that read files: so many bytes each at most.
    """
    names = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled"]
    if split:
        names.append("spark.sql.files.maxPartitionBytes")
    conf = df.sparkSession.conf
    usual = {n: conf.get(n) for n in names}
    if parts <= df.sparkSession.sparkContext.defaultParallelism:
        return materialize(df)
    try:
        conf.set(names[0], str(parts))
        conf.set(names[1], "false")
        if split:
            conf.set(names[2], split)
        return materialize(df)
    finally:
        for n, value in usual.items():
            conf.set(n, value)


#: Seconds of a write after which its shuffle files are given up at once.
LONG = 5.0


def materialize(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` to the scratch folder and return a scan of it.

    Lineage ends at the written files, so a lost executor costs one task, not the whole chain, and the
    optimizer knows the real size: it broadcasts the table only while that is below its threshold.

    Spark deletes shuffle files once the driver collects the plan that made them, which a driver of few objects may not do
    for long: after a long write it is asked to, so that the shuffles of a chain of steps do not pile up on disk.
    """
    path = path or scratch_path(df.sparkSession)
    began = time.monotonic()
    df.write.parquet(path)
    if time.monotonic() - began > LONG:
        df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_with(df: DataFrame, path: str | None = None, **metrics: Column) -> tuple[DataFrame, dict]:
    """``materialize`` and a few aggregate figures over the written columns they need."""
    table = materialize(df, path)
    return table, table.agg(*[c.alias(name) for name, c in metrics.items()]).first().asDict()
