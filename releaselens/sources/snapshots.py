"""Timestamped snapshots of a table kind: one folder per kind, one partition per snapshot."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.ml.util import MLWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from releaselens.operators.models import Scorer, TreeScorer
from releaselens.sources.tables import CSV, utc_timestamps


def write_snapshot(df: DataFrame, root: str, kind: str, ts: str, fmt: str = "parquet") -> str:
    """Write one snapshot (``ts`` as yyyyMMdd_HHmmss). Writing the same snapshot again replaces it alone."""
    path = f"{root}/{kind}"
    (
        df.withColumn("snapshot_ts", F.lit(ts))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .options(**(CSV if fmt == "csv" else {}))
        .partitionBy("snapshot_ts")
        .format(fmt)
        .save(path)
    )
    return path


def latest_snapshot(spark: SparkSession, root: str, kind: str, fmt: str = "parquet") -> DataFrame:
    """Newest snapshot of a kind by its timestamp: found by the folders' names, and only that one is scanned."""
    table = spark.read.options(**(CSV | {"multiLine": True} if fmt == "csv" else {})).format(fmt).load(f"{root}/{kind}")
    newest = max(n.split("=", 1)[1] for n in _folders(spark, f"{root}/{kind}") if n.startswith("snapshot_ts="))
    return utc_timestamps(table.filter(F.col("snapshot_ts") == F.lit(newest)).drop("snapshot_ts"))


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system that Spark reaches."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []


def save_run(
    spark: SparkSession, root: str, ts: str, tables: Mapping[str, DataFrame], models: Mapping[str, Scorer | TreeScorer] | None = None
) -> None:
    """Keep a run's tables (parameters, folds, results) and fitted models, then the manifest that names them.

    The manifest is written last and its folder committed as a whole, so a run is there complete or not at all. A run
    is never replaced.
    """
    if ts in newest_runs(spark, root):
        raise ValueError(f"there is a run {ts}")
    for kind, df in tables.items():
        write_snapshot(df, root, kind, ts)
    listed = [("table", kind, None) for kind in tables]
    for name, scorer in (models or {}).items():
        path = f"{root}/models/{ts}/{name}"
        if isinstance(scorer, TreeScorer):
            scorer.table(spark).write.mode("overwrite").parquet(path)
            listed.append(("trees", name, None))
        else:
            scorer.model.write().overwrite().save(path)
            listed.append(("pipeline", name, scorer.probability))
    manifest = spark.createDataFrame(listed, "kind string, name string, probability string")
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/{ts}")


def newest_runs(spark: SparkSession, root: str) -> list[str]:
    """Timestamps of the complete runs, the newest first, by names alone: no file is opened."""
    names = sorted(_folders(spark, f"{root}/manifest"), reverse=True)
    return [ts for ts in names if "_SUCCESS" in _folders(spark, f"{root}/manifest/{ts}")]


def load_run(
    spark: SparkSession, root: str, ts: str | None = None
) -> tuple[dict[str, DataFrame], dict[str, Scorer | TreeScorer]]:
    """Tables and fitted models of a run, the newest complete one by default."""
    ts = ts or next(iter(newest_runs(spark, root)), None)
    if ts is None:
        raise FileNotFoundError(f"no complete run in {root}")
    tables, models = {}, {}
    for kind, name, probability in spark.read.parquet(f"{root}/manifest/{ts}").collect():
        path = f"{root}/models/{ts}/{name}"
        if kind == "table":
            tables[name] = spark.read.parquet(f"{root}/{name}/snapshot_ts={ts}")
        elif kind == "trees":
            models[name] = TreeScorer.of(spark.read.parquet(path))
        else:
            models[name] = Scorer(PipelineModel.load(path), probability)
    return tables, models


def save_fitted(params: dict[str, DataFrame], models: dict[str, MLWritable], root: str, ts: str) -> None:
    """Keep fitted parameter tables (scaler, folds, configuration) and models of one run."""
    for kind, df in params.items():
        write_snapshot(df, root, kind, ts)
    for name, model in models.items():
        model.write().overwrite().save(f"{root}/models/{ts}/{name}")
