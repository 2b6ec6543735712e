"""Scores of predictions and of naive baselines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from releaselens.functions import scalars as S
from releaselens.operators.ordering import running_totals


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def classification_metrics(df: DataFrame, by: Sequence[str], y: str, pred: str) -> DataFrame:
    """Confusion counts, precision, recall, F1 and Matthews correlation; undefined scores are 0."""
    truth, said = F.col(y) == 1, F.col(pred) == 1
    rows = df.groupBy(*by).agg(
        F.count_if(~truth & ~said).alias("tn"),
        F.count_if(~truth & said).alias("fp"),
        F.count_if(truth & ~said).alias("fn"),
        F.count_if(truth & said).alias("tp"),
    )
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    margins = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return rows.select(
        *by,
        _zero(S.ratio(2 * tp, 2 * tp + fp + fn)).alias("f1"),
        _zero(S.ratio(tp, tp + fp)).alias("precision"),
        _zero(S.ratio(tp, tp + fn)).alias("recall"),
        _zero(F.try_divide(tp * tn - fp * fn, margins)).alias("mcc"),
        "tn",
        "fp",
        "fn",
        "tp",
    )


def roc_auc(df: DataFrame, by: Sequence[str], y: str, score: str) -> DataFrame:
    """Area under the ROC curve per group from rank sums, ties counting half; NULL with one class only."""
    cells = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == 1).alias("pos"))
    ranked = running_totals(cells, [score], F.col("n"), by)
    sums = ranked.groupBy(*by).agg(
        F.sum("pos").cast("double").alias("p"),
        F.sum(F.col("n") - F.col("pos")).cast("double").alias("q"),
        F.sum(F.col("pos") * (F.col("before") + (F.col("n") + 1) / 2)).alias("ranks"),
    )
    p, q = F.col("p"), F.col("q")
    return sums.select(*by, F.try_divide(F.col("ranks") - p * (p + 1) / 2, p * q).alias("roc_auc"))


def majority_class(df: DataFrame, label: str) -> DataFrame:
    """One row with the most frequent label, the smallest on a tie."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias(label))


def baseline_predictions(split: DataFrame, forecasts: DataFrame, label: str = "is_degraded") -> DataFrame:
    """Rows (model, split, y, pred) of the naive, persistence and moving-average baselines.

    ``split`` holds release, split and the label; releases without a forecast are predicted 0.
    """
    held = split.filter(F.col("split") != "train").select("release", "split", F.col(label).alias("y"))
    common = majority_class(split.filter(F.col("split") == "train"), label).scalar()
    naive = held.select(F.lit("naive").alias("model"), "split", "y", common.cast("int").alias("pred"))
    known = forecasts.groupBy("release").agg(
        F.max("persist_pred").alias("persistence"), F.max("ma_pred").alias("moving_avg")
    )
    joined = held.join(known, "release", "left").fillna(0, subset=["persistence", "moving_avg"])
    told = joined.unpivot(["split", "y"], ["persistence", "moving_avg"], "model", "pred")
    return naive.unionByName(told.select("model", "split", "y", "pred"))


def baseline_metrics(split: DataFrame, forecasts: DataFrame, label: str = "is_degraded") -> DataFrame:
    """Scores of the three baselines on the validation and test splits.

    They give no probabilities, so ``roc_auc`` is there, as for models, but NULL.
    """
    scores = classification_metrics(baseline_predictions(split, forecasts, label), ["model", "split"], "y", "pred")
    return scores.withColumn("roc_auc", F.lit(None).cast("double"))
