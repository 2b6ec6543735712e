"""Descriptions and quality checks of feature tables, with one row per feature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from releaselens.operators.ordering import exact_quantiles


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def by_feature(df: DataFrame, cols: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """Wide to long: (ids, feature, value)."""
    wide = df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols])
    return wide.unpivot(list(ids), list(cols), "feature", "value")


def pearson(x: Column, y: Column) -> Column:
    """Correlation over rows where both are present; NULL where either is constant."""
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows and share of each value, NULL left out."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = df.filter(F.col(col).isNotNull()).agg(F.count(F.lit(1)))
    return counts.withColumn("share", F.try_divide(F.col("n").cast("double"), total.scalar()))


def describe_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, sample deviation, extremes and exact quartiles of each feature."""
    rows = by_feature(df, cols)
    spread = rows.groupBy("feature").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    return spread.join(exact_quantiles(rows, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, ["feature"]), "feature")


def quality_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Missing and infinite cells and zero variance of each feature."""
    missing = F.count_if(F.col("value").isNull())
    return (
        by_feature(df, cols)
        .groupBy("feature")
        .agg(
            missing.alias("missing"),
            F.try_divide(missing.cast("double"), F.count(F.lit(1))).alias("missing_share"),
            F.count_if(F.abs("value") == F.lit(float("inf"))).alias("infinite"),
            F.coalesce(F.stddev_samp("value") == 0, F.lit(False)).alias("zero_variance"),
        )
    )


def target_correlations(df: DataFrame, target: str, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of each feature with the target."""
    rows = by_feature(df, cols, [target])
    return rows.groupBy("feature").agg(pearson(F.col("value"), F.col(target).cast("double")).alias("corr"))


def target_correlation(df: DataFrame, target: str, cols: Sequence[str], n: int = 10) -> DataFrame:
    """The ``n`` features that rise most and the ``n`` that fall most with the target."""
    known = target_correlations(df, target, cols).filter(F.col("corr").isNotNull())
    # Twelve digits: the order of summation must not decide between equal features.
    place = F.round("corr", 12)
    top = known.orderBy(place.desc(), "feature").limit(n).withColumn("side", F.lit("top"))
    low = known.orderBy(place.asc(), "feature").limit(n).withColumn("side", F.lit("bottom"))
    return top.unionByName(low)


def pair_correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of features, in one pass.

    A row becomes its column pairs inside the scan task and partial aggregation reduces them to one row per
    pair before the shuffle; the plan does not grow with the number of pairs.
    """
    names = F.array(*[F.lit(c) for c in cols])
    values = F.array(*[F.col(c).cast("double") for c in cols])
    last = len(cols) - 1
    pairs = F.expr(
        f"flatten(transform(sequence(0, {last - 1}), i -> transform(sequence(i + 1, {last}),"
        " j -> struct(i, j, _v[i] AS x, _v[j] AS y))))"
    )
    rows = df.select(values.alias("_v")).select(F.explode(pairs).alias("p")).select("p.*")
    found = rows.groupBy("i", "j").agg(pearson(F.col("x"), F.col("y")).alias("corr"))
    return found.select(F.get(names, F.col("i")).alias("col1"), F.get(names, F.col("j")).alias("col2"), "corr")


def high_corr_pairs(df: DataFrame, cols: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """Feature pairs whose absolute correlation exceeds the threshold."""
    return pair_correlations(df, cols).filter(F.abs("corr") > threshold)


def validation_summary(df: DataFrame, label: str, cols: Sequence[str]) -> DataFrame:
    """One row: sizes, class counts, quality counts, collinear pairs and an imbalance warning."""
    report = quality_report(df, cols)
    pairs = high_corr_pairs(df, cols).agg(F.count(F.lit(1)).alias("highly_correlated_pairs"))
    summary = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("total_features"),
        F.count_if(F.col(label) == 1).alias("degraded"),
        F.count_if(F.col(label) == 0).alias("stable"),
        F.coalesce(~F.avg(label).between(0.2, 0.8), F.lit(False)).alias("imbalanced"),
    )
    return summary.select(
        "*",
        report.agg(F.sum("missing")).scalar().alias("missing_values"),
        report.agg(F.max(F.col("infinite") > 0)).scalar().alias("has_infinite"),
        report.agg(F.count_if("zero_variance")).scalar().alias("zero_variance_features"),
        pairs.scalar().alias("highly_correlated_pairs"),
    )
