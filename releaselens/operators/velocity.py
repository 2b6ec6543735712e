"""Release bounds, weighted velocity, velocity drops and naive forecasts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from releaselens.functions import scalars as S
from releaselens.operators.ordering import previous_rows, with_position
from releaselens.sources.records import explode_delimited

# Weights of issue types and priorities.
TYPE_WEIGHTS = {"Bug": 1.0, "Improvement": 1.5, "New Feature": 2.0, "Task": 1.0, "Sub-task": 0.5, "Test": 0.5}
PRIORITY_WEIGHTS = {"Blocker": 2.0, "Critical": 1.5, "Major": 1.0, "Minor": 0.5, "Trivial": 0.3}
TYPE_COUNTS = {"bugs": "Bug", "improvements": "Improvement", "new_features": "New Feature", "tasks": "Task"}


def release_issues(issues: DataFrame, versions: str = "fix_versions") -> DataFrame:
    """One row per issue and named release."""
    return explode_delimited(issues, versions, "release")


def _bounds() -> list[Column]:
    return [
        F.count("key").alias("num_issues"),
        F.min("resolved").alias("start_date"),
        F.max("resolved").alias("end_date"),
        F.min("created").alias("earliest_issue_created"),
    ]


def _velocity(type_w: Mapping[str, float], prio_w: Mapping[str, float], default: float) -> list[Column]:
    weight = S.weight_of(F.col("type"), type_w, default) * S.weight_of(F.col("priority"), prio_w, default)
    return [
        F.count(F.lit(1)).alias("issue_count"),
        # Nine digits: the order of summation must not tell equal releases apart.
        F.round(F.sum(weight), 9).alias("weighted_velocity"),
        *[F.count_if(F.col("type") == value).alias(name) for name, value in TYPE_COUNTS.items()],
    ]


def release_bounds(exploded: DataFrame, min_issues: int = 3) -> DataFrame:
    """Size and resolution interval of each release with at least ``min_issues`` issues."""
    bounds = exploded.groupBy("release").agg(*_bounds()).filter(F.col("num_issues") >= min_issues)
    return bounds.withColumn("duration_days", S.days_between(F.col("start_date"), F.col("end_date")))


def weighted_velocity(
    exploded: DataFrame,
    type_w: Mapping[str, float] = TYPE_WEIGHTS,
    prio_w: Mapping[str, float] = PRIORITY_WEIGHTS,
    default: float = 1.0,
    min_issues: int = 3,
) -> DataFrame:
    """Bounds, weighted issue sum and type counts per release in a single aggregation."""
    rows = exploded.groupBy("release").agg(*_bounds(), *_velocity(type_w, prio_w, default))
    rows = rows.filter(F.col("num_issues") >= min_issues)
    return rows.withColumn("duration_days", S.days_between(F.col("start_date"), F.col("end_date")))


def end_order(order_col: str = "end_date", tie: str = "release") -> list[Column]:
    """Time order with open intervals last."""
    return [F.col(order_col).asc_nulls_last(), F.col(tie).asc()]


def velocity_labels(
    velocity: DataFrame, order_col: str = "end_date", threshold_pct: float = -10.0, entity: Sequence[str] = ()
) -> DataFrame:
    """Change against the release before, and the label: a drop beyond ``threshold_pct`` percent."""
    rows = with_position(velocity, end_order(order_col), entity)
    before = previous_rows(
        rows.withColumnRenamed("weighted_velocity", "prev_weighted_velocity"),
        ["prev_weighted_velocity"],
        1,
        by=entity,
    ).drop("_lag")
    change = F.col("weighted_velocity") - F.col("prev_weighted_velocity")
    pct = S.ratio(change, F.col("prev_weighted_velocity")) * 100
    return (
        rows.join(before, [*entity, "pos"], "left")
        .withColumn("velocity_change", change)
        .withColumn("velocity_change_pct", pct)
        .withColumn("is_degraded", S.flag(F.col("velocity_change_pct") < threshold_pct).cast("int"))
        .withColumn("velocity_per_day", S.ratio(F.col("weighted_velocity"), F.col("duration_days")))
        .drop("pos")
    )


def velocity_features(issues: DataFrame, min_issues: int = 3, threshold_pct: float = -10.0) -> DataFrame:
    """Issues to labelled releases."""
    return velocity_labels(weighted_velocity(release_issues(issues), min_issues=min_issues), threshold_pct=threshold_pct)


def baseline_forecasts(
    series: DataFrame, order: Sequence[Column | str], window: int = 3, entity: Sequence[str] = ()
) -> DataFrame:
    """Persistence and moving-average forecasts of the label from earlier rows only."""
    rows = with_position(series, order, entity)
    earlier = previous_rows(rows, ["weighted_velocity", "is_degraded"], window, by=entity)
    known = earlier.groupBy(*entity, "pos").agg(
        F.max(F.when(F.col("_lag") == 1, F.col("is_degraded"))).alias("_last"),
        F.avg("weighted_velocity").alias("_mean"),
    )
    return (
        rows.join(known, [*entity, "pos"], "left")
        .withColumn("persist_pred", F.coalesce("_last", F.lit(0)).cast("int"))
        .withColumn("ma_pred", S.flag(F.col("weighted_velocity") < F.col("_mean")).cast("int"))
        .drop("_last", "_mean", "pos")
    )


def threshold_sweep(df: DataFrame, thresholds: Sequence[float] = (-5, -10, -15, -20, -25)) -> DataFrame:
    """Degraded count and share for each threshold, all counted in one pass."""
    pct = F.col("velocity_change_pct")
    counts = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(pct < t).alias(f"_{i}") for i, t in enumerate(thresholds)]
    )
    rows = [
        F.struct(F.lit(abs(t)).cast("int").alias("threshold_pct"), F.col(f"_{i}").alias("n_degraded"))
        for i, t in enumerate(thresholds)
    ]
    return counts.select("n", F.explode(F.array(*rows)).alias("r")).select(
        "r.threshold_pct", "r.n_degraded", (S.ratio(F.col("r.n_degraded"), F.col("n")) * 100).alias("pct_degraded")
    )


# Eras of the recorded history.
ERAS = ((2015, "Early (2011–2015)"), (2020, "Mid (2016–2020)"))
LAST_ERA = "Recent (2021–2026)"


def period_rates(
    df: DataFrame, eras: Sequence[tuple[int, str]] = ERAS, last: str = LAST_ERA, date: str = "start_date"
) -> DataFrame:
    """Number of releases and degraded share per era."""
    return (
        df.groupBy(S.era_of(F.year(date), eras, last).alias("period"))
        .agg(F.count(F.lit(1)).alias("n"), (F.avg("is_degraded") * 100).alias("pct_degraded"))
    )
