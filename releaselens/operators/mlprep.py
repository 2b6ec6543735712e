"""Leak-free preparation of time-ordered samples: selection, imputation, scaling, splits and folds.

Fitted parameters are small tables with one row per feature; applying them reads those rows and adds plain
column expressions, so the data itself is scanned once and never joined.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from releaselens.functions import scalars as S
from releaselens.operators.ordering import exact_quantiles, running_totals, with_position
from releaselens.operators.quality import by_feature, numeric_columns

# Columns that are not features, the column the label is derived from, the features of each kind and the
# words that feature names are grouped by.
METADATA = ("release", "start_date", "end_date")
NOT_FEATURES = ("velocity_change", "prev_weighted_velocity")
LEAKY = ("velocity_change_pct",)
CHURN_FEATURES = (
    "total_commits",
    "total_churn",
    "churn_concentration",
    "developer_churn_inequality",
    "refactoring_ratio",
    "file_hotspots",
    "avg_commit_size",
    "churn_volatility",
    "unique_developers",
    "avg_files_per_commit",
    "commits_per_day",
    "churn_per_developer",
)
NETWORK_STATIC = (
    "num_nodes",
    "num_edges",
    "density",
    "avg_clustering",
    "diameter",
    "num_components",
    "giant_component_size",
    "avg_degree",
    "max_betweenness",
    "degree_centralization",
    "avg_closeness",
)
NETWORK_CHANGE = (
    "network_jaccard",
    "nodes_added",
    "nodes_removed",
    "density_change",
    "centralization_change",
    "turnover_rate",
    "edges_per_node",
)
KINDS = {"churn": CHURN_FEATURES, "network_change": NETWORK_CHANGE, "network_static": NETWORK_STATIC}
FEATURE_WORDS = {
    "velocity": ("velocity", "issue", "bug", "improvement", "feature", "task"),
    "churn": ("churn", "commit", "refactor", "hotspot", "developer"),
    "network": (
        "node",
        "edge",
        "density",
        "cluster",
        "central",
        "diameter",
        "component",
        "jaccard",
        "turnover",
    ),
}


def feature_select(
    df: DataFrame,
    target: str = "is_degraded",
    metadata: Sequence[str] = METADATA,
    leak: Sequence[str] = NOT_FEATURES,
) -> list[str]:
    """Names of the numeric columns that may serve as features."""
    drop = {target, *metadata, *leak}
    return [c for c in numeric_columns(df) if c not in drop and "date" not in c.lower()]


def feature_subsets(
    cols: Sequence[str],
    groups: Mapping[str, Sequence[str]] | None = None,
    leak: Sequence[str] = LEAKY,
    combined: str = "C_combined",
) -> dict[str, list[str]]:
    """Named feature lists: each group's available columns, and all safe ones."""
    groups = groups or {"A_churn": CHURN_FEATURES, "B_network": (*NETWORK_STATIC, *NETWORK_CHANGE)}
    safe = [c for c in cols if c not in leak]
    out = {name: [c for c in members if c in safe] for name, members in groups.items()}
    out[combined] = safe
    return out


def feature_groups(features: DataFrame, name: str = "feature") -> DataFrame:
    """Tag feature names with the word groups they mention (a name may be in several) and their kind."""
    col = F.col(name)
    return features.withColumns(
        {f"is_{g}": S.mentions(col, words) for g, words in FEATURE_WORDS.items()}
        | {"kind": S.group_of(col, KINDS, "velocity/context")}
    )


def fit_medians(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact median per feature: (feature, median)."""
    return exact_quantiles(by_feature(train, cols), "value", {"median": 0.5}, ["feature"])


def _params(table: DataFrame, *names: str) -> dict[str, tuple]:
    """Read a fitted table: one row per feature."""
    return {r["feature"]: tuple(r[n] for n in names) for r in table.select("feature", *names).collect()}


def impute(df: DataFrame, medians: DataFrame) -> DataFrame:
    fill = {c: m for c, (m,) in _params(medians, "median").items() if m is not None}
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in fill.items()})


def impute_median(train: DataFrame, *others: DataFrame, cols: Sequence[str]) -> list[DataFrame]:
    """Fill gaps in all tables with the medians of the training table."""
    medians = fit_medians(train, cols)
    return [impute(df, medians) for df in (train, *others)]


def fit_standard(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean and population deviation per feature: (feature, center, scale); a constant's scale is 1."""
    scale = F.stddev_pop("value")
    return (
        by_feature(train, cols)
        .groupBy("feature")
        .agg(F.avg("value").alias("center"), F.when(scale > 0, scale).otherwise(1.0).alias("scale"))
    )


def fit_robust(train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Median and interquartile range per feature: (feature, center, scale); a zero range scales by 1."""
    q = exact_quantiles(by_feature(train, cols), "value", {"low": 0.25, "center": 0.5, "high": 0.75}, ["feature"])
    width = F.col("high") - F.col("low")
    return q.select("feature", "center", F.when(width > 0, width).otherwise(1.0).alias("scale"))


def scale(df: DataFrame, params: DataFrame) -> DataFrame:
    fitted = _params(params, "center", "scale")
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in fitted.items() if m is not None})


def scale_standard(train: DataFrame, *others: DataFrame, cols: Sequence[str]) -> list[DataFrame]:
    params = fit_standard(train, cols)
    return [scale(df, params) for df in (train, *others)]


def scale_robust(train: DataFrame, *others: DataFrame, cols: Sequence[str]) -> list[DataFrame]:
    params = fit_robust(train, cols)
    return [scale(df, params) for df in (train, *others)]


def temporal_split(df: DataFrame, order: Sequence[Column | str], test: float = 0.15, val: float = 0.15) -> DataFrame:
    """Add ``pos`` (from 1) and ``split``: the last rows are test, those before validation, the rest train."""
    rows = running_totals(df, order, before="pos", total="_n")
    tests, vals = F.floor(F.col("_n") * test), F.floor(F.col("_n") * val)
    split = (
        F.when(F.col("pos") >= F.col("_n") - tests, "test")
        .when(F.col("pos") >= F.col("_n") - tests - vals, "val")
        .otherwise("train")
    )
    return rows.withColumn("split", split).withColumn("pos", F.col("pos") + 1).drop("_n")


def cv_folds(train: DataFrame, order: Sequence[Column | str], k: int = 5) -> DataFrame:
    """Expanding-window folds: every row once per fold it serves in, with ``fold`` and ``role``."""
    rows = running_totals(train, order, before="_at", total="_n")
    size = F.floor(F.col("_n") / (k + 1))
    roles = []
    for fold in range(1, k + 1):
        first = F.col("_n") - (k - fold + 1) * size
        role = F.when(F.col("_at") < first, "train").when(F.col("_at") < first + size, "valid")
        roles.append(F.struct(F.lit(fold).alias("fold"), role.alias("role")))
    used = F.filter(F.array(*roles), lambda r: r["role"].isNotNull())
    return rows.withColumn("_r", F.explode(used)).select(*train.columns, "_r.fold", "_r.role")


def fold_sizes(masked: DataFrame, k: int = 5) -> DataFrame:
    """(fold, train, valid): how many rows of ``fold_masks`` each fold trains and is scored on, in one pass."""
    folds = F.array(
        *[
            F.struct(
                F.lit(fold).alias("fold"),
                F.count_if(F.col("trains").bitwiseAND(1 << fold) != 0).alias("train"),
                F.count_if(F.col("holds").bitwiseAND(1 << fold) != 0).alias("valid"),
            )
            for fold in range(1, k + 1)
        ]
    )
    return masked.agg(folds.alias("folds")).select(F.inline("folds"))


def fold_masks(split: DataFrame, order: Sequence[Column | str], k: int = 5) -> DataFrame:
    """Add two bit masks to the rows of a temporal split: no row is copied for the folds of ``cv_folds``.

    ``trains``: bit 0 for the training part, bit f for rows that train fold f. ``holds``: bit 0 for validation and test rows, bit f
    for rows that fold f is scored on.
    """
    train = F.col("split") == "train"
    rows = running_totals(split.where(train), order, before="_at", total="_n")
    size, trains, holds = F.floor(F.col("_n") / (k + 1)), F.lit(1), F.lit(0)
    for fold in range(1, k + 1):
        first = F.col("_n") - (k - fold + 1) * size
        trains += F.when(F.col("_at") < first, 1 << fold).otherwise(0)
        holds += F.when((F.col("_at") >= first) & (F.col("_at") < first + size), 1 << fold).otherwise(0)
    rows = rows.select(*split.columns, trains.alias("trains"), holds.alias("holds"))
    return rows.unionByName(split.where(~train).select("*", F.lit(0).alias("trains"), F.lit(1).alias("holds")))


def undersample(df: DataFrame, label: str = "label", seed: int = 42, id: str = "id") -> DataFrame:
    """Keep as many rows of every class as the smallest class has, in the order of md5 of id and seed."""
    least = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n"))
    drawn = with_position(df.withColumn("_draw", F.md5(F.concat(F.col(id).cast("string"), F.lit(f":{seed}")))), ["_draw", id], [label], "_pos")
    return drawn.filter(F.col("_pos") <= least.scalar()).select(*df.columns)


def preparation_summary(split: DataFrame, y: str, n_features: int, scaling: str, balancing: str) -> DataFrame:
    """One row: sizes and positive share per split, and the methods used."""
    parts = ("train", "val", "test")

    def of(part):
        return F.col("split") == part

    return split.agg(
        F.lit(n_features).cast("bigint").alias("n_features"),
        *[F.count_if(of(p)).alias(f"n_{p}") for p in parts],
        *[(F.avg(F.when(of(p), F.col(y))) * 100).alias(f"{p}_degraded_pct") for p in parts],
        F.lit(scaling).alias("scaling_method"),
        F.lit(balancing).alias("balancing_method"),
    )


def prepared_checks(split: DataFrame, cols: Sequence[str], order: str) -> DataFrame:
    """Per split: rows, features off mean 0 or deviation 1, missing and infinite cells, constant features,
    and whether the split starts no earlier than the one before it ends."""
    cells = by_feature(split, cols, ["split"]).groupBy("split", "feature").agg(
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.count_if(F.col("value").isNull()).alias("missing"),
        F.count_if(F.abs("value") == F.lit(float("inf"))).alias("infinite"),
    )
    per_split = cells.groupBy("split").agg(
        F.count_if(F.abs("mean") > 0.01).alias("mean_off"),
        F.count_if((F.col("std") < 0.9) | (F.col("std") > 1.1)).alias("std_off"),
        F.sum("missing").alias("missing"),
        F.sum("infinite").alias("infinite"),
        F.count_if(F.col("std") == 0).alias("zero_variance"),
    )
    step = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).otherwise(2)
    spans = split.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.min(order).alias("first"), F.max(order).alias("last")
    )
    spans = spans.withColumn("step", step)
    ends = spans.select((F.col("step") + 1).alias("step"), F.col("last").alias("prior"))
    ordered = spans.join(ends, "step", "left").select(
        "split", "rows", F.coalesce(F.col("first") >= F.col("prior"), F.lit(True)).alias("in_order")
    )
    return ordered.join(per_split, "split")
