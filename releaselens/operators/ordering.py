"""Ranks, positions, lags and exact quantiles over a whole ordered table.

A window without partitions, or one partitioned by a hot key, runs in a single task. These operators
range-partition the rows instead, number them inside each range, and add the totals of the ranges before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from releaselens.session import materialize


def running_totals(
    df: DataFrame,
    order: Sequence[Column | str],
    weight: Column | None = None,
    by: Sequence[str] = (),
    before: str = "before",
    total: str | None = None,
) -> DataFrame:
    """Add the sum of ``weight`` over all earlier rows of the group and, on request, the group's total.

    ``order`` must be unique within a group. A group may span any number of partitions.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order]
    weight = F.lit(1).cast("bigint") if weight is None else weight
    ranged = (
        df.withColumn("_w", weight)
        .repartitionByRange(*[F.col(c) for c in by], *order)
        .withColumn("_range", F.spark_partition_id())
    )
    rows = materialize(ranged)

    # At most one row per (group, range): the number of ranges bounds each of these windows.
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    sums = rows.groupBy(*by, "_range").agg(F.sum("_w").alias("_sum"))
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *[F.col(c).alias(f"_{c}") for c in by],
        F.col("_range").alias("_at"),
        F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_sum").over(group).alias("_total"),
    )

    inside = Window.partitionBy("_range", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    same = local["_range"] == offsets["_at"]
    for c in by:
        same = same & local[c].eqNullSafe(offsets[f"_{c}"])
    out = [F.col(c) for c in df.columns] + [(F.col("_local") + F.col("_offset")).alias(before)]
    if total:
        out.append(F.col("_total").alias(total))
    return local.join(offsets, same).select(*out)


def with_position(df: DataFrame, order: Sequence[Column | str], by: Sequence[str] = (), out: str = "pos") -> DataFrame:
    """Number the rows of each group from 1 in a unique order."""
    return running_totals(df, order, by=by, before=out).withColumn(out, F.col(out) + 1)


def previous_rows(positioned: DataFrame, cols: Sequence[str], back: int, pos: str = "pos", by: Sequence[str] = ()):
    """Each row's values copied to the ``back`` positions after it, as (by, pos, _lag, cols...)."""
    return positioned.select(
        *by, *cols, F.col(pos).alias("_p"), F.explode(F.sequence(F.lit(1), F.lit(back))).alias("_lag")
    ).select(*by, (F.col("_p") + F.col("_lag")).alias(pos), "_lag", *cols)


def tie_ranks(df: DataFrame, value: str, by: Sequence[str] = (), copies: Column | None = None) -> DataFrame:
    """One row per distinct value with its count, the mean rank its copies share, and the group's size."""
    n = F.count(F.lit(1)) if copies is None else F.sum(copies)
    counts = df.groupBy(*by, value).agg(n.alias("ties"))
    ranked = running_totals(counts, [value], F.col("ties"), by, total="total")
    return ranked.withColumn("rank", F.col("before") + (F.col("ties") + 1) / 2).drop("before")


def value_counts_in_order(
    df: DataFrame, value: str, by: Sequence[str] = (), copies: Column | None = None
) -> DataFrame:
    """(by, value, n, before, total): how often each value occurs and how many rows sort before it.

    ``copies`` counts rows that were already grouped.
    """
    n = F.count(F.lit(1)) if copies is None else F.sum(copies)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(n.alias("n"))
    return running_totals(counts, [value], F.col("n"), by, total="total")


def quantiles_of_counts(counts: DataFrame, value: str, quantiles: dict[str, float], by: Sequence[str] = ()):
    """Exact linearly interpolated quantiles from ``value_counts_in_order``."""
    aggs = []
    for name, q in quantiles.items():
        target = (F.col("total") - 1) * F.lit(float(q))
        for side, at in (("lo", F.floor(target)), ("hi", F.ceil(target))):
            hit = (F.col("before") <= at) & (at < F.col("before") + F.col("n"))
            aggs.append(F.max(F.when(hit, F.col(value).cast("double"))).alias(f"_{name}_{side}"))
        aggs.append(F.max(target - F.floor(target)).alias(f"_{name}_part"))
    picked = counts.groupBy(*by).agg(*aggs)
    return picked.select(
        *by,
        *[
            (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_part")).alias(n)
            for n in quantiles
        ],
    )


def exact_quantiles(df: DataFrame, value: str, quantiles: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles per group; no group's values meet in one task."""
    return quantiles_of_counts(value_counts_in_order(df, value, by), value, quantiles, by)


def gini_of_counts(counts: DataFrame, value: str, by: Sequence[str] = (), out: str = "gini") -> DataFrame:
    """Gini coefficient from ``value_counts_in_order``: equal values take consecutive ranks.

    One division of sums, which are whole for whole values: equal coefficients are equal numbers, whatever the group's size.
    """
    x, n = F.col(value).cast("double"), F.col("n").cast("double")
    rank_sum = n * F.col("before") + n * (n + 1) / 2
    parts = counts.groupBy(*by).agg(
        F.sum(x * rank_sum).alias("_ranked"), F.sum(x * n).alias("_sum"), F.sum(n).alias("_n")
    )
    over = 2 * F.col("_ranked") - (F.col("_n") + 1) * F.col("_sum")
    gini = F.try_divide(over, F.col("_n") * F.col("_sum"))
    return parts.select(*by, F.when(F.col("_sum") == 0, 0.0).otherwise(F.coalesce(gini, F.lit(0.0))).alias(out))


def gini_by_group(df: DataFrame, by: Sequence[str], value: str, out: str = "gini") -> DataFrame:
    """Gini coefficient of a non-negative value per group; 0 when the values sum to 0."""
    return gini_of_counts(value_counts_in_order(df, value, by), value, by, out)
