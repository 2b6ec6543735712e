"""Pair counts within groups and within a sliding time distance, with hot groups spread over many tasks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from releaselens.functions.scalars import MICROS_PER_DAY
from releaselens.operators.intervals import attach_slot, interval_slots
from releaselens.session import materialize, materialize_in, materialize_with

TILE_ROWS = 4096
# Pairs that a task adds up at most, on average.
TASK_PAIRS = 1 << 21
# Groups of keys that are counted before single ones.
KEYS = 1 << 17
# Windows to a bucket of the self-join.
WINDOWS = 3


def tiled(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: Sequence[str], right_id: Sequence[str], tile: int
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Prepare an equi-join on ``keys`` so that no task holds more than about tile x tile candidate pairs.

    A key with more than ``tile`` rows on a side becomes a grid: each side's rows are hashed to grid lines
    and copied along the other axis, so each pair of rows still meets exactly once. Other keys stay as they
    are. Returns both sides and the join columns.
    """
    one, none = F.lit(1), F.lit(0)
    sides = left.select(*keys, one.alias("l"), none.alias("r")).unionByName(
        right.select(*keys, none.alias("l"), one.alias("r"))
    )
    hot = (
        sides.groupBy(*keys)
        .agg(F.ceil(F.sum("l") / tile).cast("int").alias("_rows"), F.ceil(F.sum("r") / tile).cast("int").alias("_cols"))
        .filter((F.col("_rows") > 1) | (F.col("_cols") > 1))
    )
    hot, seen = materialize_with(hot, hot=F.count(F.lit(1)))
    if not seen["hot"]:
        return left, right, list(keys)
    rows, cols = F.greatest(F.coalesce("_rows", one), one), F.greatest(F.coalesce("_cols", one), one)

    def place(df, ids, own, own_count, other, other_count):
        placed = df.join(hot, list(keys), "left").withColumn(own, F.pmod(F.xxhash64(*ids), own_count))
        return placed.withColumn(other, F.explode(F.sequence(none, other_count - 1))).drop("_rows", "_cols")

    return (
        place(left, left_id, "_row", rows, "_col", cols),
        place(right, right_id, "_col", cols, "_row", rows),
        [*keys, "_row", "_col"],
    )


def _pair_counts(items: DataFrame, group: str, item: str, out: tuple[str, str, str], tile: int) -> DataFrame:
    """Pairs a < b of a group's distinct items, weighted by the product of their counts ``n``.

    Tasks are as many as the pairs need, ``TASK_PAIRS`` each, so their memory does not grow with the table.
    """
    met = items.groupBy(group).agg(F.count(F.lit(1)).cast("double").alias("k"))
    seen = met.agg(F.sum(F.expr("k * (k - 1) / 2")).alias("pairs"), F.max("k").alias("most")).first()
    a = items.select(group, F.col(item).alias("a"), F.col("n").alias("na"))
    b = items.select(group, F.col(item).alias("b"), F.col("n").alias("nb"))
    on = [group]
    if (seen["most"] or 0) > tile:
        a, b, on = tiled(a, b, on, ["a"], ["b"], tile)
    pairs = (
        a.join(b, on)
        .filter(F.col("a") < F.col("b"))
        .groupBy(F.col("a").alias(out[0]), F.col("b").alias(out[1]))
        .agg(F.sum(F.col("na") * F.col("nb")).alias(out[2]))
    )
    return materialize_in(pairs, math.ceil((seen["pairs"] or 0) / TASK_PAIRS))


def developer_pairs(touches: DataFrame, file: str = "file", author: str = "author", tile: int = TILE_ROWS):
    """Unordered author pairs and the number of files both touched."""
    authors = touches.filter(F.col(author).isNotNull()).select(file, author).distinct()
    authors = materialize(authors.withColumn("n", F.lit(1).cast("bigint")))
    return _pair_counts(authors, file, author, ("developer1", "developer2", "shared_files"), tile)


def file_coupling(baskets: DataFrame, basket: str = "commit_hash", item: str = "file", tile: int = TILE_ROWS):
    """Unordered item pairs and how often they share a basket, over rows of (basket, item).

    A name that repeats inside a basket also pairs with itself.
    """
    names = baskets.filter(F.col(item).isNotNull()).groupBy(basket, item).agg(F.count(F.lit(1)).alias("n"))
    names = materialize(names)
    out = ("file1", "file2", "cochange_count")
    repeated = (
        names.filter(F.col("n") > 1)
        .groupBy(F.col(item).alias(out[0]))
        .agg(F.sum(F.expr("n * (n - 1) div 2")).alias(out[2]))
        .select(out[0], F.col(out[0]).alias(out[1]), out[2])
    )
    return _pair_counts(names, basket, item, out, tile).unionByName(repeated)


def top_pairs(pairs: DataFrame, measure: str, ties: Sequence[str], n: int = 10) -> DataFrame:
    """The ``n`` pairs with the largest measure."""
    return pairs.orderBy(F.col(measure).desc(), *ties).limit(n)


def _bucket(us: Column, width: int) -> Column:
    return F.floor(us / F.lit(WINDOWS * width)).cast("bigint")


def cocommit_graph(
    touches: DataFrame, releases: DataFrame, window_days: int = 7, tile: int = TILE_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Nodes (release, node) and edges (release, a, b, weight) of the developers active in each release.

    An edge counts the pairs of touches of one file by two authors within ``window_days``, both inside the
    release. The temporal self-join runs once over all touches, not per release; its counts per pair of
    time slots are then added up for every release that covers both slots.
    """
    slots, members = interval_slots(releases, ["release"], "start_date", "end_date")
    width = window_days * MICROS_PER_DAY
    work = materialize(
        attach_slot(touches.filter(F.col("author").isNotNull()), slots, "date")
        .groupBy("file", "author", "us", "slot")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("bucket", _bucket(F.col("us"), width))
    )
    nodes = (
        work.select("slot", "author").distinct().join(members, "slot").select("release", F.col("author").alias("node"))
    ).distinct()

    # Two touches within the window lie in the same bucket or in neighbouring ones: the right side is
    # offered to its own bucket and, where the window reaches it, to the next.
    # They meet by one hash of both keys, which sorts faster than texts; what only shares the hash is left out after.
    named = work.where(F.col("file").isNotNull())
    left = named.select("file", "bucket", *[F.col(c).alias(f"l_{c}") for c in ("author", "us", "slot", "n")])
    right = named.select(
        F.col("file").alias("r_file"),
        F.explode(F.sequence(F.col("bucket"), _bucket(F.col("us") + width, width))).alias("r_bucket"),
        "bucket",
        *[F.col(c).alias(f"r_{c}") for c in ("author", "us", "slot", "n")],
    )
    right = right.withColumn("home", F.col("r_bucket") == F.col("bucket")).drop("bucket")
    left = left.withColumn("met", F.xxhash64("file", "bucket"))
    right = right.withColumn("met", F.xxhash64("r_file", "r_bucket"))
    on = ["met"]
    met = F.xxhash64("file", "bucket")
    # counts of many keys together bound those of each, and mostly suffice
    for key in (F.pmod(met, F.lit(KEYS)), met):
        most = named.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if 2 * most <= tile:
            break
    else:  # a key of the right side has the rows of two buckets
        left, right, on = tiled(left, right, on, ["l_author", "l_us"], ["r_author", "r_us"], tile)
    once = F.when(F.col("home"), F.col("l_author") < F.col("r_author")).otherwise(
        F.col("l_author") != F.col("r_author")
    )
    close = F.abs(F.col("l_us") - F.col("r_us")) <= width
    same = (F.col("file") == F.col("r_file")) & (F.col("bucket") == F.col("r_bucket"))
    pairs = (
        left.join(right, on)
        .filter(same & once & close)
        .groupBy(
            F.least("l_author", "r_author").alias("a"),
            F.greatest("l_author", "r_author").alias("b"),
            F.least("l_slot", "r_slot").alias("slot"),
            F.greatest("l_slot", "r_slot").alias("last_slot"),
        )
        .agg(F.sum(F.col("l_n") * F.col("r_n")).alias("weight"))
    )
    edges = (
        pairs.join(members, "slot")
        .filter(F.col("last_slot") < F.col("until"))
        .groupBy("release", "a", "b")
        .agg(F.sum("weight").alias("weight"))
    )
    return nodes, edges


def cocommit_edges(touches: DataFrame, releases: DataFrame, window_days: int = 7, tile: int = TILE_ROWS) -> DataFrame:
    return cocommit_graph(touches, releases, window_days, tile)[1]
