"""Breadth-first searches from many sources over many graphs, as joins with wide rows.

A row holds one node's state for a whole block of sources: one bit per source for reachability (Then et al.,
"The More the Merrier", VLDB 2014), or one column per source for path counts. A level is one join with the
arcs and one aggregation, however many sources there are. Each level is a table of its own that lists only
the nodes first reached there: in an undirected graph the neighbours of a level lie in it, before it or after
it, so two tables tell which of them are new.

Components of no more than ``LOCAL_ARCS`` arcs are searched inside tasks instead, from blocks of ``SEATS`` sources each
(``distances_in_tasks``, ``loads_in_tasks``): Spark deals out components and blocks, so no level needs a job.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from releaselens.session import materialize, materialize_with, scratch_path

WORDS = 16
BLOCK = 64 * WORDS
LANES = 8
LOCAL_ARCS, SEATS = 1 << 20, 1024
# Components with no more arcs than this share a task's group, of about BIN arcs.
TINY, BIN = 256, 1 << 14
# Numbers that one step of a search inside a task gathers.
STEP = 1 << 20
# Neighbours of a node that are added one rank after the other.
RANKS = 64


def _levels(folder: str, like: DataFrame) -> DataFrame:
    """All level tables of a folder, with the column ``level``."""
    schema = T.StructType([*like.schema.fields, T.StructField("level", T.IntegerType())])
    return like.sparkSession.read.schema(schema).parquet(folder)


def reach(arcs: DataFrame, sources: DataFrame) -> DataFrame:
    """Search from ``sources`` (release, node, block, bit) with bit < BLOCK unique in its block.

    Returns one row per (release, block, node) reached, with ``distance``, the sum of its distances to the
    block's sources, and ``depth``, the largest of them.
    """
    key = ["release", "block", "node"]
    words = range(WORDS)
    folder = scratch_path(arcs.sparkSession)
    seeds = sources.selectExpr(*key, *[f"IF(bit div 64 = {w}, shiftleft(1L, bit % 64), 0L) AS m{w}" for w in words])
    layer, seen = materialize_with(seeds, f"{folder}/level=0", n=F.count(F.lit(1)))
    before, level = None, 0
    while seen["n"]:
        level += 1
        fresh = (
            layer.join(arcs, ["release", "node"])
            .groupBy("release", "block", F.col("other").alias("node"))
            .agg(*[F.bit_or(f"m{w}").alias(f"m{w}") for w in words])
        )
        for known in (layer, before):
            if known is not None:
                old = known.selectExpr(*key, *[f"m{w} AS k{w}" for w in words])
                fresh = fresh.join(old, key, "left").selectExpr(
                    *key, *[f"m{w} & ~coalesce(k{w}, 0L) AS m{w}" for w in words]
                )
        fresh = fresh.filter(" OR ".join(f"m{w} <> 0" for w in words))
        before = layer
        layer, seen = materialize_with(fresh, f"{folder}/level={level}", n=F.count(F.lit(1)))
    found = " + ".join(f"bit_count(m{w})" for w in words)
    return (
        _levels(folder, layer)
        .groupBy(*key)
        .agg(F.expr(f"sum(level * CAST({found} AS BIGINT)) AS distance"), F.expr("max(level) AS depth"))
    )


def shortest_path_loads(arcs: DataFrame, sources: DataFrame) -> DataFrame:
    """Dependency of all shortest paths from ``sources`` (release, node, seat) on each node.

    Brandes' accumulation level by level: path counts grow outward, dependencies flow back. Returns
    (release, node, load) with load summed over the sources.
    """
    arcs = materialize(arcs)
    key = ["release", "lane", "node"]
    lanes = range(LANES)

    def gather(rows: DataFrame, value: str) -> DataFrame:
        """Sum over the neighbours of ``value`` where a lane has paths."""
        return (
            rows.selectExpr(*key, *[f"IF(p{j} > 0, {value.format(j=j)}, 0D) AS in{j}" for j in lanes])
            .join(arcs, ["release", "node"])
            .groupBy("release", "lane", F.col("other").alias("node"))
            .agg(*[F.sum(f"in{j}").alias(f"in{j}") for j in lanes])
        )

    seeds = sources.selectExpr(
        "release", f"seat div {LANES} AS lane", "node", *[f"IF(seat % {LANES} = {j}, 1D, 0D) AS p{j}" for j in lanes]
    )
    layer, seen = materialize_with(seeds, n=F.count(F.lit(1)))
    layers = [layer]
    while seen["n"]:
        fresh = gather(layers[-1], "p{j}").selectExpr(*key, *[f"in{j} AS p{j}" for j in lanes])
        for known in layers[-2:]:
            old = known.selectExpr(*key, *[f"p{j} AS k{j}" for j in lanes])
            fresh = fresh.join(old, key, "left").selectExpr(
                *key, *[f"IF(coalesce(k{j}, 0D) > 0, 0D, p{j}) AS p{j}" for j in lanes]
            )
        fresh = fresh.filter(" OR ".join(f"p{j} > 0" for j in lanes))
        layer, seen = materialize_with(fresh, n=F.count(F.lit(1)))
        layers.append(layer)

    folder = scratch_path(arcs.sparkSession)
    last = len(layers) - 1
    loaded = materialize(
        layers[last].selectExpr("*", *[f"0D AS t{j}" for j in lanes]), f"{folder}/level={last}"
    )
    for level in range(last - 1, 0, -1):
        owed = gather(loaded, "(1D + t{j}) / p{j}")
        loaded = materialize(
            layers[level].join(owed, key, "left").selectExpr(
                *key,
                *[f"p{j}" for j in lanes],
                *[f"IF(p{j} > 0, p{j} * coalesce(in{j}, 0D), 0D) AS t{j}" for j in lanes],
            ),
            f"{folder}/level={level}",
        )
    total = " + ".join(f"t{j}" for j in lanes)
    return _levels(folder, loaded).groupBy("release", "node").agg(F.expr(f"sum({total}) AS load"))


def _in_tasks(arcs: DataFrame, sources: DataFrame, search: Callable, schema: str) -> DataFrame:
    """Apply ``search`` to the arcs (comp, id, other) of whole components and some of their ``sources`` (comp, id).

    A group holds one component and up to about ``SEATS`` of its sources, or several tiny components. Searches of
    different components never meet, so they share lanes: a lane carries one source of each component.
    """
    counted = arcs.groupBy("comp").agg(F.count(F.lit(1)).alias("arcs"))
    seats = sources.groupBy("comp").agg(F.count(F.lit(1)).alias("seats"))
    few = F.col("arcs") <= TINY
    sizes, seen = materialize_with(counted.join(seats, "comp"), tiny=F.sum(F.when(few, F.col("arcs"))))
    bins = -(-(seen["tiny"] or 0) // BIN) or 1
    sizes = sizes.withColumn("blocks", F.ceil(F.col("seats") / SEATS).cast("int"))
    block = F.when(few, F.pmod(F.xxhash64("comp"), F.lit(bins))).otherwise(F.xxhash64("comp", "block")).alias("part")
    dealt = arcs.join(sizes, "comp").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    seated = sources.join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = dealt.select(block, "comp", "id", "other").unionByName(
        seated.select(block, "comp", "id", F.lit(None).cast("bigint").alias("other"))
    )

    def run(table: pa.Table) -> pa.Table:
        comp, at = table["comp"].to_numpy(), table["id"].to_numpy()
        to = table["other"].fill_null(-1).to_numpy()
        arc = to >= 0
        ids, node = np.unique(at[arc], return_inverse=True)
        order = np.argsort(node, kind="stable")
        starts = np.searchsorted(node[order], np.arange(len(ids)))
        other = np.searchsorted(ids, to[arc][order])
        source = np.searchsorted(ids, at[~arc])
        by_comp = np.argsort(comp[~arc], kind="stable")
        source, own = source[by_comp], comp[~arc][by_comp]
        seat = np.arange(len(own)) - np.searchsorted(own, own)
        return search(ids, starts, other, source, seat)

    return rows.groupBy("part").applyInArrow(run, schema)


def distances_in_tasks(arcs: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, distance, depth): the sum of each node's distances to its component's sources, and the largest of them."""

    def search(ids, starts, other, source, seat):
        lanes = int(seat.max(initial=-1)) + 1
        width = 64 * max(1, STEP // max(1, len(other)))
        distance, depth = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int32)
        for first in range(0, lanes, width):
            some = (seat >= first) & (seat < first + width)
            lane = seat[some] - first
            seen = np.zeros((len(ids), -(-min(width, lanes - first) // 64)), np.uint64)
            seen[source[some], lane // 64] |= np.uint64(1) << (lane % 64).astype(np.uint64)
            layer, level = seen, 0
            while len(other):
                layer = np.bitwise_or.reduceat(layer.take(other, axis=0), starts, axis=0) & ~seen
                found = np.bitwise_count(layer).sum(1, dtype=np.int64)
                if not found.any():
                    break
                level += 1
                seen = seen | layer
                distance += level * found
                np.maximum(depth, np.where(found > 0, level, 0), out=depth, casting="unsafe")
        return pa.table({"id": ids, "distance": distance, "depth": depth})

    found = _in_tasks(arcs, sources, search, "id long, distance long, depth int")
    return found.groupBy("id").agg(F.sum("distance").alias("distance"), F.max("depth").alias("depth"))


def _sums_over_neighbours(starts: np.ndarray, other: np.ndarray) -> tuple[Callable, np.ndarray]:
    """A function that adds up the neighbours' rows, over nodes by falling degree, and each node's place in that order.

    The first ``RANKS`` neighbours of all nodes are added rank by rank, the others of well connected nodes at once.
    """
    degree = np.diff(np.append(starts, len(other)))
    order = np.argsort(-degree, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    other, starts, degree = place[other], starts[order], degree[order]
    ranks = [other[starts[degree > k] + k] for k in range(min(RANKS, int(degree.max(initial=0))))]
    many = degree > RANKS
    if many.any():
        sizes = degree[many] - RANKS
        begin = np.cumsum(sizes) - sizes
        rest = other[np.repeat(starts[many] + RANKS - begin, sizes) + np.arange(sizes.sum())]

    def gather(rows: np.ndarray) -> np.ndarray:
        out = np.zeros_like(rows)
        for to in ranks:
            out[: len(to)] += rows.take(to, axis=0)
        if many.any():
            out[: len(begin)] += np.add.reduceat(rows.take(rest, axis=0), begin, axis=0)
        return out

    return gather, place


def loads_in_tasks(arcs: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, load): dependency of all shortest paths from the sources on each node, as in ``shortest_path_loads``."""

    def search(ids, starts, other, source, seat):
        lanes = int(seat.max(initial=-1)) + 1
        width = min(128, max(8, STEP // 8 // max(1, len(ids))))
        gather, place = _sums_over_neighbours(starts, other)
        source = place[source]
        load = np.zeros(len(ids))
        for first in range(0, lanes, width):
            some = (seat >= first) & (seat < first + width)
            paths = np.zeros((len(ids), min(width, lanes - first)))
            paths[source[some], seat[some] - first] = 1.0
            layer, fronts = paths, [paths > 0]
            unseen = ~fronts[0]
            while True:
                layer = gather(layer)
                layer *= unseen
                fresh = layer > 0
                if not fresh.any():
                    break
                fronts.append(fresh)
                unseen &= ~fresh
                paths = paths + layer
            per_path = np.divide(1.0, paths, out=np.zeros_like(paths), where=paths > 0)
            owed = np.zeros_like(paths)
            for at in range(len(fronts) - 1, 1, -1):
                share = (1.0 + owed) * per_path
                share *= fronts[at]
                back = gather(share)
                back *= paths
                back *= fronts[at - 1]
                owed += back
            load += owed.sum(1)
        return pa.table({"id": ids, "load": load[place]})

    return _in_tasks(arcs, sources, search, "id long, load double").groupBy("id").agg(F.sum("load").alias("load"))
