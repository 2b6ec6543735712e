"""Measures of graphs that each fit one task: numbered and cut into components there, searched in blocks of sources.

``pack`` reads the nodes and edges of a release in one task, which numbers the nodes by name, labels the components, counts
degrees and triangles, and writes each component with edges as one row of packed neighbour lists. ``search`` copies such a
row for each block of ``SEATS`` sources, so a component's searches spread over tasks whatever its size. Graphs of more than
``GRAPH_EDGES`` edges, or with a component of more than ``local`` arcs, are left to the searches over joins.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from releaselens.functions import scalars as S
from releaselens.operators import traversal
from releaselens.session import materialize, materialize_with

GRAPH_EDGES = 1 << 21
#: Arcs times sources of the searches that one task holds, on average.
TASK_VISITS = 1 << 29
#: Wedges that are looked up at once.
WEDGES = 1 << 21

_SHAPE = "fits boolean, num_nodes long, num_edges long, comps long, size long, degrees long, gini double, triples long"
_PART = "part int, giant boolean, arcs long, lanes int, seat binary, starts binary, other binary"
_FOUND = "part int, block int, blocks int, depth int, most double, near long, load binary, distance binary"
_DONE = "part int, depth int, most double, near long"


@dataclass(frozen=True)
class Packed:
    """One row a release in ``shapes``, one a component with edges (or several tiny ones) in ``parts``.

    ``nodes`` and ``edges`` are those of the releases that do not fit, None if all do.
    """

    shapes: DataFrame
    parts: DataFrame
    nodes: DataFrame | None = None
    edges: DataFrame | None = None


def _schema(nodes: DataFrame, ddl: str) -> T.StructType:
    return T.StructType([nodes.schema["release"], *T._parse_datatype_string(ddl).fields])


def smallest_linked(n: int, other: np.ndarray, degree: np.ndarray) -> np.ndarray:
    """Smallest number of each node's component, from neighbour lists laid end to end (hooks and shortcuts by turns)."""
    label, linked = np.arange(n, dtype=np.int32), np.flatnonzero(degree)
    if not len(linked):
        return label
    starts = (np.cumsum(degree) - degree)[linked]
    while True:
        old, label = label, label[label]
        near = np.minimum.reduceat(label[other], starts)
        np.minimum.at(label, old[linked], near)
        label[linked] = np.minimum(label[linked], near)
        if (label == old).all():
            return label


def triangles(n: int, a: np.ndarray, b: np.ndarray, degree: np.ndarray) -> np.ndarray:
    """Triangles of each node: every edge points to its better connected end, each pair of a node's arcs looks for the third."""
    swap = (degree[a] > degree[b]) | ((degree[a] == degree[b]) & (a > b))
    low, high = np.where(swap, b, a).astype(np.int64), np.where(swap, a, b).astype(np.int64)
    order = np.lexsort((high, low))
    low, high = low[order], high[order]
    keys = low * n + high
    # the arcs after each one of the same node: its wedges
    later = np.searchsorted(low, low, side="right") - np.arange(len(low)) - 1
    ends, found = np.cumsum(later), np.zeros(n, np.int64)
    first = 0
    while first < len(low):
        done = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, done + WEDGES, side="right")))
        many = later[first:last]
        one = np.repeat(np.arange(first, last), many)
        two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(many) - many, many)
        x, y = high[one], high[two]
        hit = np.zeros(len(x), bool)
        for key in (x * n + y, y * n + x):
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit |= keys[at] == key
        for corner in (low[one], x, y):
            found += np.bincount(corner[hit], minlength=n)
        first = last
    return found


def _units(value: np.ndarray) -> int:
    """Sum of fractions as ``scalars.sum_of_fractions`` counts it."""
    return int((value * float(S.UNITS)).astype(np.int64).sum())


def _gini(degree: np.ndarray) -> float:
    """Gini coefficient as ``ordering.gini_of_counts`` divides it."""
    ties = np.bincount(degree).tolist()
    before = ranked = total = 0
    for x, n in enumerate(ties):
        ranked += x * (n * before + n * (n + 1) // 2)
        total += x * n
        before += n
    return float(2 * ranked - (before + 1) * total) / float(before * total) if total else 0.0


def _pack(table: pa.Table, local: int) -> Iterator[dict]:
    """The shape row of a release and the rows of its parts."""
    a, b = (pa.concat_arrays(table[c].chunks) for c in "ab")
    is_node = b.is_null().to_numpy(zero_copy_only=False)
    names = pa.concat_arrays([a, b]).dictionary_encode()
    rank = np.empty(len(names.dictionary), np.int32)
    rank[pc.sort_indices(names.dictionary).to_numpy()] = np.arange(len(rank), dtype=np.int32)
    codes = rank[names.indices.fill_null(0).to_numpy(zero_copy_only=False)]
    known = np.zeros(len(rank), bool)
    known[codes[: len(a)][is_node]] = True
    number = (np.cumsum(known) - 1).astype(np.int32)
    x, y = codes[: len(a)][~is_node], codes[len(a) :][~is_node]
    both = known[x] & known[y]
    x, y = number[x[both]], number[y[both]]
    n, m = int(known.sum()), len(x)
    node, other = np.concatenate([x, y]), np.concatenate([y, x])
    other = other[np.argsort(node, kind="stable")]
    degree = np.bincount(node, minlength=n)
    label = smallest_linked(n, other, degree)
    sizes = np.bincount(label, minlength=n)
    arcs = np.bincount(label, weights=degree, minlength=n).astype(np.int64)
    shape = {"part": -1, "fits": bool(arcs.max(initial=0) <= local), "num_nodes": n, "num_edges": m}
    if not shape["fits"]:
        yield shape
        return
    giant = int(sizes.argmax()) if n else -1
    local_share = np.divide(2.0 * triangles(n, x, y, degree), (degree * (degree - 1)).astype(float), out=np.zeros(n), where=degree > 1)
    yield shape | {
        "comps": int((sizes > 0).sum()),
        "size": int(sizes.max(initial=0)),
        "degrees": int(degree.sum()),
        "gini": _gini(degree),
        "triples": _units(local_share),
    }
    linked = np.flatnonzero(degree)
    if not len(linked):
        return
    roots = np.unique(label[linked])
    tiny = (arcs[roots] <= traversal.TINY) & (roots != giant)
    before = int((~tiny).sum()) + (np.cumsum(np.where(tiny, arcs[roots], 0)) - 1) // traversal.BIN
    group = np.where(tiny, before, np.cumsum(~tiny) - 1)
    part_of = np.zeros(n, np.int64)
    part_of[roots] = group
    part = part_of[label[linked]]
    by_label = linked[np.argsort(label[linked], kind="stable")]
    seat = np.zeros(n, np.int32)
    seat[by_label] = np.arange(len(by_label)) - np.searchsorted(label[by_label], label[by_label])
    order = np.argsort(part, kind="stable")
    seq, part = linked[order], part[order]
    cuts = np.append(np.flatnonzero(np.append(True, part[1:] != part[:-1])), len(seq))
    place = np.zeros(n, np.int32)
    place[seq] = np.arange(len(seq)) - np.repeat(cuts[:-1], np.diff(cuts))
    starts, many = np.cumsum(degree) - degree, degree[seq]
    laid = np.cumsum(many) - many
    other = place[other[np.repeat(starts[seq] - laid, many) + np.arange(many.sum())]]
    laid = np.append(laid, len(other))
    for p, (i, j) in enumerate(zip(cuts[:-1], cuts[1:])):
        own = seat[seq[i:j]]
        yield shape | {
            "comps": int((sizes > 0).sum()),
            "part": p,
            "giant": bool((label[seq[i:j]] == giant).all()),
            "arcs": int(laid[j] - laid[i]),
            "lanes": int(own.max()) + 1,
            "seat": own.tobytes(),
            "starts": (laid[i:j] - laid[i]).astype(np.int32).tobytes(),
            "other": other[laid[i] : laid[j]].tobytes(),
        }


def pack(nodes: DataFrame, edges: DataFrame, local: int | None = None) -> Packed:
    """Graphs of (release, node) and (release, a, b) as packed components."""
    local = traversal.LOCAL_ARCS if local is None else local
    counted = edges.groupBy("release").agg(F.count(F.lit(1)).alias("edges"))
    held = nodes.groupBy("release").agg(F.count(F.lit(1)).alias("nodes")).join(counted, "release", "left")
    over = (F.coalesce("edges", F.lit(0)) > GRAPH_EDGES) | (F.col("nodes") > 2 * GRAPH_EDGES)
    held, seen = materialize_with(held.withColumn("over", over), n=F.count_if("over"))
    some_nodes, some_edges = nodes, edges
    if seen["n"]:
        some_nodes, some_edges = (df.join(held.where("NOT over"), "release", "left_semi") for df in (nodes, edges))
    rows = some_edges.select("release", "a", "b").unionByName(
        some_nodes.select("release", F.col("node").alias("a"), F.lit(None).cast(nodes.schema["node"].dataType).alias("b"))
    )
    schema = _schema(nodes, f"{_PART}, {_SHAPE}")
    fields = [f.name for f in schema.fields if f.name != "release"]
    types = pa.schema([(f.name, _ARROW[f.dataType.typeName()]) for f in schema.fields if f.name != "release"])

    def run(table: pa.Table) -> pa.Table:
        out = pa.Table.from_pylist(list(_pack(table, local)), types)
        same = pa.concat_arrays(table["release"].slice(0, 1).chunks).take(pa.array(np.zeros(len(out), np.int64)))
        return pa.table([same, *[out[f] for f in fields]], ["release", *fields])

    rows, found = materialize_with(rows.groupBy("release").applyInArrow(run, schema), over=F.count_if(~F.col("fits")))
    fit = rows.where("fits")
    shapes, parts = fit.where("part < 0"), fit.where("part >= 0")
    if not seen["n"] and not found["over"]:
        return Packed(shapes, parts)
    rest_nodes, rest_edges = (df.join(shapes, "release", "left_anti") for df in (nodes, edges))
    return Packed(shapes, parts, rest_nodes, rest_edges)


_ARROW = {
    "integer": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary(),
}


def _loads(starts: np.ndarray, other: np.ndarray, source: np.ndarray, lane: np.ndarray, sums: bool):
    """(load, distance, depth) of each node by Brandes' accumulation from some sources, a column each."""
    n, lanes = len(starts), int(lane.max()) + 1
    gather, place = traversal._sums_over_neighbours(starts, other)
    source, load, distance, depth = place[source], np.zeros(n), np.zeros(n, np.int64), 0
    width = min(64, max(8, traversal.STEP // 8 // n))
    for first in range(0, lanes, width):
        some = (lane >= first) & (lane < first + width)
        paths = np.zeros((n, min(width, lanes - first)))
        paths[source[some], lane[some] - first] = 1.0
        layer, fronts = paths, [None]
        unseen = paths == 0
        while True:
            layer = gather(layer)
            layer *= unseen
            fresh = layer > 0
            if not fresh.any():
                break
            if sums:
                distance += len(fronts) * fresh.sum(1)
            fronts.append(fresh)
            unseen &= ~fresh
            paths = paths + layer
        depth = max(depth, len(fronts) - 1)
        per_path = np.divide(1.0, paths, out=np.zeros_like(paths), where=paths > 0)
        owed = np.zeros_like(paths)
        for at in range(len(fronts) - 1, 1, -1):
            share = 1.0 + owed
            share *= per_path
            share *= fronts[at]
            back = gather(share)
            back *= paths
            back *= fronts[at - 1]
            owed += back
        load += owed.sum(1)
    return load[place], distance[place], depth


def _reached(starts: np.ndarray, other: np.ndarray, source: np.ndarray, lane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of distances, largest distance) of each node to some sources, 64 of them a word."""
    lanes, width = int(lane.max()) + 1, 64 * max(1, traversal.STEP // max(1, len(other)))
    distance, depth = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int32)
    for first in range(0, lanes, width):
        some = (lane >= first) & (lane < first + width)
        bit = (lane[some] - first).astype(np.int64)
        seen = np.zeros((len(starts), -(-min(width, lanes - first) // 64)), np.uint64)
        np.bitwise_or.at(seen, (source[some], bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
        layer, level = seen, 0
        while True:
            layer = np.bitwise_or.reduceat(layer.take(other, axis=0), starts, axis=0) & ~seen
            found = np.bitwise_count(layer).sum(1, dtype=np.int64)
            if not found.any():
                break
            level += 1
            seen = seen | layer
            distance += level * found
            depth[found > 0] = np.maximum(depth[found > 0], level)
    return distance, depth


def _diameter(starts: np.ndarray, other: np.ndarray) -> int:
    """Diameter of a connected graph: from the outer levels of its best connected node inward.

    Nodes at a level or below are at most twice as far apart, so the search ends once the longest distance reaches that.
    """
    degree = np.diff(np.append(starts, len(other)))
    hub, lane = np.array([int(degree.argmax())]), np.zeros(1, np.int64)
    level = _reached(starts, other, hub, lane)[0]
    most = at = int(level.max(initial=0))
    while at > 0 and most < 2 * at:
        fringe = np.flatnonzero(level == at)
        most = max(most, int(_reached(starts, other, fringe, np.arange(len(fringe)))[1].max()))
        at -= 1
    return most


def _near(distance: np.ndarray, n: int) -> int:
    """Closeness of the nodes of a connected graph, in units."""
    return _units(np.divide(float(n - 1), distance, out=np.zeros(len(distance)), where=distance > 0))


def search(parts: DataFrame, loads: bool, sums: bool) -> DataFrame:
    """(release, part, giant, depth, most, near) of each part.

    ``most`` is the largest dependency of all shortest paths on a node (with ``loads``), ``near`` the closeness of a
    connected graph in units (with ``sums``), ``depth`` the diameter if the part is the largest component.
    """
    whole = F.col("comps") == 1
    seated = F.lit(True) if loads else (whole if sums else F.lit(False))
    blocks = F.when(seated, F.ceil(F.col("lanes") / traversal.SEATS)).otherwise(1).cast("int")
    visits = F.sum(F.col("arcs") * F.when(seated, F.col("lanes")).otherwise(64))
    spark = parts.sparkSession
    total = parts.agg(visits).first()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, math.ceil(total / TASK_VISITS))
    rows = parts.withColumn("blocks", blocks).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "release", "part", "block", "blocks", "giant", "num_nodes", whole.alias("whole"), "seat", "starts", "other"
    ).repartition(tasks)
    schema = _schema(parts, _FOUND)
    names = [f.name for f in schema.fields]

    def one(row: dict) -> dict:
        starts, other = np.frombuffer(row["starts"], np.int32), np.frombuffer(row["other"], np.int32)
        seat = np.frombuffer(row["seat"], np.int32)
        out = {k: row[k] for k in ("release", "part", "block", "blocks")}
        if not loads and not (sums and row["whole"]):
            return out | {"depth": _diameter(starts, other) if row["giant"] else 0}
        # a block holds every so many seats
        source = np.flatnonzero(seat % row["blocks"] == row["block"])
        lane = (seat[source] // row["blocks"]).astype(np.int64)
        if loads:
            load, distance, depth = _loads(starts, other, source, lane, sums and row["whole"])
        else:
            distance, depth = _reached(starts, other, source, lane)
            load, depth = np.zeros(0), int(depth.max(initial=0))
        out["depth"] = depth
        if row["blocks"] > 1:
            return out | {"load": load.tobytes(), "distance": distance.tobytes()}
        return out | {"most": float(load.max()) if loads else None, "near": _near(distance, row["num_nodes"])}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = pa.schema([batch.schema.field("release"), *[(f.name, _ARROW[f.dataType.typeName()]) for f in schema.fields[1:]]])
            for k in range(batch.num_rows):
                out = pa.RecordBatch.from_pylist([one(batch.slice(k, 1).to_pylist()[0])], kinds)
                yield out.select(names)

    found, seen = materialize_with(rows.mapInArrow(run, schema), many=F.count_if(F.col("blocks") > 1))
    done = found.where("blocks = 1").select("release", "part", "depth", "most", "near")
    if seen["many"]:
        done = done.unionByName(_added_up(found.where("blocks > 1"), parts, loads, sums))
    return materialize(parts.select("release", "part", "giant").join(done, ["release", "part"]))


def _added_up(found: DataFrame, parts: DataFrame, loads: bool, sums: bool) -> DataFrame:
    """The figures of parts that were searched in several blocks."""
    sizes = parts.select("release", "part", "num_nodes")
    schema = _schema(parts, _DONE)
    kinds = [_ARROW[f.dataType.typeName()] for f in schema.fields[1:]]

    def run(table: pa.Table) -> pa.Table:
        load, distance = 0.0, 0
        for k in np.argsort(table["block"].to_numpy()).tolist():
            load = load + np.frombuffer(table["load"][k].as_py(), np.float64)
            distance = distance + np.frombuffer(table["distance"][k].as_py(), np.int64)
        n = table["num_nodes"][0].as_py()
        row = [table["part"][0].as_py(), max(table["depth"].to_pylist()), float(load.max()) if loads else None, _near(distance, n)]
        release = pa.concat_arrays(table["release"].slice(0, 1).chunks)
        return pa.table([release, *[pa.array([v], t) for v, t in zip(row, kinds)]], [f.name for f in schema.fields])

    rows = found.join(sizes, ["release", "part"]).select("release", "part", "block", "depth", "load", "distance", "num_nodes")
    return rows.groupBy("release", "part").applyInArrow(run, schema)


def diameters(graphs: Packed, found: DataFrame) -> DataFrame:
    deep = found.where("giant").select("release", "depth")
    return graphs.shapes.select("release").join(deep, "release", "left").select(
        "release", F.coalesce("depth", F.lit(0)).alias("diameter")
    )


def closeness(graphs: Packed, found: DataFrame) -> DataFrame:
    near = found.where("part = 0").select("release", "near")
    told = graphs.shapes.select("release", "comps", "num_nodes").join(near, "release", "left")
    mean = F.col("near").cast("double") / F.lit(float(S.UNITS)) / F.col("num_nodes")
    return told.select(
        "release", F.when(F.col("comps") == 1, F.coalesce(mean, F.lit(0.0))).otherwise(0.0).alias("avg_closeness")
    )


def betweenness(graphs: Packed, found: DataFrame) -> DataFrame:
    most = found.groupBy("release").agg(F.max("most").alias("load"))
    n = F.col("num_nodes")
    # in units of 2^-19, so that the order in which a load was summed cannot tell equal ones apart
    load = F.round(F.col("load") * F.lit(float(1 << 19))) / F.lit(float(1 << 19))
    share = S.ratio(load, (n - 1) * (n - 2))
    told = graphs.shapes.select("release", "num_nodes").join(most, "release", "left")
    return told.select("release", F.coalesce(share, F.lit(0.0)).alias("max_betweenness"))


def components(graphs: Packed) -> DataFrame:
    return graphs.shapes.select(
        "release", F.col("comps").alias("num_components"), S.ratio(F.col("size"), F.col("num_nodes")).alias("giant_component_size")
    )


def basics(graphs: Packed) -> DataFrame:
    n = F.col("num_nodes")
    return graphs.shapes.select(
        "release", "num_nodes", "num_edges", S.ratio_or_zero(2 * F.col("num_edges"), n * (n - 1)).alias("density")
    )


def degrees(graphs: Packed) -> DataFrame:
    return graphs.shapes.select(
        "release", S.ratio(F.col("degrees"), F.col("num_nodes")).alias("avg_degree"), F.col("gini").alias("degree_centralization")
    )


def clustering(graphs: Packed) -> DataFrame:
    mean = F.col("triples").cast("double") / F.lit(float(S.UNITS)) / F.col("num_nodes")
    return graphs.shapes.select("release", mean.alias("avg_clustering"))
