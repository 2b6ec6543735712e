"""Measures of many undirected graphs at once.

Input: nodes (release, node), isolated ones included, and edges (release, a, b, weight) with a < b. Graphs that fit a
task are measured as packed components (``operators.packed``). The others are treated in the same joins; loops run over
graph depth only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from releaselens.functions import scalars as S
from releaselens.operators import packed
from releaselens.operators.ordering import gini_by_group, with_position
from releaselens.operators.traversal import (
    BLOCK,
    LOCAL_ARCS,
    distances_in_tasks,
    loads_in_tasks,
    reach,
    shortest_path_loads,
)
from releaselens.session import materialize, materialize_with

KEY = ["release", "node"]
# A larger component's diameter is searched from few sources, over joins.
LOCAL_NODES = 1 << 14


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every edge as (release, node, other)."""
    ends = F.array(
        F.struct(F.col("a").alias("node"), F.col("b").alias("other")),
        F.struct(F.col("b").alias("node"), F.col("a").alias("other")),
    )
    return edges.select("release", F.inline(ends))


def graph_basic(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of nodes and edges, and density, per release."""
    counted = nodes.groupBy("release").agg(F.count(F.lit(1)).alias("num_nodes"))
    linked = edges.groupBy("release").agg(F.count(F.lit(1)).alias("num_edges"))
    n = F.col("num_nodes")
    return (
        counted.join(linked, "release", "left")
        .fillna(0, subset=["num_edges"])
        .withColumn("density", S.ratio_or_zero(2 * F.col("num_edges"), n * (n - 1)))
    )


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree of every node, 0 for isolated ones."""
    counted = adjacency(edges).groupBy(*KEY).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(counted, KEY, "left").fillna(0, subset=["degree"])


def graph_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean degree and the Gini coefficient of degrees."""
    degree = degrees(nodes, edges)
    spread = gini_by_group(degree, ["release"], "degree", "degree_centralization")
    return degree.groupBy("release").agg(F.avg("degree").alias("avg_degree")).join(spread, "release")


def graph_clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean local clustering coefficient; nodes with fewer than two neighbours count as 0.

    Edges point from the lower to the higher degree, which bounds the wedges at a hub by the square root of
    the edge count, then each wedge looks for its closing edge.
    """
    degree = materialize(degrees(nodes, edges))
    da = degree.select("release", F.col("node").alias("a"), F.col("degree").alias("da"))
    db = degree.select("release", F.col("node").alias("b"), F.col("degree").alias("db"))
    rising = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    arcs = (
        edges.join(da, ["release", "a"])
        .join(db, ["release", "b"])
        .select(
            "release",
            F.when(rising, F.col("a")).otherwise(F.col("b")).alias("low"),
            F.when(rising, F.col("b")).otherwise(F.col("a")).alias("high"),
        )
    )
    arcs = materialize(arcs)
    wedges = (
        arcs.withColumnRenamed("high", "a")
        .join(arcs.withColumnRenamed("high", "b"), ["release", "low"])
        .filter(F.col("a") < F.col("b"))
    )
    triangles = wedges.join(edges.select("release", "a", "b"), ["release", "a", "b"])
    corners = triangles.select("release", F.explode(F.array("low", "a", "b")).alias("node"))
    per_node = corners.groupBy(*KEY).agg(F.count(F.lit(1)).alias("triangles"))
    d = F.col("degree")
    local = S.ratio_or_zero(2 * F.coalesce("triangles", F.lit(0)), d * (d - 1))
    mean = S.sum_of_fractions(local) / F.count(F.lit(1))
    return degree.join(per_node, KEY, "left").groupBy("release").agg(mean.alias("avg_clustering"))


def numbered(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (release, node, id), numbered in their order, and both directions of every edge as (id, other)."""
    ordered = nodes.select(*KEY).repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    ids = materialize(ordered.withColumn("id", F.monotonically_increasing_id()))
    ends = edges.select("release", "a", "b")
    for end in ("a", "b"):
        named = ids.select("release", F.col("node").alias(end), F.col("id").alias(f"id_{end}"))
        ends = ends.join(named, ["release", end])
    both = F.array(*[F.struct(F.col(f"id_{x}").alias("id"), F.col(f"id_{y}").alias("other")) for x, y in ("ab", "ba")])
    return ids, materialize(ends.select(F.inline(both)))


def component_roots(ids: DataFrame, arcs: DataFrame) -> DataFrame:
    """Smallest id of each node's component, as (release, node, id, root).

    Every round hooks each node to its smallest neighbour, follows that hook once more and contracts the arcs to what
    is still apart, so rounds shrink with the nodes left and their number grows with the logarithm of a component's depth.
    """
    hooks = []
    while True:
        near = arcs.groupBy("id").agg(F.min("other").alias("near")).select("id", F.least("id", "near").alias("near"))
        near = materialize(near)
        far = near.select(F.col("id").alias("near"), F.col("near").alias("far"))
        hook, seen = materialize_with(near.join(far, "near").select("id", F.col("far").alias("root")), n=F.count(F.lit(1)))
        if not seen["n"]:
            break
        hooks.append(hook)
        ends = arcs.join(hook, "id").select(F.col("root").alias("from"), F.col("other").alias("id")).join(hook, "id")
        arcs = ends.select(F.col("from").alias("id"), F.col("root").alias("other")).where("id <> other").distinct()
        arcs = materialize(arcs)
    roots = ids.withColumn("root", F.col("id"))
    for hook in hooks:
        later = hook.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        roots = roots.join(later, "root", "left").withColumn("root", F.coalesce("_next", "root")).drop("_next")
    return materialize(roots.select(*KEY, "id", "root"))


def component_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Smallest node name of each node's component, as (release, node, label)."""
    return _named(component_roots(*numbered(nodes, edges)))


def _named(roots: DataFrame) -> DataFrame:
    names = roots.select(F.col("id").alias("root"), F.col("node").alias("label"))
    return materialize(roots.join(names, "root").select(*KEY, "label"))


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("release", "label").agg(F.count(F.lit(1)).alias("size"))


def graph_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Number of connected components and the largest one's share of the nodes."""
    graphs = packed.pack(nodes, edges)
    found = packed.components(graphs)
    if graphs.nodes is None:
        return found
    roots = component_roots(*numbered(graphs.nodes, graphs.edges))
    return found.unionByName(components_of(roots.withColumnRenamed("root", "label")))


def components_of(labels: DataFrame) -> DataFrame:
    return component_sizes(labels).groupBy("release").agg(
        F.count(F.lit(1)).alias("num_components"),
        S.ratio(F.max("size"), F.sum("size")).alias("giant_component_size"),
    )


def _by_component(labels: DataFrame, edges: DataFrame, local: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(seats, arcs, large, their number) of the components of ``labels`` (release, node, label).

    ``seats`` (release, node, id, comp) and ``arcs`` (comp, id, other) hold the components with no more than ``local``
    arcs, which tasks search by themselves; ``large`` are the rows of ``labels`` that lie in other ones.
    """
    ids, arcs = numbered(labels, edges)
    names = ids.join(labels, KEY)
    comp = names.groupBy("release", "label").agg(F.min("id").alias("comp"))
    placed = materialize(names.join(comp, ["release", "label"]))
    arcs = materialize(arcs.join(placed.select("id", "comp"), "id").select("comp", "id", "other"))
    counted = arcs.groupBy("comp").agg(F.count(F.lit(1)).alias("arcs"))
    over, seen = materialize_with(counted.where(F.col("arcs") > local).select("comp"), n=F.count(F.lit(1)))
    large = placed.join(over, "comp", "left_semi")
    if not seen["n"]:
        return placed, arcs, large, 0
    return placed.join(over, "comp", "left_anti"), arcs.join(over, "comp", "left_anti"), large, seen["n"]


def graph_diameter(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Exact diameter of the largest component (smallest label on a tie); 0 for a single node."""
    graphs = packed.pack(nodes, edges)
    found = packed.diameters(graphs, packed.search(graphs.parts.where("giant"), loads=False, sums=False))
    if graphs.nodes is None:
        return found
    rest = graphs.nodes, graphs.edges
    return found.unionByName(diameter_of(component_labels(*rest), *rest))


def diameter_of(
    labels: DataFrame, nodes: DataFrame, edges: DataFrame, block: int = BLOCK, local: int = LOCAL_ARCS
) -> DataFrame:
    """Diameters given component labels.

    Components of up to ``local`` arcs and ``LOCAL_NODES`` nodes are searched inside tasks, from all their nodes. Of the
    others, one that fits one block of sources is searched from all its nodes at once. A larger one is
    searched from its best connected node, then from the nodes of the outermost levels inward. Nodes at
    level i or less are at most 2i apart, so the search stops as soon as the longest distance found reaches
    that bound: the result is exact and only few levels are usually needed.
    """
    best = component_sizes(labels).groupBy("release").agg(
        F.max("size").alias("size"), F.min_by("label", F.struct(-F.col("size"), "label")).alias("label")
    )
    # min_by keeps one label per release: the largest component, ties by name.
    giant = materialize(labels.join(best, ["release", "label"]).select(*KEY, "label", "size"))
    seats, local_arcs, rest, n = _by_component(giant.filter(F.col("size") <= LOCAL_NODES).select(*KEY, "label"), edges, local)
    depths = distances_in_tasks(local_arcs, seats.select("comp", "id"))
    short = seats.join(depths, "id", "left").groupBy("release")
    short = short.agg(F.coalesce(F.max("depth"), F.lit(0)).alias("diameter"))
    wide, seen = materialize_with(giant.filter(F.col("size") > LOCAL_NODES).select("release").distinct(), n=F.count(F.lit(1)))
    if not n and not seen["n"]:
        return short
    long_ = wide.unionByName(rest.select("release")).distinct()
    giant = materialize(giant.join(long_, "release", "left_semi").select(*KEY, "size"))
    return short.unionByName(_searched_diameters(giant, edges, block))


def _searched_diameters(giant: DataFrame, edges: DataFrame, block: int) -> DataFrame:
    """Diameters of components (release, node, size) by searches over joins."""
    arcs = materialize(adjacency(edges).join(giant.select("release").distinct(), "release", "left_semi"))
    small = with_position(giant.filter(F.col("size") <= block), ["node"], ["release"])
    small = small.select(*KEY, F.lit(0).alias("block"), (F.col("pos") - 1).cast("int").alias("bit"))
    large = giant.filter(F.col("size") > block)
    hubs = (
        large.join(arcs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("degree")), KEY)
        .groupBy("release")
        .agg(F.min_by("node", F.struct(-F.col("degree"), "node")).alias("node"))
        .select(*KEY, F.lit(0).alias("block"), F.lit(0).alias("bit"))
    )
    state = reach(arcs, small.unionByName(hubs))
    found = state.groupBy("release").agg(F.max("depth").cast("int").alias("diameter"))
    levels = state.join(large.select(*KEY), KEY).select(*KEY, F.col("depth").alias("level"))
    levels = materialize(levels)

    outer = levels.groupBy("release").agg(F.max("level").alias("at"))
    found, open_ = materialize_with(
        found.join(outer, "release", "left").withColumn("open", F.coalesce(F.col("at") > 0, F.lit(False))),
        n=F.count_if("open"),
    )
    while open_["n"]:
        fringe = levels.join(found.filter("open").select("release", F.col("at").alias("level")), ["release", "level"])
        seats = with_position(fringe.select(*KEY), ["node"], ["release"])
        seat = F.col("pos") - 1
        sources = seats.select(
            *KEY,
            F.floor(seat / F.lit(block)).cast("int").alias("block"),
            (seat % F.lit(block)).cast("int").alias("bit"),
        )
        deeper = reach(arcs, sources).groupBy("release").agg(F.max("depth").cast("int").alias("deeper"))
        reached = F.greatest("diameter", F.coalesce("deeper", F.lit(0)))
        inner = F.when(F.col("open"), F.col("at") - 1).otherwise(F.col("at"))
        found, open_ = materialize_with(
            found.join(deeper, "release", "left")
            .withColumn("diameter", reached)
            .withColumn("at", inner)
            .withColumn("open", F.col("open") & (F.col("diameter") < 2 * F.col("at")))
            .drop("deeper"),
            n=F.count_if("open"),
        )
    return found.select("release", "diameter")


def graph_closeness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean closeness centrality of connected graphs, 0 for others."""
    graphs = packed.pack(nodes, edges)
    found = packed.closeness(graphs, packed.search(graphs.parts.where("comps = 1"), loads=False, sums=True))
    if graphs.nodes is None:
        return found
    rest = graphs.nodes, graphs.edges
    return found.unionByName(closeness_of(component_labels(*rest), *rest))


def closeness_of(
    labels: DataFrame, nodes: DataFrame, edges: DataFrame, block: int = BLOCK, wave: int = 64, local: int = LOCAL_ARCS
) -> DataFrame:
    """Mean closeness given component labels: exact distances between all nodes of each connected graph.

    Graphs of up to ``local`` arcs are searched inside tasks. Of the others, sources are searched in waves of ``wave`` blocks, so the working table is bounded by the nodes times
    ``wave`` whatever the graph's size.
    """
    counts = labels.groupBy("release").agg(
        F.count(F.lit(1)).alias("n"), (F.min("label") == F.max("label")).alias("connected")
    )
    counts = materialize(counts)
    whole = counts.filter("connected")
    seats, local_arcs, rest, n = _by_component(
        labels.join(whole.select("release"), "release", "left_semi").select(*KEY, "label"), edges, local
    )
    near = distances_in_tasks(local_arcs, seats.select("comp", "id"))
    sums = materialize(seats.join(near, "id").select(*KEY, "distance"))
    if n:
        sums = sums.unionByName(_searched_distances(rest.select(*KEY), edges, block, wave))
    total = sums.groupBy(*KEY).agg(F.sum("distance").alias("distance")).join(counts, "release")
    mean = total.groupBy("release").agg(
        (S.sum_of_fractions(S.ratio_or_zero(F.col("n") - 1, F.col("distance"))) / F.count(F.lit(1))).alias("avg_closeness")
    )
    return counts.select("release").join(mean, "release", "left").fillna(0.0, subset=["avg_closeness"])


def _searched_distances(nodes: DataFrame, edges: DataFrame, block: int, wave: int) -> DataFrame:
    """Sums of distances (release, node, distance) from all ``nodes`` of connected graphs by searches over joins."""
    arcs = materialize(adjacency(edges).join(nodes.select("release").distinct(), "release", "left_semi"))
    seats = with_position(nodes, ["node"], ["release"])
    seat = F.col("pos") - 1
    seats, last = materialize_with(
        seats.select(
            *KEY,
            F.floor(seat / F.lit(block)).cast("int").alias("block"),
            (seat % F.lit(block)).cast("int").alias("bit"),
        ),
        block=F.max("block"),
    )
    sums = None
    for start in range(0, (last["block"] if last["block"] is not None else -1) + 1, wave):
        some = seats.filter((F.col("block") >= start) & (F.col("block") < start + wave))
        part = materialize(reach(arcs, some).groupBy(*KEY).agg(F.sum("distance").alias("distance")))
        sums = part if sums is None else sums.unionByName(part)
    return sums


def graph_betweenness(nodes: DataFrame, edges: DataFrame, max_sources: int | None = None, seed: int = 42) -> DataFrame:
    """Largest normalised betweenness centrality: exact, or on request from that many seeded sources, scaled up."""
    if max_sources is not None:
        return betweenness_of(component_labels(nodes, edges), nodes, edges, max_sources, seed)
    graphs = packed.pack(nodes, edges)
    found = packed.betweenness(graphs, packed.search(graphs.parts, loads=True, sums=False))
    if graphs.nodes is None:
        return found
    rest = graphs.nodes, graphs.edges
    return found.unionByName(betweenness_of(component_labels(*rest), *rest))


def betweenness_of(
    labels: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    max_sources: int | None = None,
    seed: int = 42,
    local: int = LOCAL_ARCS,
) -> DataFrame:
    """Betweenness given component labels: components of up to ``local`` arcs are searched inside tasks."""
    counts = materialize(nodes.groupBy("release").agg(F.count(F.lit(1)).alias("n")))
    seats, local_arcs, rest, large = _by_component(labels, edges, local)
    if max_sources is not None:
        drawn = nodes.select(*KEY, F.xxhash64("node", F.lit(seed)).alias("draw"))
        drawn = materialize(with_position(drawn, ["draw", "node"], ["release"]).filter(F.col("pos") <= max_sources))
        chosen = seats.join(drawn, KEY, "left_semi")
        rest_chosen = rest.join(drawn, KEY, "left_semi")
    else:
        chosen, rest_chosen = seats, rest
    loads = loads_in_tasks(local_arcs, chosen.select("comp", "id"))
    loads = materialize(seats.join(loads, "id").select(*KEY, "load"))
    if large:
        # seats are numbered inside a component: sources of different ones share a row's lanes
        seat = with_position(rest_chosen.select(*KEY, "comp"), ["node"], ["release", "comp"])
        sources = seat.select(*KEY, (F.col("pos") - 1).cast("int").alias("seat"))
        ends = rest.select("release", F.col("node").alias("a"))
        loads = loads.unionByName(shortest_path_loads(adjacency(edges.join(ends, ["release", "a"], "left_semi")), sources))
    n = F.col("n")
    used = n if max_sources is None else F.least(n, F.lit(max_sources))
    # in units of 2^-19, so that the order in which a load was summed cannot tell equal ones apart
    load = F.round(F.col("load") * F.lit(float(1 << 19))) / F.lit(float(1 << 19))
    share = S.ratio(load, (n - 1) * (n - 2)) * S.ratio(n, used)
    most = loads.join(counts, "release").groupBy("release").agg(F.max(share).alias("max_betweenness"))
    return counts.select("release").join(most, "release", "left").fillna(0.0, subset=["max_betweenness"])


def edge_set_ops(edges: DataFrame, left: str, right: str) -> DataFrame:
    """Sizes of the intersection, union and differences of two releases' edge sets."""
    sides = edges.filter(F.col("release").isin(left, right)).groupBy("a", "b").agg(
        F.max(F.col("release") == left).alias("l"), F.max(F.col("release") == right).alias("r")
    )
    return sides.agg(
        F.count_if(F.col("l") & F.col("r")).alias("both"),
        F.count(F.lit(1)).alias("either"),
        F.count_if(F.col("l") & ~F.col("r")).alias("only_left"),
        F.count_if(~F.col("l") & F.col("r")).alias("only_right"),
    )


def _against_previous(rows: DataFrame, item: list[str], prefix: str) -> DataFrame:
    """Count items of each release index that are also, or only, in the one before."""
    now = rows.select("idx", *item, F.lit(1).alias("now"), F.lit(0).alias("old"))
    old = rows.select((F.col("idx") + 1).alias("idx"), *item, F.lit(0).alias("now"), F.lit(1).alias("old"))
    seen = now.unionByName(old).groupBy("idx", *item).agg(F.max("now").alias("now"), F.max("old").alias("old"))
    return seen.groupBy("idx").agg(
        F.count_if((F.col("now") == 1) & (F.col("old") == 1)).alias(f"{prefix}_kept"),
        F.count_if((F.col("now") == 1) & (F.col("old") == 0)).alias(f"{prefix}_added"),
        F.count_if((F.col("now") == 0) & (F.col("old") == 1)).alias(f"{prefix}_removed"),
    )


def network_change(
    nodes: DataFrame, edges: DataFrame, releases: DataFrame, shapes: tuple[DataFrame, DataFrame] | None = None
) -> DataFrame:
    """Each release's graph against the graph of the release before it in ``releases.idx`` order.

    Without a previous graph, or when either one is empty, only the added nodes are counted. ``shapes`` are the results of
    ``graph_basic`` and ``graph_degree`` where they are known.
    """
    basic, degree = shapes or (graph_basic(nodes, edges), graph_degree(nodes, edges))
    index = releases.select("release", "idx")
    node_sets = _against_previous(nodes.join(index, "release"), ["node"], "nodes")
    edge_sets = _against_previous(edges.join(index, "release"), ["a", "b"], "edges")
    shape = materialize(
        index.join(basic.select("release", "num_nodes", "density"), "release", "left")
        .join(degree.select("release", "degree_centralization"), "release", "left")
        .fillna(0, subset=["num_nodes", "density", "degree_centralization"])
    )
    before = shape.select(
        (F.col("idx") + 1).alias("idx"),
        F.col("num_nodes").alias("old_nodes"),
        F.col("density").alias("old_density"),
        F.col("degree_centralization").alias("old_centralization"),
    )
    rows = shape.join(before, "idx", "left").join(node_sets, "idx", "left").join(edge_sets, "idx", "left")
    counts = [f"{p}_{k}" for p in ("nodes", "edges") for k in ("kept", "added", "removed")]
    rows = rows.fillna(0, subset=[*counts, "old_nodes"])
    both = (F.col("num_nodes") > 0) & (F.col("old_nodes") > 0)
    union = F.col("edges_kept") + F.col("edges_added") + F.col("edges_removed")
    jaccard = F.when(union == 0, 1.0).otherwise(S.ratio(F.col("edges_kept"), union))

    def when_both(value, otherwise):
        return F.when(both, value).otherwise(F.lit(otherwise) if not hasattr(otherwise, "alias") else otherwise)

    return rows.select(
        "release",
        when_both(jaccard, 0.0).alias("network_jaccard"),
        when_both(F.col("nodes_added"), F.col("num_nodes")).alias("nodes_added"),
        when_both(F.col("nodes_removed"), 0).alias("nodes_removed"),
        when_both(F.col("density") - F.col("old_density"), 0.0).alias("density_change"),
        when_both(F.col("degree_centralization") - F.col("old_centralization"), 0.0).alias("centralization_change"),
        when_both(S.ratio_or_zero(F.col("nodes_added"), F.col("num_nodes")), 0.0).alias("turnover_rate"),
    )


NETWORK_COLUMNS = (
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
    "network_jaccard",
    "nodes_added",
    "nodes_removed",
    "density_change",
    "centralization_change",
    "turnover_rate",
)


def network_measures(
    nodes: DataFrame, edges: DataFrame, releases: DataFrame, max_sources: int | None = None, seed: int = 42
) -> DataFrame:
    """All 17 graph measures per release of ``releases`` (release, idx); empty graphs measure 0.

    Betweenness is exact, whatever the graphs' sizes, unless ``max_sources`` asks for an estimate.
    """
    if max_sources is None:
        graphs = packed.pack(nodes, edges)
        parts = _packed_measures(graphs)
        if graphs.nodes is not None:
            over_joins = _joined_measures(graphs.nodes, graphs.edges, None, seed)
            parts = [part.unionByName(other) for part, other in zip(parts, over_joins)]
    else:
        parts = _joined_measures(nodes, edges, max_sources, seed)
    out = releases.select("release")
    for part in (*parts, network_change(nodes, edges, releases, (parts[0], parts[4]))):
        out = out.join(part, "release", "left")
    return out.fillna(0, subset=list(NETWORK_COLUMNS)).select("release", *NETWORK_COLUMNS)


def _packed_measures(graphs: packed.Packed) -> list[DataFrame]:
    """Measures of packed graphs: one search from all nodes gives dependencies, distances and depths."""
    found = packed.search(graphs.parts, loads=True, sums=True)
    return [
        packed.basics(graphs),
        packed.clustering(graphs),
        packed.diameters(graphs, found),
        packed.components(graphs),
        packed.degrees(graphs),
        packed.betweenness(graphs, found),
        packed.closeness(graphs, found),
    ]


def _joined_measures(nodes: DataFrame, edges: DataFrame, max_sources: int | None, seed: int) -> list[DataFrame]:
    """The same measures by searches over joins."""
    nodes, edges = materialize(nodes), materialize(edges)
    labels = component_labels(nodes, edges)
    return [
        graph_basic(nodes, edges),
        graph_clustering(nodes, edges),
        diameter_of(labels, nodes, edges),
        components_of(labels),
        graph_degree(nodes, edges),
        betweenness_of(labels, nodes, edges, max_sources, seed),
        closeness_of(labels, nodes, edges),
    ]
