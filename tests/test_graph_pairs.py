import datetime as dt
import itertools
import random
from collections import Counter, deque

import numpy as np
import pytest

from releaselens.operators import graph, intervals, packed, pairs, traversal

GRAPHS = {
    "star": ("cabd", [("c", "a"), ("c", "b"), ("c", "d")]),
    "path": ("abcd", [("a", "b"), ("b", "c"), ("c", "d")]),
    "cycle": ("abcd", [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a")]),
    "two": ("abcdefg", [("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f")]),
    "single": ("a", []),
    "pair": ("ab", [("a", "b")]),
    "long": ("abcdefghij", [(x, y) for x, y in zip("abcdefghi", "bcdefghij")]),
}


@pytest.fixture(scope="module")
def frames(spark):
    nodes = spark.createDataFrame([(g, n) for g, (ns, _) in GRAPHS.items() for n in ns], "release string, node string")
    edges = spark.createDataFrame(
        [(g, min(e), max(e), 1) for g, (_, es) in GRAPHS.items() for e in es], "release string, a string, b string, weight int"
    )
    return nodes, edges


def distances(nodes, edges, source):
    near = {n: [] for n in nodes}
    for a, b in edges:
        near[a].append(b)
        near[b].append(a)
    seen, todo = {source: 0}, deque([source])
    while todo:
        at = todo.popleft()
        for other in near[at]:
            if other not in seen:
                seen[other] = seen[at] + 1
                todo.append(other)
    return seen


def by_release(df, col):
    return {r["release"]: r[col] for r in df.collect()}


def test_basic_degree_and_clustering(frames):
    basic = graph.graph_basic(*frames)
    assert by_release(basic, "density")["cycle"] == pytest.approx(4 * 2 / 12)
    assert by_release(basic, "num_edges")["single"] == 0 and by_release(basic, "density")["single"] == 0
    assert by_release(graph.graph_degree(*frames), "avg_degree")["star"] == 1.5
    assert by_release(graph.graph_degree(*frames), "degree_centralization")["single"] == 0
    clustering = by_release(graph.graph_clustering(*frames), "avg_clustering")
    assert clustering["two"] == pytest.approx(3 / 7) and clustering["cycle"] == 0


def test_components(frames):
    rows = graph.graph_components(*frames)
    assert by_release(rows, "num_components") == {g: 3 if g == "two" else 1 for g in GRAPHS}
    assert by_release(rows, "giant_component_size")["two"] == pytest.approx(3 / 7)


@pytest.mark.parametrize("block", [512, 2])
def test_diameter_is_exact_whatever_the_block(frames, block):
    labels = graph.component_labels(*frames)
    got = by_release(graph.diameter_of(labels, *frames, block=block), "diameter")
    # The tie of size three in "two" goes to the component of "a".
    assert got == {"star": 2, "path": 3, "cycle": 2, "two": 1, "single": 0, "pair": 1, "long": 9}


@pytest.mark.parametrize("block,wave", [(512, 64), (3, 1)])
def test_closeness_of_connected_graphs(frames, block, wave):
    labels = graph.component_labels(*frames)
    got = by_release(graph.closeness_of(labels, *frames, block=block, wave=wave), "avg_closeness")
    for g, (nodes, edges) in GRAPHS.items():
        reach = [distances(nodes, edges, n) for n in nodes]
        whole = all(len(d) == len(nodes) for d in reach) and len(nodes) > 1
        want = sum((len(nodes) - 1) / sum(d.values()) for d in reach) / len(nodes) if whole else 0.0
        assert got[g] == pytest.approx(want), g


def test_betweenness_closed_forms(frames):
    got = by_release(graph.graph_betweenness(*frames), "max_betweenness")
    assert got["star"] == pytest.approx(1.0) and got["path"] == pytest.approx(2 / 3)
    assert got["cycle"] == pytest.approx(1 / 6) and got["pair"] == 0 and got["single"] == 0
    # A path of ten nodes: 4 * 5 of the 36 pairs pass its middle.
    assert got["long"] == pytest.approx(20 / 36)


def test_sampled_betweenness_scales_up(frames):
    got = by_release(graph.graph_betweenness(*frames, max_sources=4), "max_betweenness")
    assert got["star"] == pytest.approx(1.0) and got["long"] > 0


@pytest.mark.parametrize("local", [1 << 20, 0])
def test_searches_inside_tasks_and_over_joins_agree(spark, frames, local):
    labels = graph.component_labels(*frames)
    assert {(r["release"], r["label"]) for r in labels.collect()} >= {("two", "a"), ("two", "d"), ("two", "g")}
    got = by_release(graph.betweenness_of(labels, *frames, local=local), "max_betweenness")
    assert got["star"] == pytest.approx(1.0) and got["long"] == pytest.approx(20 / 36)
    got = by_release(graph.diameter_of(labels, *frames, block=2, local=local), "diameter")
    assert got == {"star": 2, "path": 3, "cycle": 2, "two": 1, "single": 0, "pair": 1, "long": 9}
    got = by_release(graph.closeness_of(labels, *frames, block=3, wave=1, local=local), "avg_closeness")
    assert got["pair"] == 1.0 and got["two"] == 0.0 and got["single"] == 0.0


def test_tasks_search_all_components_of_a_graph_without_a_job_a_level(spark, monkeypatch):
    """Several components, one with more sources than a group seats; no level is a job."""
    monkeypatch.setattr(graph, "shortest_path_loads", None)
    monkeypatch.setattr(graph, "reach", None)
    ring = [f"r{i:02d}" for i in range(21)]
    edges = [*zip(ring, ring[1:]), (ring[0], ring[-1]), ("x", "y"), ("y", "z")]
    n = spark.createDataFrame([("g", x) for x in [*ring, "x", "y", "z", "alone"]], "release string, node string")
    e = spark.createDataFrame([("g", min(p), max(p), 1) for p in edges], "release string, a string, b string, weight int")
    monkeypatch.setattr(traversal, "SEATS", 4)
    monkeypatch.setattr(traversal, "TINY", 4)
    labels = graph.component_labels(n, e)
    assert {r["label"] for r in labels.collect()} == {"r00", "x", "alone"}
    assert graph.diameter_of(labels, n, e).first()["diameter"] == 10
    # in a ring of 21 nodes each node lies inside the paths of 45 of the 190 pairs of others
    assert graph.betweenness_of(labels, n, e).first()["max_betweenness"] == pytest.approx(45 / (24 * 23 / 2))


def test_sums_over_neighbours_of_hubs():
    """A hub with more neighbours than are added rank by rank."""
    n = traversal.RANKS + 40
    node, other = np.array([0] * (n - 1) + [*range(1, n)]), np.array([*range(1, n)] + [0] * (n - 1))
    gather, place = traversal._sums_over_neighbours(np.searchsorted(node, np.arange(n)), other)
    rows = np.arange(1.0, n + 1)[:, None]
    placed = np.empty_like(rows)
    placed[place] = rows
    assert gather(placed)[place][:, 0].tolist() == [rows[1:].sum(), *[1.0] * (n - 1)]


def test_larger_graph_against_search(spark):
    rng = random.Random(5)
    nodes = [f"n{i:03d}" for i in range(90)]
    edges = sorted({tuple(sorted(rng.sample(nodes, 2))) for _ in range(110)})
    n = spark.createDataFrame([("r", x) for x in nodes], "release string, node string")
    e = spark.createDataFrame([("r", a, b, 1) for a, b in edges], "release string, a string, b string, weight int")
    reach = {x: distances(nodes, edges, x) for x in nodes}
    comps = {frozenset(d) for d in reach.values()}
    giant = min(comps, key=lambda c: (-len(c), min(c)))
    want = max(max(reach[x].values()) for x in giant)
    labels = graph.component_labels(n, e)
    assert graph.components_of(labels).first()["num_components"] == len(comps)
    for block in (512, 4):
        assert graph.diameter_of(labels, n, e, block=block).first()["diameter"] == want


def test_network_change_rules(spark):
    nodes = spark.createDataFrame(
        [("r1", "a"), ("r1", "b"), ("r2", "b"), ("r2", "c"), ("r2", "d"), ("r4", "a"), ("r5", "a")], "release string, node string"
    )
    edges = spark.createDataFrame(
        [("r1", "a", "b", 1), ("r2", "b", "c", 1)], "release string, a string, b string, weight int"
    )
    order = spark.createDataFrame([(f"r{i}", i) for i in range(1, 6)], "release string, idx bigint")
    rows = {r["release"]: r for r in graph.network_change(nodes, edges, order).collect()}
    assert rows["r1"]["nodes_added"] == 2 and rows["r1"]["turnover_rate"] == 0
    assert (rows["r2"]["nodes_added"], rows["r2"]["nodes_removed"], rows["r2"]["network_jaccard"]) == (2, 1, 0.0)
    assert rows["r2"]["turnover_rate"] == pytest.approx(2 / 3)
    assert rows["r2"]["density_change"] == pytest.approx(1 / 3 - 1)
    assert (rows["r3"]["nodes_added"], rows["r3"]["nodes_removed"]) == (0, 0)
    assert rows["r4"]["nodes_added"] == 1 and rows["r4"]["network_jaccard"] == 0
    # Two graphs without edges are the same.
    assert rows["r5"]["network_jaccard"] == 1.0 and rows["r5"]["nodes_added"] == 0


@pytest.fixture(scope="module")
def touches(spark):
    """A third of the touches fall on one file, many at the same time."""
    rng = random.Random(11)
    rows = []
    for i in range(400):
        file = "hot" if i % 3 == 0 else f"f{rng.randrange(12)}"
        at = dt.datetime(2020, 1, 1) + dt.timedelta(hours=rng.randrange(24 * 40) if i % 2 else 24 * 7 * rng.randrange(5))
        rows.append((file, f"d{rng.randrange(9)}", at))
    return spark.createDataFrame(rows, "file string, author string, date timestamp"), rows


@pytest.mark.parametrize("tile", [4096, 5])
def test_developer_pairs_and_coupling_with_hot_groups(spark, touches, tile):
    df, rows = touches
    want = Counter()
    for f in {r[0] for r in rows}:
        for a, b in itertools.combinations(sorted({r[1] for r in rows if r[0] == f}), 2):
            want[a, b] += 1
    got = {(r["developer1"], r["developer2"]): r["shared_files"] for r in pairs.developer_pairs(df, tile=tile).collect()}
    assert got == dict(want)

    # Repeated names inside a basket pair with themselves.
    want = Counter()
    for f in {r[0] for r in rows}:
        for a, b in itertools.combinations(sorted(r[1] for r in rows if r[0] == f), 2):
            want[a, b] += 1
    coupled = pairs.file_coupling(df, "file", "author", tile=tile)
    assert {(r["file1"], r["file2"]): r["cochange_count"] for r in coupled.collect()} == dict(want)
    top = [tuple(r) for r in pairs.top_pairs(coupled, "cochange_count", ["file1", "file2"], 3).collect()]
    assert [t[2] for t in top] == sorted(want.values(), reverse=True)[:3]


def test_pairs_are_spread_over_tasks_by_their_number(spark, touches, monkeypatch):
    df, rows = touches
    asked = []
    plain = pairs.materialize_in
    monkeypatch.setattr(pairs, "materialize_in", lambda d, parts: asked.append(parts) or plain(d, parts))
    monkeypatch.setattr(pairs, "TASK_PAIRS", 30)
    got = {(r["developer1"], r["developer2"]): r["shared_files"] for r in pairs.developer_pairs(df).collect()}
    want = Counter()
    for f in {r[0] for r in rows}:
        want.update(itertools.combinations(sorted({r[1] for r in rows if r[0] == f}), 2))
    assert got == dict(want) and asked == [-(-sum(want.values()) // 30)] and asked[0] > 4
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    assert spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled") == "true"


@pytest.mark.parametrize("tile", [4096, 4])
def test_cocommit_edges_match_nested_loops(spark, touches, tile):
    df, rows = touches
    releases = [
        ("x", dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 20, 5)),
        ("y", dt.datetime(2020, 1, 8), dt.datetime(2020, 1, 8)),
        ("z", dt.datetime(2020, 1, 10, 3), dt.datetime(2020, 3, 1)),
        ("open", dt.datetime(2020, 1, 1), None),
    ]
    frame = spark.createDataFrame(releases, "release string, start_date timestamp, end_date timestamp")
    want, active = Counter(), set()
    for name, start, end in releases:
        inside = [r for r in rows if end and start <= r[2] <= end]
        active |= {(name, r[1]) for r in inside}
        for l, r in itertools.combinations(inside, 2):
            if l[0] == r[0] and l[1] != r[1] and abs(l[2] - r[2]) <= dt.timedelta(days=7):
                want[name, min(l[1], r[1]), max(l[1], r[1])] += 1
    nodes, edges = pairs.cocommit_graph(df, frame, tile=tile)
    assert {(r["release"], r["a"], r["b"]): r["weight"] for r in edges.collect()} == dict(want)
    assert {(r["release"], r["node"]) for r in nodes.collect()} == active


def test_packed_graphs_in_blocks_of_sources(spark, frames, monkeypatch):
    """All measures from one search, whose components have more sources than a block seats."""
    monkeypatch.setattr(traversal, "SEATS", 4)
    graphs = packed.pack(*frames)
    found = packed.search(graphs.parts, loads=True, sums=True)
    depth = by_release(packed.diameters(graphs, found), "diameter")
    assert depth == {"star": 2, "path": 3, "cycle": 2, "two": 1, "single": 0, "pair": 1, "long": 9}
    most = by_release(packed.betweenness(graphs, found), "max_betweenness")
    assert most["star"] == pytest.approx(1.0) and most["long"] == pytest.approx(20 / 36) and most["single"] == 0
    near = by_release(packed.closeness(graphs, found), "avg_closeness")
    reach = [distances(GRAPHS["long"][0], GRAPHS["long"][1], n) for n in GRAPHS["long"][0]]
    assert near["long"] == pytest.approx(sum(9 / sum(d.values()) for d in reach) / 10)
    assert near["two"] == 0 and near["single"] == 0 and near["pair"] == 1
    assert by_release(packed.clustering(graphs), "avg_clustering")["two"] == pytest.approx(3 / 7)


def test_graphs_too_large_to_pack_go_over_joins(frames, monkeypatch):
    monkeypatch.setattr(packed, "GRAPH_EDGES", 4)
    assert packed.pack(*frames).shapes.count() == len(GRAPHS) - 2
    rows = graph.graph_components(*frames)
    assert by_release(rows, "num_components") == {g: 3 if g == "two" else 1 for g in GRAPHS}


def test_triangles_and_smallest_linked_of_a_made_graph(monkeypatch):
    monkeypatch.setattr(packed, "WEDGES", 50)
    rng = np.random.default_rng(3)
    n = 60
    pairs_ = sorted({tuple(sorted(p)) for p in rng.integers(0, n, (90, 2)).tolist() if p[0] != p[1]})
    a, b = np.array(pairs_, np.int32).T
    near = np.zeros((n, n), int)
    near[a, b] = near[b, a] = 1
    assert packed.triangles(n, a, b, near.sum(1)).tolist() == (np.diag(near @ near @ near) // 2).tolist()
    node, other = np.nonzero(near)
    label = packed.smallest_linked(n, other.astype(np.int32), near.sum(1))
    reach = np.linalg.matrix_power(near + np.eye(n, dtype=int), 8) > 0
    for _ in range(4):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    assert label.tolist() == reach.argmax(1).tolist()


def test_slots_end_at_bounds_only(spark):
    """A long interval is one slot, however many days it has; overlapping ones share slots."""
    day = dt.datetime(2020, 1, 1)
    rows = [("a", day, day + dt.timedelta(days=100)), ("b", day + dt.timedelta(days=50, hours=3), day + dt.timedelta(days=120))]
    frame = spark.createDataFrame(rows, "release string, s timestamp, e timestamp")
    slots, members = intervals.interval_slots(frame, ["release"], "s", "e")
    assert sorted(r["release"] for r in members.collect()) == ["a", "a", "b", "b"]
    events = spark.createDataFrame([(i, day + dt.timedelta(days=i)) for i in range(-1, 122)], "i int, at timestamp")
    held = intervals.attach_slot(events, slots, "at").join(members, "slot")
    got = {g: sorted(r["i"] for r in held.collect() if r["release"] == g) for g in "ab"}
    assert got == {"a": [*range(0, 101)], "b": [*range(51, 121)]}
