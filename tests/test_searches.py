"""Searches of many sources in tasks against the same as joins."""

import random

import pytest

from netlens import graph as G
from netlens.operators import centrality, communities, paths, structure, trees
from netlens.plans import searches
from netlens.plans.loop import dense_index


def rows(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def sparse(spark):
    """Two random parts of 20 and 14 vertices and four lone ones."""
    rng = random.Random(5)
    edges = {(rng.randrange(20), rng.randrange(20)) for _ in range(40)} | {(20 + rng.randrange(14), 20 + rng.randrange(14)) for _ in range(20)}
    edges = spark.createDataFrame([(3 * u, 3 * v, float(rng.randrange(1, 6))) for u, v in sorted(edges) if u != v], "src long, dst long, weight double")
    return G.graph(edges, spark.createDataFrame([(3 * i,) for i in range(38)], "id long")).saved()


@pytest.mark.parametrize("step", [1 << 20, 3])
def test_tasks_equal_joins(spark, sparse, monkeypatch, step):
    ids = sparse.vertices.select("id")
    found = lambda: [
        rows(paths.levels(sparse.edges.select("src", "dst"), ids)),
        rows(paths.bfs(sparse, ids).select("source", "id", "dist", "pred", "pos")),
        rows(paths.sssp(sparse, ids).select("source", "id", "dist", "pred")),
        rows(paths.distance_stats(sparse)),
        *[rows(centrality.closeness_centrality(sparse, kind)) for kind in ("out", "out_wf", "und_wf")],
        rows(structure.eccentricity(sparse)),
        rows(centrality.betweenness_centrality(sparse)),
        rows(centrality.edge_betweenness(sparse)),
        rows(centrality.sampled_betweenness(sparse, 0.5, first=50)),
    ]
    monkeypatch.setattr(searches, "STEP", step)
    tasks = found()
    monkeypatch.setattr(searches, "EDGES", 0)
    monkeypatch.setattr(centrality, "BROADCAST_EDGES", 0)
    for one, two in zip(tasks, found()):
        assert one == two


def test_text_ids(spark):
    e = spark.createDataFrame([(f"v{i:02}", f"v{i + 1:02}") for i in range(20)], "src string, dst string")
    g = G.graph(e)
    got = {(r.source, r.id): r.dist for r in paths.levels(g.edges.select("src", "dst"), g.vertices.select("id")).collect()}
    assert got == {(f"v{i:02}", f"v{j:02}"): j - i for i in range(21) for j in range(i, 21)}


def test_jobs_do_not_go_with_the_levels(spark):
    """A path of 120: a round per level took hundreds of jobs."""
    e = spark.createDataFrame([(i, i + 1) for i in range(120)], "src long, dst long")
    g = G.graph(e).saved()
    tracker = spark.sparkContext.statusTracker()
    for i, search in enumerate([paths.distance_stats, structure.eccentricity, centrality.closeness_centrality, lambda g: paths.bfs(g, g.vertices.select("id")), lambda g: paths.sssp(g, g.vertices.select("id"))]):
        spark.sparkContext.setJobGroup(f"searches-{i}", "")
        search(g).count()
        assert len(tracker.getJobIdsForGroup(f"searches-{i}")) < 60
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_components_enough_need_no_search(spark, sparse, monkeypatch):
    monkeypatch.setattr(communities, "path_shares", None)
    assert {r.component for r in communities.girvan_newman(sparse, 2).collect()} >= {0}


@pytest.mark.parametrize("step", [1 << 20, 3])
def test_triangles_in_tasks_equal_joins(spark, monkeypatch, step):
    """Random pairs and a hub; no row per pair of a vertex's pairs is shuffled."""
    rng = random.Random(7)
    edges = {(rng.randrange(25), rng.randrange(25)) for _ in range(160)} | {(30, i) for i in range(25)}
    g = G.graph(spark.createDataFrame(sorted(e for e in edges if e[0] != e[1]), "src long, dst long"), spark.createDataFrame([(i,) for i in range(33)], "id long")).saved()
    found = lambda: [rows(f(g)) for f in (structure.triangles, structure.triangle_counts, structure.clustering, lambda g: structure.clustering(g, "directed"), structure.transitivity)]
    monkeypatch.setattr(searches, "STEP", step)
    tasks = found()
    near = {frozenset(e) for e in edges if e[0] != e[1]}
    assert tasks[0] == [(sum(frozenset(x) in near and frozenset(y) in near and frozenset(z) in near for a in range(31) for b in range(a) for c in range(b) for x, y, z in [((a, b), (a, c), (b, c))]),)]
    monkeypatch.setattr(searches, "EDGES", 0)
    assert tasks == found()


@pytest.mark.parametrize("part", [100_000, 30])
def test_labels_in_tasks_equal_joins(spark, sparse, monkeypatch, part):
    """The rounds shuffle nothing, and a round is three small jobs."""
    monkeypatch.setattr(communities, "PART", part)
    joins = rows(communities._labels_by_joins(sparse.vertices.select("id"), G.both_ways(sparse), 50, 42))
    names = {r.k: r.id for r in dense_index(sparse.vertices.select("id"), ["id"], "k").collect()}
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"labels-{part}", "")
    tasks = [(i, names[l]) for i, l in rows(communities._labels_in_tasks(sparse.vertices.select("id"), G.both_ways(sparse), 50, 42))]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert tasks == joins and len(tracker.getJobIdsForGroup(f"labels-{part}")) < 60
    found = rows(communities.label_propagation(sparse))
    monkeypatch.setattr(searches, "VERTICES", 0)
    assert found == rows(communities.label_propagation(sparse))
    assert not communities.label_propagation(G.graph(sparse.edges.limit(0))).count()


def test_forest_rounds_work_on_what_is_left(spark, monkeypatch):
    """A grid of distinct weights against Kruskal; a round after the first looks at no more pairs than components have between them."""
    rng = random.Random(3)
    edges = [(10 * i + j, 10 * x + y, float(rng.randrange(1, 9))) for i in range(10) for j in range(10) for x, y in ((i + 1, j), (i, j + 1)) if x < 10 and y < 10]
    edges += [(200, 201, 1.0), (201, 202, 1.0), (200, 202, 1.0)]
    home, want = {v: v for e in edges for v in e[:2]}, []
    for w, u, v in sorted((w, u, v) for u, v, w in edges):
        if home[u] != home[v]:
            want.append((u, v, w))
            old, new = home[u], home[v]
            home = {k: new if c == old else c for k, c in home.items()}
    sizes, keep = [], trees.saved
    monkeypatch.setattr(trees, "saved", lambda df: (out := keep(df)) and sizes.append(out.count() if set(df.columns) == {"a", "b", "e"} else 0) or out)
    got = trees.minimum_spanning_forest(G.graph(spark.createDataFrame(edges, "src long, dst long, weight double")))
    assert rows(got) == sorted(want, key=repr)
    left = [n for n in sizes if n]
    assert left and left[0] < len(edges) * 0.7 and left == sorted(left, reverse=True)
