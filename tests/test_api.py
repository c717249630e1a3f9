"""Relations of the graph API, joins of hot keys, searches by two ways, flows: each against plain Python."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from netlens import graph as G
from netlens.functions import activity
from netlens.graph import graph
from netlens.operators import centrality, communities, components, flow, report
from netlens.plans.loop import join_spread
from netlens.sources import readers, writers

EDGES = [(1, 2), (1, 3), (2, 3), (3, 1), (4, 3)]


def make(spark, edges):
    return graph(spark.createDataFrame([(u, v, float(w[0]) if w else 1.0) for u, v, *w in edges], "src long, dst long, weight double"))


@pytest.fixture(scope="module")
def small(spark):
    return make(spark, EDGES).saved()


def test_probes(spark, small):
    ends = list(itertools.product(range(1, 6), repeat=2))
    probes = spark.createDataFrame(ends, "u long, v long")
    assert {(r.u, r.v) for r in G.is_successor(small, probes).where("is_successor").collect()} == set(EDGES)
    assert {(r.u, r.v) for r in G.is_predecessor(small, probes).where("is_predecessor").collect()} == {(v, u) for u, v in EDGES}
    fours = [(*a, *b) for a in ends for b in ends if a[0] < 4 and b[1] < 4]
    two = spark.createDataFrame(fours, "u1 long, v1 long, u2 long, v2 long")
    for strict in (True, False):
        got = {tuple(r)[:4] for r in G.divergent(small, two, strict).where("divergent").collect()}
        assert got == {x for x in fours if x[:2] in EDGES and x[2:] in EDGES and x[0] == x[2] and (x[1] != x[3] or not strict)}
        got = {tuple(r)[:4] for r in G.convergent(small, two, strict).where("convergent").collect()}
        assert got == {x for x in fours if x[:2] in EDGES and x[2:] in EDGES and x[1] == x[3] and (x[0] != x[2] or not strict)}


def test_pairs_of_hubs(spark):
    rng = random.Random(1)
    edges = {(u, rng.randrange(100, 140)) for u in (1, 2, 3) for _ in range(30)} | {(u, 99) for u in range(1, 30)}
    g = make(spark, sorted(edges)).saved()
    for limit in (1, 7, 400, 10_000):
        want = sorted((u, a, b) for u, a in edges for x, b in edges if u == x and a < b)[:limit]
        assert [tuple(r) for r in G.divergent_pairs(g, limit).collect()] == want
        want = sorted((v, a, b) for a, v in edges for b, x in edges if v == x and a < b)[:limit]
        assert [tuple(r) for r in G.convergent_pairs(g, limit).collect()] == want


def test_labels_and_union(spark, small):
    named = G.set_labels(small, spark.createDataFrame([(1, "one"), (9, "nine")], "id long, label string"))
    assert {r.id: r.label for r in named.vertices.collect()} == {1: "one", 2: "2", 3: "3", 4: "4"}
    both = G.graph_union(small, make(spark, [(1, 2, 5), (7, 8)]))
    assert {(r.src, r.dst): r.weight for r in both.edges.collect()} == {**{e: 1.0 for e in EDGES}, (1, 2): 5.0, (7, 8): 1.0}
    assert {r.id for r in both.vertices.collect()} == {1, 2, 3, 4, 7, 8}


def test_colors_export_lines_and_report(spark, small, tmp_path):
    rows = activity.color_ramp(spark.createDataFrame([(1, 0.0), (2, 5.0), (3, 10.0)], "id long, m double"), "m", (0, 0, 0), (255, 255, 254))
    assert {r.id: r.color for r in rows.collect()} == {1: "#000000", 2: "#80807f", 3: "#fffffe"}
    paths = writers.export_four_graphs({"a": small, "b": small}, str(tmp_path), "g")
    assert len(paths) == 2 and readers.read_gexf(spark, paths[1])[0].edges.count() == len(EDGES)
    kind = sorted(readers.LINE_SCHEMAS)[0]
    field = readers.LINE_SCHEMAS[kind].split()[0].strip("`") if isinstance(readers.LINE_SCHEMAS[kind], str) else readers.LINE_SCHEMAS[kind].fieldNames()[0]
    (tmp_path / "x.jsonl").write_text("".join(json.dumps({field: None}) + "\n" for _ in range(3)))
    assert readers.read_raw_jsonl(spark, str(tmp_path / "x.jsonl"), kind).count() == 3
    tall = {(r.metric, r.id): r.value for r in report.full_analysis(small, "small").collect()}
    assert tall["vertices", None] == 4 and tall["edges", None] == 5 and tall["degree", "3"] == 4
    assert sum(v for (m, _), v in tall.items() if m == "community_size") == 4


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_of_hot_keys(spark, how):
    rows = [(7, i) for i in range(500)] + [(None, i) for i in range(300)] + [(i, i) for i in range(20)]
    df = spark.createDataFrame(rows, "k long, x long")
    table = spark.createDataFrame([(7, "a"), (3, "b"), (3, "c"), (99, "d")], "k long, y string")
    key = lambda r: (r.k is None, r.k or 0, r.x, r.y or "")
    want = sorted(df.join(table, "k", how).collect(), key=key)
    for least, most in ((10, 100), (10, 1), (10_000, 100)):
        assert sorted(join_spread(df, table, "k", how, least=least, most=most).collect(), key=key) == want


def test_hubs_of_components(spark, monkeypatch):
    monkeypatch.setattr(components, "SPREAD", 0)
    edges = [(0, i) for i in range(1, 3000)] + [(5000, i) for i in range(4000, 5000)] + [(4000, 6000)]
    got = {r.id: r.component for r in components.connected_components(make(spark, edges)).collect()}
    assert got == {**{i: 0 for i in range(3000)}, **{i: 4000 for i in [*range(4000, 5001), 6000]}}


def test_path_shares_by_joins_and_by_tasks(spark, monkeypatch):
    rng = random.Random(3)
    g = make(spark, sorted({tuple(rng.sample(range(9), 2)) for _ in range(14)})).saved()
    near = lambda df: {tuple(r)[:-1]: round(r.value, 9) for r in df.collect()}
    a, b = near(centrality.betweenness_centrality(g)), near(centrality.edge_betweenness(g))
    assert len({r.component for r in communities.girvan_newman(g, 3).collect()}) >= 3
    monkeypatch.setattr(centrality, "BROADCAST_EDGES", 0)
    assert near(centrality.betweenness_centrality(g)) == a and near(centrality.edge_betweenness(g)) == b


def test_flow_is_kept_and_equals_the_cut(spark):
    rng = random.Random(6)
    for n in (7,):
        edges = [(u, v, rng.randrange(1, 9)) for u, v in itertools.permutations(range(n), 2) if rng.random() < 0.45]
        g = make(spark, edges).saved()
        value, used = flow.max_flow(g, 0, n - 1)
        net = [0.0] * n
        for r in used.collect():
            assert r.flow <= {(u, v): w for u, v, w in edges}[r.src, r.dst] + 1e-9
            net[r.src] -= r.flow
            net[r.dst] += r.flow
        assert net == pytest.approx([-value, *[0.0] * (n - 2), value])
        cuts = (sum(w for u, v, w in edges if u in side and v not in side) for k in range(n - 1) for rest in itertools.combinations(range(1, n - 1), k) for side in [{0, *rest}])
        assert value == pytest.approx(min(cuts))
        cut, sides = flow.min_cut(g, 0, n - 1)
        inside = {r.id for r in sides.where("source_side").collect()}
        assert cut == value == pytest.approx(sum(w for u, v, w in edges if u in inside and v not in inside))
