"""Operators on small graphs with known answers."""

import itertools

import pytest

from netlens import graph as G
from netlens.graph import graph
from netlens.operators import centrality, communities, components, flow, generate, matrix, paths, report, structure, trees


def make(spark, edges, n=None):
    rows = [(u, v, float(w[0]) if w else 1.0) for u, v, *w in edges]
    e = spark.createDataFrame(rows, "src long, dst long, weight double")
    return graph(e, spark.range(n) if n is not None else None)


def values(df, key="id", value="value"):
    return {r[key]: r[value] for r in df.collect()}


def one(df):
    return df.first()[0]


@pytest.fixture(scope="module")
def dag(spark):
    return make(spark, [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)]).saved()


@pytest.fixture(scope="module")
def cliques(spark):
    return generate.two_cliques_bridge(spark, 4).saved()


def test_empty_graph(spark):
    g = generate.empty(spark, 0)
    assert G.is_empty(g) and G.is_empty(g, "vertices") and one(G.is_complete(g)) and one(structure.density(g)) == 0.0
    assert one(components.is_connected(g)) and components.scc(g).count() == 0 and one(structure.assortativity(g)) == 0.0
    assert one(structure.average_clustering(g)) == 0.0 and one(structure.transitivity(g)) == 0.0
    assert centrality.pagerank(g).count() == 0 and paths.topological_levels(g).count() == 0
    assert structure.structural_summary(g).first().topology == "empty"
    assert components.biconnected(g).count() == 0 and trees.minimum_spanning_forest(g).count() == 0


def test_complete(spark):
    g = generate.complete(spark, 5).saved()
    assert g.edges.count() == 20 and one(G.is_complete(g)) and one(structure.density(g)) == 1.0
    assert set(values(structure.clustering(g)).values()) == {1.0} == set(values(structure.clustering(g, "directed")).values())
    assert set(values(centrality.betweenness_centrality(g)).values()) == {0.0}
    assert all(v == pytest.approx(0.2) for v in values(centrality.pagerank(g)).values())
    assert communities.label_propagation(g).select("component").distinct().count() == 1
    assert tuple(structure.diameter_and_radius(g).first()) == (1.0, 1.0)
    assert one(structure.planarity_screen(g)) is False and one(structure.triangles(g)) == 10


def test_star_path_cycle(spark):
    s = generate.star(spark, 5).saved()
    assert s.vertices.count() == 6 and s.edges.count() == 10
    close = values(centrality.closeness_centrality(s))
    assert max(close, key=close.get) == 0 and values(centrality.betweenness_centrality(s))[0] == pytest.approx(1.0)
    assert not one(structure.is_regular(s)) and one(trees.is_tree(s)) and one(components.is_bipartite(s))
    p = generate.path(spark, 4).saved()
    blocks = components.biconnected(p)
    assert {r.id for r in components.articulation_points(blocks).collect()} == {1, 2} and components.bridges(blocks).count() == 3
    assert structure.diameter_and_radius(p).first().diameter == 3.0
    c = graph(spark.range(5).selectExpr("id AS src", "(id + 1) % 5 AS dst")).saved()
    assert {r.component for r in components.scc(c).collect()} == {0} and one(components.is_strongly_connected(c))
    assert one(structure.density(c)) == pytest.approx(0.25) and not one(components.is_bipartite(c))
    assert paths.topological_levels(c) is None and paths.has_cycle(c) and paths.has_cycle(c, directed=False)
    assert generate.cycle(spark, 2).edges.count() == 2 and generate.cycle(spark, 5).edges.count() == 10


def test_two_cliques(spark, cliques):
    assert cliques.vertices.count() == 7
    b = values(centrality.betweenness_centrality(cliques))
    assert max(b, key=b.get) == 0
    blocks = components.biconnected(cliques)
    assert {r.id for r in components.articulation_points(blocks).collect()} == {0} and blocks.select("block").distinct().count() == 2
    comm = cliques.vertices.selectExpr("id", "CASE WHEN id < 4 THEN 0 ELSE 4 END AS component")
    assert one(communities.modularity(cliques, comm)) > 0.2
    assert {r.id for r in communities.bridging_ties(cliques, comm).collect()} == {0, 4, 5, 6}
    assert communities.bridging_ties(cliques, comm, "betweenness").first().id == 0
    assert communities.label_propagation(generate.two_cliques_bridge(spark, 5)).select("component").distinct().count() >= 1
    report_ = communities.community_report(comm, members=2).collect()
    assert {(r.component, r.size, tuple(r.first_members), r.more) for r in report_} == {(0, 4, (0, 1), 2), (4, 3, (4, 5), 1)}


def test_girvan_newman(spark):
    g = make(spark, [e for a, b in [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5)] for e in ((a, b), (b, a))])
    assert values(communities.girvan_newman(g, 2), value="component") == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 3}
    with pytest.raises(ValueError):
        communities.girvan_newman(g, 0)
    assert values(centrality.edge_betweenness(g), "u")[2] == pytest.approx(9.0)


def test_traversal(spark, dag):
    start = spark.createDataFrame([(0,)], "id long")
    order = paths.bfs(dag, start).orderBy("pos").collect()
    assert [(r.id, r.dist, r.pred, r.pos) for r in order] == [(0, 0, None, 0), (1, 1, 0, 1), (2, 1, 0, 2), (3, 2, 1, 3), (4, 3, 3, 4)]
    assert [r.path for r in paths.path_to(paths.bfs(dag, start), spark.createDataFrame([(4,)], "id long")).collect()] == [[0, 1, 3, 4]]
    assert {r.id: (r.level, r.pos) for r in paths.topological_levels(dag).collect()} == {0: (0, 0), 1: (1, 1), 2: (1, 2), 3: (2, 3), 4: (3, 4)}
    assert not paths.has_cycle(dag) and paths.has_cycle(dag, directed=False)
    assert {r.id for r in paths.reachable(dag, spark.createDataFrame([(1,)], "id long")).collect()} == {1, 3, 4}
    assert sum(values(centrality.pagerank(dag)).values()) == pytest.approx(1.0)
    assert one(paths.distance_stats(dag)) == 3


def test_bfs_order_matches_a_queue(spark):
    g = generate.erdos_renyi(spark, 30, 0.12, 7).saved()
    near = {r.id: r.neighbors for r in G.neighbors(g, "out").collect()}
    for s in (0, 11):
        seen, queue = [s], [s]
        while queue:
            for v in near[queue.pop(0)]:
                if v not in seen:
                    seen.append(v)
                    queue.append(v)
        got = paths.bfs(g, spark.createDataFrame([(s,)], "id long")).orderBy("pos").collect()
        assert [r.id for r in got] == seen


def test_weighted_paths(spark):
    g = make(spark, [(0, 1, 1), (1, 2, 2), (0, 2, 5), (2, 3, 1)])
    r = paths.shortest_path(g, 0, 3).first()
    assert (r.reachable, r.distance, r.path) == (True, 4.0, [0, 1, 2, 3])
    r = paths.shortest_path(g, 0, 3, spark.createDataFrame([(0, 4.0), (1, 3.0), (2, 1.0)], "id long, h double")).first()
    assert r.distance == 4.0
    r = paths.shortest_path(g, 3, 0).first()
    assert (r.reachable, r.distance, r.path) == (False, None, None)
    neg = make(spark, [(0, 1, 4), (0, 2, 5), (1, 2, -2)])
    start = spark.createDataFrame([(0,)], "id long")
    dist, cycle = paths.bellman_ford(neg, start)
    assert values(dist, value="dist") == {0: 0.0, 1: 4.0, 2: 2.0} and not cycle
    with pytest.raises(ValueError):
        paths.sssp(neg, start)
    assert paths.bellman_ford(make(spark, [(0, 1, 1), (1, 0, -2)]), start)[1]
    far = {(r.source, r.id): r.dist for r in paths.all_pairs(g, batch=2).collect()}
    assert far[0, 3] == 4.0 and far[2, 2] == 0.0 and (3, 0) not in far


def test_scc_and_blocks_match_brute_force(spark):
    g = generate.erdos_renyi(spark, 18, 0.13, 3)
    g = graph(g.edges.where("(src * 7 + dst * 5) % 3 > 0"), g.vertices).saved()
    e = {(r.src, r.dst) for r in g.edges.collect()}
    reach = {a: {a} for a in range(18)}
    for _ in range(18):
        for a, b in e:
            for s in reach.values():
                if a in s:
                    s.add(b)
    assert values(components.scc(g), value="component") == {a: min(b for b in reach[a] if a in reach[b]) for a in range(18)}
    p = {tuple(sorted(x)) for x in e}

    def parts(pairs, ids):
        label = {i: i for i in ids}
        for _ in ids:
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        return label

    blocks = components.biconnected(g)
    cut = {r.id for r in components.articulation_points(blocks).collect()}
    ids = {x for q in p for x in q}
    whole = parts(p, ids)
    for x in ids:
        rest = ids - {x}
        near = {parts([q for q in p if x not in q], rest)[y] for y in rest if whole[y] == whole[x]}
        assert (len(near) > 1) == (x in cut)
    bridge = {(r.u, r.v) for r in components.bridges(blocks).collect()}
    assert bridge == {q for q in p if parts(p - {q}, ids)[q[0]] != parts(p - {q}, ids)[q[1]]}


def test_spanning_forest_is_kruskal(spark):
    g = generate.erdos_renyi(spark, 25, 0.15, 9)
    g = graph(g.edges.selectExpr("src", "dst", "(least(src, dst) * 7 + greatest(src, dst) * 3) % 5 + 1.0 AS weight"), g.vertices).saved()
    rows = sorted({(r.weight, min(r.src, r.dst), max(r.src, r.dst)) for r in g.edges.collect()})
    parent = list(range(25))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    want = set()
    for w, a, b in rows:
        if root(a) != root(b):
            parent[root(a)] = root(b)
            want.add((a, b, w))
    assert {(r.u, r.v, r.weight) for r in trees.minimum_spanning_forest(g).collect()} == want


def test_flow_equals_cut(spark):
    g = make(spark, [(0, 1, 3), (0, 2, 2), (1, 2, 1), (1, 3, 2), (2, 3, 4), (3, 1, 5)]).saved()
    value, used = flow.max_flow(g, 0, 3)
    assert value == 5.0
    f = {(r.src, r.dst): r.flow for r in used.collect()}
    for x in (1, 2):
        assert sum(v for (a, b), v in f.items() if b == x) == pytest.approx(sum(v for (a, b), v in f.items() if a == x))
    cut, side = flow.min_cut(g, 0, 3)
    inside = {r.id for r in side.collect() if r.source_side}
    assert cut == value == sum(r.weight for r in g.edges.collect() if r.src in inside and r.dst not in inside)
    assert flow.max_flow(g, 2, 2)[0] == 0.0


def test_structure(spark):
    g = make(spark, [(0, 1), (1, 2), (2, 3)], 5).saved()
    assert {r.id for r in structure.vertices_by_pattern(g, "source").collect()} == {0}
    assert {r.id for r in structure.vertices_by_pattern(g, "sink").collect()} == {3}
    assert {r.id for r in structure.vertices_by_pattern(g, "isolated").collect()} == {4}
    s = structure.structural_summary(g).first()
    assert (s.vertices, s.edges, s.isolated, s.topology, s.max_id, s.min_id) == (5, 3, 1, "has isolated vertices", 1, 4)
    assert structure.eccentricity(g).first().value == float("inf")
    chain = make(spark, [(0, 1), (1, 2)])
    assert one(structure.density(chain)) == pytest.approx(1 / 3) and values(structure.clustering(chain))[1] == 0.0
    dc = values(centrality.degree_centrality(chain, "half"))
    assert dc[1] > dc[0]
    triples = {(r.row, r.col): r.value for r in matrix.laplacian_coo(chain).collect()}
    assert triples == {(0, 0): 1.0, (1, 1): 1.0, (2, 2): 0.0, (0, 1): -1.0, (1, 2): -1.0}
    assert [r.id for r in report.top_k(centrality.degree_centrality(chain, "total"), 2).collect()] == [1, 0]


def test_editing_returns_new_graphs(spark):
    g = make(spark, [(0, 1, 2), (1, 2, 3)])
    more = G.upsert_edges(g, spark.createDataFrame([(0, 1, 9.0), (2, 0, None), (2, 2, 1.0)], "src long, dst long, weight double"))
    assert {tuple(r) for r in more.edges.collect()} == {(0, 1, 9.0), (1, 2, 3.0), (2, 0, 1.0)}
    assert G.remove_edges(more, g.edges).edges.count() == 1 and g.edges.count() == 2
    assert {r.id: r.weight for r in G.set_vertex_weights(g, spark.createDataFrame([(1, 5)], "id long, weight int")).vertices.collect()} == {0: 1.0, 1: 5.0, 2: 1.0}
    assert G.add_vertices(g, spark.createDataFrame([(7, "x", 1.0), (0, "y", 2.0)], "id long, label string, weight double")).vertices.count() == 4
    assert graph(spark.createDataFrame([(1, 1, 1.0), (1, 2, 0.0), (None, 2, 1.0)], "src long, dst long, weight double")).edges.count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_results_do_not_depend_on_partitioning(spark, parts):
    g = generate.erdos_renyi(spark, 40, 0.08, 5)
    h = G.Graph(g.vertices.repartition(parts), g.edges.repartition(parts))
    for f in (components.connected_components, communities.label_propagation):
        assert sorted(f(g).collect()) == sorted(f(h).collect())


def test_generators(spark):
    a, b = generate.erdos_renyi(spark, 200, 0.05, 1), generate.erdos_renyi(spark, 200, 0.05, 1)
    assert sorted(a.edges.collect()) == sorted(b.edges.collect()) and 700 < a.edges.count() / 2 < 1300
    ba = generate.barabasi_albert(spark, 300, 3)
    degree = sorted((r.degree for r in G.degrees(ba).collect()), reverse=True)
    assert degree[0] > 5 * degree[len(degree) // 2] and one(components.is_connected(ba))
    with pytest.raises(ValueError):
        generate.barabasi_albert(spark, 3, 3)
    ws = generate.watts_strogatz(spark, 60, 4, 0.2)
    assert ws.edges.count() == 240 and generate.watts_strogatz(spark, 20, 4, 0.0).edges.count() == 80
    assert communities.wl_compare(a, b) == "not distinguished" and communities.wl_compare(a, ba) == "different"
