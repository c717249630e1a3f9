"""Loops whose rounds go with the logarithm, searches by buckets, and estimates with a stated error, against plain Python."""

import collections
import heapq
import itertools
import random

import pytest
from netlens import graph as G
from netlens.graph import graph
from netlens.operators import centrality, communities, components, generate, paths


def table(spark, edges, n=None):
    rows = [(u, v, float(w[0]) if w else 1.0) for u, v, *w in edges]
    return graph(spark.createDataFrame(rows, "src long, dst long, weight double"), spark.range(n) if n else None).saved()


def counted(monkeypatch, module, f):
    saves, keep = [], module.saved
    monkeypatch.setattr(module, "saved", lambda df: saves.append(1) or keep(df))
    out = f()
    monkeypatch.setattr(module, "saved", keep)
    return out, len(saves)


def test_a_long_path_takes_few_rounds(spark, monkeypatch):
    n = 5000
    g = graph(spark.range(n - 1).selectExpr("id AS src", "id + 1 AS dst")).saved()
    levels, saves = counted(monkeypatch, paths, lambda: paths.topological_levels(g))
    assert saves < 40 and levels.where("level <> id OR pos <> id").count() == 0 and levels.count() == n
    found, saves = counted(monkeypatch, components, lambda: components.scc(g))
    assert saves < 60 and found.where("component <> id").count() == 0 and found.count() == n
    circle = graph(spark.range(n).selectExpr("id AS src", f"(id + 1) % {n} AS dst")).saved()
    assert components.scc(circle).select("component").distinct().collect()[0][0] == 0 and paths.topological_levels(circle) is None


@pytest.mark.parametrize("seed", range(3))
def test_levels_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = {(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range([30, 60, 120][seed])) if a < b}
    edges |= {(40 + i, 41 + i) for i in range(9)} | {(5, 40), (49, 39)}  # a chain between
    level = {}
    before = collections.defaultdict(list)
    for a, b in edges:
        before[b].append(a)

    def of(v):
        if v not in level:
            level[v] = max((of(u) + 1 for u in before[v]), default=0)
        return level[v]

    got = {r.id: r.level for r in paths.topological_levels(table(spark, edges, 50)).collect()}
    assert got == {v: of(v) for v in range(50)}
    assert paths.topological_levels(table(spark, edges | {(39, 5), (5, 39)}, 50)) is None


def test_strong_components_with_chains_and_circles(spark):
    edges = [(0, 1), (1, 2), (2, 3), (3, 0), (3, 4), (4, 5), (5, 6), (6, 7), (7, 4), (10, 11), (11, 12), (12, 10), (12, 13), (13, 14), (14, 20), (20, 21), (21, 14), (30, 31), (31, 30), (2, 40), (40, 41), (41, 0), (50, 51)]
    ids = sorted({x for e in edges for x in e})
    reach = {a: {a} for a in ids}
    for _ in ids:
        for a, b in edges:
            for s in reach.values():
                if a in s:
                    s.add(b)
    got = {r.id: r.component for r in components.scc(table(spark, edges)).collect()}
    assert got == {a: min(b for b in reach[a] if a in reach[b]) for a in ids}


@pytest.mark.parametrize("width", [None, 0.7, 100.0])
def test_delta_stepping(spark, width):
    rng = random.Random(5)
    edges = list({(a, b): (a, b, rng.choice([0.5, 1, 1, 2, 3.5, 9])) for a, b in ((rng.randrange(25), rng.randrange(25)) for _ in range(90)) if a != b}.values())
    near = collections.defaultdict(list)
    for a, b, w in edges:
        near[a].append((b, w))
    want = {}
    for s in (0, 7):
        dist, heap = {}, [(0.0, s)]
        while heap:
            d, v = heapq.heappop(heap)
            if v not in dist:
                dist[v] = d
                for b, w in near[v]:
                    heapq.heappush(heap, (d + w, b))
        for v, d in dist.items():
            before = [a for a, b, w in edges if b == v and a in dist and dist[a] + w == d]
            want[s, v] = (d, min(before) if v != s else None)
    g = table(spark, edges, 25)
    start = spark.createDataFrame([(0,), (7,)], "id long")
    assert {(r.source, r.id): (r.dist, r.pred) for r in paths.delta_stepping(g, start, width).collect()} == want
    dist, cycle = paths.bellman_ford(g, start)
    assert not cycle and {(r.source, r.id): r.dist for r in dist.collect()} == {k: d for k, (d, _) in want.items()}
    goal = max((v for s, v in want if s == 0), key=lambda v: want[0, v][0])
    r = paths.shortest_path(g, 0, goal).first()
    assert r.distance == want[0, goal][0] and r.path[0] == 0 and r.path[-1] == goal
    assert all(want[0, b][1] == a for a, b in zip(r.path, r.path[1:]))


def test_sampled_betweenness(spark):
    g = generate.two_cliques_bridge(spark, 6).saved()
    exact = {r.id: r.value for r in centrality.betweenness_centrality(g).collect()}
    for epsilon in (0.2, 0.08):
        got = centrality.sampled_betweenness(g, epsilon).collect()
        assert len(got) == len(exact) and all(abs(r.value - exact[r.id]) <= epsilon == r.epsilon for r in got)
    assert got[0].samples >= 200 and got[0].delta == 0.1
    assert {r.value for r in centrality.sampled_betweenness(table(spark, [(0, 1)])).collect()} == {0.0}
    whole = centrality._pair_parts(G.both_ways(g), spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(itertools.permutations([r.id for r in g.vertices.collect()], 2))], "pair long, s long, t long"))
    n = len(exact)
    sums = {r.id: r.x for r in whole.groupBy("id").sum("part").toDF("id", "x").collect()}
    assert all(sums.get(i, 0.0) / ((n - 1) * (n - 2)) == pytest.approx(v) for i, v in exact.items())


def brute_girvan_newman(pairs, ids, k):
    pairs = set(pairs)
    while True:
        near = collections.defaultdict(set)
        for a, b in pairs:
            near[a].add(b)
            near[b].add(a)
        label = {}
        for i in sorted(ids):
            queue = [i] if i not in label else []
            for x in queue:
                if x not in label:
                    label[x] = i
                    queue += near[x]
        if len(set(label.values())) >= k or not pairs:
            return label
        share = collections.Counter()
        for s in ids:
            dist, sigma, order = {s: 0}, collections.Counter({s: 1}), [s]
            for v in order:
                for w in near[v]:
                    if w not in dist:
                        dist[w] = dist[v] + 1
                        order.append(w)
                    if dist[w] == dist[v] + 1:
                        sigma[w] += sigma[v]
            behind = collections.Counter()
            for w in reversed(order):
                for v in near[w]:
                    if dist[v] == dist[w] - 1:
                        x = sigma[v] / sigma[w] * (1 + behind[w])
                        share[min(v, w), max(v, w)] += x / 2
                        behind[v] += x
        pairs.remove(min(pairs, key=lambda p: (-round(share[p], 9), p)))


@pytest.mark.parametrize("seed,k", [(1, 3), (2, 5)])
def test_girvan_newman_is_brute_force(spark, seed, k):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(12), 2))) for _ in range(17)}
    g = table(spark, [e for a, b in pairs for e in ((a, b), (b, a))], 13)
    assert {r.id: r.component for r in communities.girvan_newman(g, k + 1).collect()} == brute_girvan_newman(pairs, range(13), k + 1)


def test_color_refinement(spark):
    rng = random.Random(8)
    edges = {(a, b) for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(45)) if a != b}
    g = table(spark, edges, 30)
    color = {v: (sum(b == v for _, b in edges), sum(a == v for a, _ in edges)) for v in range(30)}
    for _ in range(3):
        color = {v: (color[v], tuple(sorted(color[b] for a, b in edges if a == v)), tuple(sorted(color[a] for a, b in edges if b == v))) for v in range(30)}
    got = {r.id: r.c for r in communities.color_refinement(g, 3).collect()}
    assert all((got[a] == got[b]) == (color[a] == color[b]) for a, b in itertools.combinations(range(30), 2))


def test_blocks_of_a_star_and_of_deep_trees(spark, monkeypatch):
    star = graph(spark.range(1, 3001).selectExpr("0L AS src", "id AS dst")).saved()
    blocks = components.biconnected(star)
    assert blocks.select("block").distinct().count() == 3000
    n = 400
    path = graph(spark.range(n - 1).selectExpr("id AS src", "id + 1 AS dst").union(spark.sql(f"SELECT {n // 2}L, 0L"))).saved()
    found, saves = counted(monkeypatch, components, lambda: components.biconnected(path))
    assert saves < 90 and found.groupBy("block").count().where(f"count = {n // 2 + 1}").count() == 1
    assert found.select("block").distinct().count() == n - n // 2


def test_euler_tour_intervals_are_subtrees(spark):
    rng = random.Random(2)
    parent = {v: rng.randrange(v) for v in range(1, 60) if v != 30}
    forest = spark.createDataFrame([(p, v) for v, p in parent.items()], "u long, v long")
    home = components.components_of(spark.range(61), forest.selectExpr("u AS src", "v AS dst"))
    tour = {r.id: r for r in components.euler_tour(forest, home).collect()}
    assert len(tour) == 61 and {v: tour[v].pred for v in parent} == parent and tour[60].first == -1
    up = lambda v: {v} | (up(parent[v]) if v in parent else set())
    for a, b in itertools.product(range(60), repeat=2):
        if tour[a].first != tour[b].first or a == b:
            assert (tour[a].first <= tour[b].first <= tour[a].last) == (a in up(b))
