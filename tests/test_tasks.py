"""Work that tasks do from the shared folder or on parts of a graph, against plain Python."""

import random

from netlens.graph import graph
from netlens.operators import centrality, components, paths, trees


def shuffled(spark):
    """MB of shuffle written so far."""
    found = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size())) / 1e6


def test_reach_moves_no_sketches(spark):
    rng = random.Random(1)
    n, edges = 3000, {(rng.randrange(3000), rng.randrange(3000)) for _ in range(6000)}
    g = graph(spark.createDataFrame(sorted((a, b, 1.0) for a, b in edges if a != b), "src long, dst long, weight double"), spark.range(n)).saved()
    before = shuffled(spark)
    got = {(r.id, r.round): r.reached for r in centrality.approximate_reach(g, 4).collect()}
    assert shuffled(spark) - before < 4  # sketches of 4096 registers took 60 MB
    near = [set() for _ in range(n)]
    for a, b in edges:
        near[a].add(b), near[b].add(a)
    off = []
    for v in range(0, n, 10):
        ball = {v}
        for i in range(5):
            assert abs(got[v, i] - len(ball)) <= max(2, 0.1 * len(ball))
            off.append(got[v, i] / len(ball) - 1)
            ball = ball.union(*(near[x] for x in ball))
    assert len(got) == 5 * n and abs(sum(off) / len(off)) < 0.02


def test_levels_of_a_dense_graph_take_a_round_per_part(spark, monkeypatch):
    rng = random.Random(2)
    n, edges = 300, sorted({tuple(sorted(rng.sample(range(300), 2))) for _ in range(9000)})
    level = [0] * n
    for a, b in edges:
        level[b] = max(level[b], level[a] + 1)
    assert max(level) > 50
    monkeypatch.setattr(paths, "PEELED", 2000)  # four parts
    saves, keep = [], paths.saved
    monkeypatch.setattr(paths, "saved", lambda df: saves.append(1) or keep(df))
    g = graph(spark.createDataFrame([(a, b, 1.0) for a, b in edges], "src long, dst long, weight double"), spark.range(n)).saved()
    assert {r.id: r.level for r in paths.topological_levels(g).collect()} == dict(enumerate(level))
    assert len(saves) < 30
    # parts that wait for each other
    monkeypatch.setattr(paths, "PEELED", 4)
    path = graph(spark.createDataFrame([(0, 5, 1.0), (5, 1, 1.0), (1, 6, 1.0), (6, 2, 1.0), (0, 2, 1.0), (5, 6, 1.0), (0, 7, 1.0), (3, 7, 1.0)], "src long, dst long, weight double"), spark.range(9)).saved()
    assert {r.id: r.level for r in paths.topological_levels(path).collect()} == {0: 0, 5: 1, 1: 2, 6: 3, 2: 4, 3: 0, 7: 1, 4: 0, 8: 0}


def test_subtree_extremes_in_tasks_save_once(spark, monkeypatch):
    rng = random.Random(4)
    n, kids = 300, [[] for _ in range(300)]
    pred = [None] + [rng.randrange(max(0, v - 4), v) for v in range(1, n)]
    for v in range(1, n):
        kids[pred[v]].append(v)
    first, last, at, stack = [0] * n, [0] * n, 0, [(0, True)]
    while stack:  # an edge down and up takes a place each
        v, enters = stack.pop()
        if v and enters:
            first[v] = 2 * at + 1
        elif v:
            last[v] = 2 * at + 1
        at += bool(v)
        if enters:
            stack.append((v, False))
            stack.extend((k, True) for k in kids[v])
    last[0] = 2 * at
    values = [(v, rng.randrange(1000), rng.randrange(1000)) for v in range(n)]
    low, high = [x[1] for x in values], [x[2] for x in values]
    for v in range(n - 1, 0, -1):
        low[pred[v]], high[pred[v]] = min(low[pred[v]], low[v]), max(high[pred[v]], high[v])
    tour = spark.createDataFrame([(v, pred[v], first[v], last[v]) for v in range(n)], "id long, pred long, first long, last long")
    saves, keep = [], components.saved
    monkeypatch.setattr(components, "saved", lambda df: saves.append(1) or keep(df))
    got = components._subtree_extremes(tour, spark.createDataFrame(values, "id long, lo long, hi long"))
    assert sorted(map(tuple, got.collect())) == [(v, low[v], high[v]) for v in range(1, n)]
    assert len(saves) == 2


def bits(df):
    """Bits of the size that the optimizer expects of ``df``."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()).bit_length()


def test_expected_sizes_do_not_grow_with_the_rounds(spark, monkeypatch):
    """Blocks and bridges of two circles and a path: estimates multiplied from round to round took the driver's memory."""
    path = [(i, i + 1) for i in range(30)]
    edges = path + [(0, 10), (20, 30)]
    g = graph(spark.createDataFrame(edges, "src long, dst long")).saved()
    seen = []
    for module in (components, trees):
        keep = module.saved
        monkeypatch.setattr(module, "saved", lambda df, keep=keep: (out := keep(df), seen.append(bits(out)))[0])
    found = components.biconnected(g)
    assert sorted(map(tuple, components.bridges(found).collect())) == [(i, i + 1) for i in range(10, 20)]
    assert sorted(r.id for r in components.articulation_points(found).collect()) == list(range(10, 21))
    assert len(seen) > 20 and max(seen) < 500


def test_sums_of_shares_do_not_go_with_the_partitions(spark):
    """Every task used to send a row for each edge, also where only vertices were asked for, and there was a task per shuffle partition."""
    rng = random.Random(6)
    edges = sorted({(rng.randrange(300), rng.randrange(300)) for _ in range(24000)})
    g = graph(spark.createDataFrame([(a, b) for a, b in edges if a != b], "src long, dst long"), spark.range(300)).saved()
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        before = shuffled(spark)
        assert centrality.betweenness_centrality(g).count() == 300
        assert shuffled(spark) - before < 2
        assert centrality.edge_betweenness(g).count() == len({(min(e), max(e)) for e in edges if e[0] != e[1]})
        assert shuffled(spark) - before < 10
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
