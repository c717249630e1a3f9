"""Maximum flow against augmenting paths, and its cost in jobs."""

import collections
import random

import pytest
from netlens.graph import graph
from netlens.operators import flow


def table(spark, edges, n=None):
    return graph(spark.createDataFrame([(u, v, float(w)) for u, v, w in edges], "src long, dst long, weight double"), spark.range(n) if n else None).saved()


def augmenting(edges, s, t):
    cap = collections.defaultdict(float)
    for u, v, w in edges:
        cap[u, v] += w
    near = collections.defaultdict(set)
    for u, v in list(cap):
        near[u].add(v)
        near[v].add(u)
    total = 0.0
    while True:
        back, queue = {s: s}, [s]
        for u in queue:
            for v in near[u]:
                if v not in back and cap[u, v] > 1e-9:
                    back[v] = u
                    queue.append(v)
        if t not in back:
            return total
        path, v = [], t
        while v != s:
            path.append((back[v], v))
            v = back[v]
        least = min(cap[e] for e in path)
        total += least
        for u, v in path:
            cap[u, v] -= least
            cap[v, u] += least


@pytest.mark.parametrize("seed,n,m", [(1, 8, 20), (2, 14, 40), (3, 14, 60), (4, 10, 12)])
def test_flow_of_random_graphs(spark, seed, n, m):
    rng = random.Random(seed)
    edges = sorted({(u, v): (u, v, rng.choice([1, 2, 3, 7, 0.5])) for u, v in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if u != v}.values())
    g = table(spark, edges, n)
    value, used = flow.max_flow(g, 0, n - 1)
    assert value == pytest.approx(augmenting(edges, 0, n - 1))
    got = {(r.src, r.dst): r.flow for r in used.collect()}
    cap = {(u, v): w for u, v, w in edges}
    assert all(x <= cap[e] + 1e-9 for e, x in got.items())
    balance = collections.Counter()
    for (u, v), x in got.items():
        balance[v] += x
        balance[u] -= x
    assert all(balance[v] == pytest.approx({0: -value, n - 1: value}.get(v, 0.0), abs=1e-6) for v in range(n))
    cut, side = flow.min_cut(g, 0, n - 1)
    inside = {r.id for r in side.collect() if r.source_side}
    assert cut == pytest.approx(value) and value == pytest.approx(sum(w for u, v, w in edges if u in inside and v not in inside))
    assert 0 in inside and (n - 1 not in inside)


def test_excess_returns_through_long_ways(spark):
    """Most of what the source sends ends nowhere; distances of the way back are long."""
    edges = [(i, i + 1, 5) for i in range(6)] + [(6, 7, 1), (7, 8, 1), (3, 9, 4), (9, 2, 1)]
    value, used = flow.max_flow(table(spark, edges), 0, 8)
    assert value == 1.0 and {(r.src, r.dst) for r in used.collect()} == {(i, i + 1) for i in range(8)}
    value, used = flow.max_flow(table(spark, [(0, 1, 5), (2, 3, 5)]), 0, 3)
    assert value == 0.0 and used.count() == 0


@pytest.fixture
def count_jobs(spark, monkeypatch):
    """Number of checkpoints and of Spark jobs of a call."""

    def run(f):
        saves = []
        keep = flow.saved
        monkeypatch.setattr(flow, "saved", lambda df: saves.append(1) or keep(df))
        spark.sparkContext.setJobGroup("counted", "")
        before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
        out = f()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) - before
        spark.sparkContext.setJobGroup("other", "")
        monkeypatch.setattr(flow, "saved", keep)
        return out, len(saves), jobs

    return run


def test_jobs_do_not_depend_on_idle_vertices(spark, count_jobs):
    """Isolated vertices, dead ends and vertices that the source does not reach cost nothing."""
    core = [(0, 1, 3), (0, 2, 2), (1, 2, 1), (1, 3, 2), (2, 3, 4), (3, 1, 5)]
    found = []
    for n in (10, 10_000):
        dead = [(1, 100 + i, 1) for i in range(n)] + [(200_000 + i, 3, 1) for i in range(n)]
        g = table(spark, core + dead, 400_000 if n > 10 else 20)
        (value, used), saves, jobs = count_jobs(lambda: flow.max_flow(g, 0, 3))
        assert value == 5.0
        found.append((saves, jobs))
    assert found[0][0] == found[1][0] and found[1][1] <= 1.2 * found[0][1]
