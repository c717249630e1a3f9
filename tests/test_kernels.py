"""Searches from many vertices at once, as tasks run them, against plain Python."""

import collections
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from netlens.plans import searches


def net(tmp_path, n, edges, cuts=3, weights=None):
    """The edges in several files, as tasks read them."""
    edges = sorted(edges)
    for i in range(cuts):
        some = edges[i * len(edges) // cuts : (i + 1) * len(edges) // cuts]
        columns = {"a": np.array([e[0] for e in some], np.int32), "b": np.array([e[1] for e in some], np.int32)}
        if weights:
            columns["w"] = np.array([weights[e] for e in some], float)
        pq.write_table(pa.table(columns), tmp_path / f"part-{i}.parquet")
    return searches.Net(pa.table({"k": np.arange(n), "id": np.arange(n) * 10}), f"file://{tmp_path}")


def brandes(n, near, s):
    dist, paths, order = {s: 0}, collections.Counter({s: 1}), [s]
    for v in order:
        for w in near[v]:
            if w not in dist:
                dist[w] = dist[v] + 1
                order.append(w)
            if dist[w] == dist[v] + 1:
                paths[w] += paths[v]
    behind, share = collections.Counter(), collections.Counter()
    for v in reversed(order):
        for w in near[v]:
            if dist[w] == dist[v] + 1:
                share[v, w] = paths[v] / paths[w] * (1 + behind[w])
                behind[v] += share[v, w]
    return dist, behind, share


def graphs():
    rng = random.Random(3)
    dense = {(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(900)) if a != b}
    hub = {(0, i) for i in range(1, 90)} | {(i, 0) for i in range(1, 80)} | {(1, i) for i in range(2, 70)} | {(i, i + 1) for i in range(80, 99)}
    path = {(i, i + 1) for i in range(200)} | {(i + 1, i) for i in range(200)}
    parts = {(a, b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(90)) if a % 2 == b % 2 and a != b}
    return {"dense": (60, dense), "hub": (101, hub), "path": (203, path), "parts": (45, parts), "none": (3, {(0, 1)})}


@pytest.mark.parametrize("rows", [4096, 8])
@pytest.mark.parametrize("name", graphs())
@pytest.mark.parametrize("few", [True, False])
def test_flows_and_waves(tmp_path, monkeypatch, name, few, rows):
    n, edges = graphs()[name]
    monkeypatch.setattr(searches, "ROWS", rows)
    if not few:
        monkeypatch.setattr(searches, "STEP", 2)  # no level goes edge by edge
    near = collections.defaultdict(list)
    for a, b in sorted(edges):
        near[a].append(b)
    both = all((b, a) in edges for a, b in edges)
    for same in {both, False}:
        x = net(tmp_path, n, edges)
        inside, sums, reached = np.zeros(n), (np.zeros(len(edges)), np.zeros(len(edges))), []
        for lo in range(0, n, 8):
            reached.extend(x.flows(np.arange(lo, min(lo + 8, n)), inside, sums, same))
        want, share = np.zeros(n), collections.Counter()
        for s in range(n):
            dist, behind, own = brandes(n, near, s)
            assert reached[s] == len(dist)
            share.update(own)
            for v, d in behind.items():
                want[v] += d if v != s else 0
        got = sums[0] + x.pulls(same)[1].by_vertex(sums[1])
        assert np.allclose(inside, want, atol=1e-9)
        assert np.allclose(got, [share[int(a), int(b)] for a, b in zip(x.tail, x.head)], atol=1e-9)
    starts = np.arange(n)
    back = net(tmp_path, n, {(b, a) for a, b in edges})
    found = {}
    for depth, wave in enumerate(back.waves(starts)):
        for i in starts:
            found |= {(int(i), int(v)): depth for v in np.flatnonzero(wave[:, i >> 6] >> np.uint64(i & 63) & np.uint64(1))}
    assert found == {(s, v): d for s in range(n) for v, d in brandes(n, near, s)[0].items()}


def test_edges_in_any_order_of_files(tmp_path):
    n, edges = graphs()["dense"]
    x = net(tmp_path, n, edges, weights={(a, b): 100.0 * a + b for a, b in edges})
    (tmp_path / "part-0.parquet").rename(tmp_path / "part-9.parquet")
    y = searches.Net(pa.table({"k": np.arange(n), "id": np.arange(n)}), f"file://{tmp_path}")
    assert sorted(edges) == list(zip(y.tail.tolist(), y.head.tolist())) == list(zip(x.tail.tolist(), x.head.tolist()))
    assert (y.weight == 100.0 * y.tail + y.head).all() and (x.weight == y.weight).all() and (x.first == y.first).all()
