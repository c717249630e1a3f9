"""Centralities.  Vectors over vertices are DataFrames (id, value); loops join them with a saved edge table."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, both_ways, degrees, neighbor_counts, vertex_count
from ..plans import searches
from ..plans.loop import batches, dense_index, iterate, saved
from .paths import level_counts


def degree_centrality(g: Graph, variant: str = "neighbors") -> DataFrame:
    """(id, value): ``neighbors`` over n-1 (0 where n <= 1), ``total`` degree over n-1 (over 1 where n <= 1), ``half``: total over 2(n-1), or
    ``in_out``: columns in_degree, out_degree, in_value, out_value."""
    n = F.broadcast(vertex_count(g))
    if variant == "neighbors":
        return neighbor_counts(g).crossJoin(n).select("id", F.when(F.col("n") <= 1, 0.0).otherwise(F.col("n_neighbors") / F.greatest(F.col("n") - 1, F.lit(1))).alias("value"))
    d = degrees(g).crossJoin(n)
    over = F.greatest(F.col("n") - 1, F.lit(1))
    if variant == "total":
        return d.select("id", (F.col("degree") / over).alias("value"))
    if variant == "half":
        return d.select("id", (F.col("degree") / F.greatest(2 * (F.col("n") - 1), F.lit(1))).alias("value"))
    return d.select("id", "in_degree", "out_degree", (F.col("in_degree") / over).alias("in_value"), (F.col("out_degree") / over).alias("out_value"))


def closeness_centrality(g: Graph, variant: str = "out", batch: int = 1000) -> DataFrame:
    """(id, value) from reached vertices r and the sum s of their distances: ``out`` r/s; ``out_wf`` r/s * r/(n-1); ``und_wf`` the same on the undirected view."""
    moves, ids = saved(both_ways(g) if variant == "und_wf" else g.edges.select("src", "dst")), saved(g.vertices.select("id"))
    counts = level_counts(moves, ids, batch)
    sums = counts.groupBy(F.col("source").alias("id")).agg(F.sum(F.col("dist") * F.col("n")).alias("s"), (F.sum("n") - 1).alias("r"))
    n = F.broadcast(ids.agg(F.count("*").alias("n")))
    value = F.when(F.col("s") > 0, F.col("r") / F.when(F.col("s") > 0, F.col("s"))).otherwise(0.0)
    if variant != "out":
        value = value * (F.col("r") / F.greatest(F.col("n") - 1, F.lit(1)))
    return sums.crossJoin(n).select("id", value.alias("value"))


def approximate_reach(g: Graph, rounds: int, lg_k: int = 12) -> DataFrame:
    """(id, round, reached): estimates of how many vertices lie within each distance of the undirected view, by 2**lg_k registers of leading zeros per vertex that take their neighbours' maxima.

    An approximation (Boldi and Vigna 2013), for graphs on which exact distances from all sources are out of reach.  The estimate from registers is Ertl's (2017), relative standard
    error 1.04 / sqrt(2**lg_k).  Registers do not depend on each other, so tasks take some of them for all vertices; nothing of them is shuffled but two sums a vertex, round and task.
    """
    found = searches.register_sums(both_ways(g), g.vertices.select("id"), rounds, lg_k)
    m = float(1 << lg_k)
    empty = F.col("zeros") / m
    sigma = sum((F.pow(empty, F.lit(float(1 << i))) * float(1 << i - 1) for i in range(1, lg_k + 10)), empty)
    return found.select("id", "round", F.round(m * m / (2 * math.log(2)) / (F.col("total") - F.col("zeros") + m * sigma)).cast("long").alias("reached"))


def _dependencies(moves: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, id, dist, sigma, delta) and (source, src, dst, share): shortest path counts forward by level, dependencies backward."""
    kind = "double"
    seen = saved(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("dist"), F.lit(1.0).alias("sigma")))
    front, depth, by_level = seen, 0, [seen]
    while True:
        step = moves.join(front.select("source", F.col("id").alias("src"), "sigma"), "src").groupBy("source", F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma"))
        front = saved(step.join(seen.select("source", "id"), ["source", "id"], "left_anti").select("source", "id", F.lit(depth + 1).alias("dist"), "sigma"))
        if not front.limit(1).count():
            break
        depth += 1
        by_level.append(front)
        seen = saved(seen.union(front))
    below = by_level[-1].withColumn("delta", F.lit(0.0).cast(kind))
    done, shares = below, None
    for d in range(depth - 1, -1, -1):
        low = below.select("source", F.col("id").alias("dst"), F.col("sigma").alias("sw"), F.col("delta").alias("dw"))
        up = by_level[d].select("source", F.col("id").alias("src"), "sigma")
        share = saved(moves.join(low, "dst").join(up, ["source", "src"]).select("source", "src", "dst", (F.col("sigma") / F.col("sw") * (1 + F.col("dw"))).alias("share")))
        delta = share.groupBy("source", F.col("src").alias("id")).agg(F.sum("share").alias("delta"))
        below = saved(by_level[d].join(delta, ["source", "id"], "left").select("source", "id", "dist", "sigma", F.coalesce("delta", F.lit(0.0)).alias("delta")))
        done = done.union(below)
        shares = share if shares is None else shares.union(share)
    return done, shares


#: Edges up to which tasks read the whole edge table for path_shares(); beyond, searches are joins.
BROADCAST_EDGES = searches.EDGES


def path_shares(moves: DataFrame, sources: DataFrame, batch: int = 200, few: bool = False, before: searches.Shared | None = None, edges: bool = True, same: bool = False) -> DataFrame:
    """(src, dst, share, reached), saved: shortest paths from sources(id) over saved moves(src, dst), each split evenly among its ties.

    A row with ``dst`` (if ``edges``) has the sum of paths over that edge; rows with null ``dst`` have those through a vertex between their ends and, where it
    is a source, how many vertices it reaches (itself too).  Sources are dealt over the tasks.  ``few`` tells that the edges are known to be few enough, ``before`` has numbered them,
    ``same`` that every move goes both ways.
    """
    if few or searches.fits(moves, BROADCAST_EDGES):
        return saved(_share_sums(moves, sources, before, edges, same))
    out = None
    for some in batches(sources, batch):
        done, shares = _dependencies(moves, some)
        inner = done.groupBy("id").agg(F.sum(F.when(F.col("source") != F.col("id"), F.col("delta")).otherwise(0.0)).alias("share"))
        count = done.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("reached"))
        part = inner.join(count, "id", "left").select(F.col("id").alias("src"), F.lit(None).cast(moves.schema["dst"].dataType).alias("dst"), "share", "reached")
        if shares is not None and edges:
            part = part.union(shares.groupBy("src", "dst").agg(F.sum("share").alias("share")).withColumn("reached", F.lit(None).cast("long")))
        out = part if out is None else out.union(part)
    return saved(out.groupBy("src", "dst").agg(F.sum("share").alias("share"), F.max("reached").alias("reached")))


#: Numbers of all vertices in a table of _share_sums(), which has a column for each of 8 to 64 sources.
TABLE = 1 << 20


def _share_sums(moves: DataFrame, sources: DataFrame, before: searches.Shared | None, edges: bool, same: bool) -> DataFrame:
    """path_shares() of a graph of checked size: every task reads the edges from the shared folder and adds up over its sources.  There is a task a core, as each sends sums for all edges."""
    kind = moves.schema["src"].dataType.simpleString()

    def run(net: searches.Net, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        starts, reached, inside, out = rows["k"].to_numpy(), [], np.zeros(net.n), net.pulls(same)[1]
        on_edge = (np.zeros(len(net.head)), np.zeros(len(net.head))) if edges else None
        width = 1 << max(3, min(6, (TABLE // net.n).bit_length() - 1))
        for at in range(0, len(starts), width):
            reached.append(net.flows(starts[at : at + width], inside, on_edge, same))
        reached = np.concatenate(reached)
        for at in range(0, len(starts), searches.STEP):
            some = starts[at : at + searches.STEP]
            yield pa.RecordBatch.from_arrays([net.ids(some), pa.nulls(len(some), net.names.type), pa.array(np.zeros(len(some))), pa.array(reached[at : at + searches.STEP])], names=["src", "dst", "share", "reached"])
        within = np.flatnonzero(inside)
        parts = [(within, None, inside[within])]
        if edges:
            sums = on_edge[0]
            sums += out.by_vertex(on_edge[1])
            used = np.flatnonzero(sums)
            parts.append((net.tail[used], net.head[used], sums[used]))
        for one, two, shares in parts:
            for lo in range(0, len(one), searches.STEP):
                at = slice(lo, lo + searches.STEP)
                size = len(one[at])
                yield pa.RecordBatch.from_arrays([net.ids(one[at]), pa.nulls(size, net.names.type) if two is None else net.ids(two[at]), pa.array(shares[at]), pa.nulls(size, pa.int64())], names=["src", "dst", "share", "reached"])

    found = searches.spread(searches.shared(moves, sources, before), sources.select("id"), run, f"src {kind}, dst {kind}, share double, reached long", moves.sparkSession.sparkContext.defaultParallelism)
    return found.groupBy("src", "dst").agg(F.sum("share").alias("share"), F.max("reached").alias("reached"))


def betweenness_centrality(g: Graph, sources: DataFrame | None = None, batch: int = 200) -> DataFrame:
    """(id, value): directed, unweighted, scaled by 1/((n-1)(n-2)) where n > 2; ``sources(id)`` limits the start vertices."""
    ids = saved(g.vertices.select("id"))
    total = path_shares(saved(g.edges.select("src", "dst")), sources if sources is not None else ids, batch, edges=False)
    n = ids.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    sums = total.where("dst IS NULL").select(F.col("src").alias("id"), F.col("share").alias("d"))
    return ids.join(sums, "id", "left").select("id", (F.coalesce("d", F.lit(0.0)) * scale).alias("value"))


def _pair_parts(moves: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, id, part): the part of the shortest paths from s to t that pass id, for pairs(pair, s, t) and vertices between their ends.

    Paths are counted forward, level by level; a pair whose t is found goes no further; parts are handed back over the levels from t.
    """
    front = saved(pairs.select("pair", F.col("s").alias("id"), F.lit(1.0).alias("sigma"), "t"))
    seen, by_level, parts = front.select("pair", "id"), [front], []
    while True:
        step = moves.join(front.where("id <> t").withColumnRenamed("id", "src"), "src").groupBy("pair", F.col("dst").alias("id"), "t").agg(F.sum("sigma").alias("sigma"))
        new = saved(step.join(seen, ["pair", "id"], "left_anti").select("pair", "id", "sigma", "t"))
        if not new.limit(1).count():
            break
        found = new.where("id = t").select("pair")
        # of a pair that is found, only t itself matters on its level
        front = new.join(found, "pair", "left_anti").unionByName(new.where("id = t"))
        seen = saved(seen.union(new.select("pair", "id")))
        by_level.append(front)
    low = None
    for up, at in zip(by_level[-2::-1], by_level[:0:-1]):
        low = at.where("id = t").select("pair", "id", "sigma", F.lit(1.0).alias("part")).unionByName(low) if low is not None else at.where("id = t").select("pair", "id", "sigma", F.lit(1.0).alias("part"))
        sent = moves.join(low.withColumnRenamed("id", "dst"), "dst").select("pair", F.col("src").alias("id"), (F.col("part") / F.col("sigma")).alias("each")).groupBy("pair", "id").agg(F.sum("each").alias("each"))
        low = saved(up.join(sent, ["pair", "id"]).select("pair", "id", "sigma", (F.col("each") * F.col("sigma")).alias("part")))
        parts.append(low.select("pair", "id", "part"))
    parts = parts[:-1]  # the last level is that of s
    out = pairs.select("pair", F.col("s").alias("id"), F.lit(0.0).alias("part")).limit(0)
    for some in parts:
        out = out.union(some)
    return out


def _pair_searches(net: searches.Shared, pairs: DataFrame, kind: str) -> DataFrame:
    """_pair_parts() of pairs(pair, s, b), b being the number of t, dealt over tasks that read the edges."""

    def run(net: searches.Net, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        for pair, start, end in zip(rows["pair"].to_pylist(), rows["k"].to_pylist(), rows["b"].to_pylist()):
            dist, paths, levels = net.counted(start, end)
            if dist[end] < 0:
                continue
            part = np.zeros(net.n)
            part[end] = 1.0
            for at in reversed(levels):
                at = at[part[net.head[at]] > 0]
                tail, head = net.tail[at], net.head[at]
                part += np.bincount(tail, paths[tail] / paths[head] * part[head], net.n)
            part[[start, end]] = 0.0
            on = np.flatnonzero(part)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(on), pair)), net.ids(on), pa.array(part[on])], names=["pair", "id", "part"])

    return searches.spread(net, pairs.select("pair", F.col("s").alias("id"), "b"), run, f"pair long, id {kind}, part double", searches.TASKS * pairs.sparkSession.sparkContext.defaultParallelism)


def sampled_betweenness(g: Graph, epsilon: float = 0.05, delta: float = 0.1, seed: int = 1, first: int = 200) -> DataFrame:
    """(id, value, epsilon, delta, samples): betweenness from sampled pairs of vertices; with probability 1 - delta every value is within epsilon of betweenness_centrality().

    A pair gives each vertex the part of its shortest paths that pass it.  The sample is doubled until the empirical Bernstein bound (Maurer and Pontil 2009), with the
    risk divided among the vertices and the rounds, is below epsilon for all vertices.  Pairs are dealt over tasks that read the edges; where these are too many, searches are joins.
    """
    n = g.vertices.count()
    named = lambda value, r: g.vertices.select("id", value.alias("value"), F.lit(epsilon).alias("epsilon"), F.lit(delta).alias("delta"), F.lit(r).cast("long").alias("samples"))
    if n < 3:
        return named(F.lit(0.0), 0)
    moves, kind = saved(g.edges.select("src", "dst")), g.vertices.schema["id"].dataType.simpleString()
    net = searches.shared(moves, g.vertices) if searches.fits(moves) else None
    number = net.numbers if net else saved(dense_index(g.vertices.select("id"), ["id"], "k"))
    scale, totals, r, size = n / (n - 2), None, 0, first
    for k in itertools.count(1):
        at = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n))
        ends = g.spark.range(r, r + size).select(F.col("id").alias("pair"), at.alias("a"), F.pmod(at + 1 + F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(n - 1)), F.lit(n)).alias("b"))
        ends = ends.join(number.select(F.col("k").alias("a"), F.col("id").alias("s")), "a").join(number.select(F.col("k").alias("b"), F.col("id").alias("t")), "b").select("pair", "s", "b", "t")
        parts = _pair_searches(net, ends, kind) if net else _pair_parts(moves, saved(ends.drop("b")))
        sums = parts.groupBy("id").agg(F.sum("part").alias("s"), F.sum(F.col("part") * F.col("part")).alias("q"))
        totals = saved(sums if totals is None else totals.union(sums).groupBy("id").agg(F.sum("s").alias("s"), F.sum("q").alias("q")))
        r += size
        risk = math.log(4 * n * k * (k + 1) / delta)
        spread = F.greatest(F.lit(0.0), (F.col("q") - F.col("s") * F.col("s") / r) / (r - 1))
        worst = totals.agg(F.max(F.sqrt(spread * (2 * risk / r)))).first()[0] or 0.0
        if scale * (worst + 7 * risk / (3 * (r - 1))) <= epsilon:
            break
        size = r
    sums = totals.select("id", (F.col("s") / r * scale).alias("v"))
    return named(F.lit(0.0), r).drop("value").join(sums, "id", "left").select("id", F.coalesce("v", F.lit(0.0)).alias("value"), "epsilon", "delta", "samples")


def edge_betweenness(g: Graph, batch: int = 200) -> DataFrame:
    """(u, v, value): shortest paths of the undirected view through each pair, each path once."""
    return _pair_shares(path_shares(saved(both_ways(g)), saved(g.vertices.select("id")), batch, same=True))


def _pair_shares(shares: DataFrame) -> DataFrame:
    both = shares.where("dst IS NOT NULL")
    return both.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg((F.sum("share") / 2).alias("value"))


def _moved(old: DataFrame, new: DataFrame) -> float:
    """L1 distance of two vectors over the same ids."""
    return old.select("id", F.col("value").alias("a")).join(new.select("id", "value"), "id").agg(F.sum(F.abs(F.col("value") - F.col("a")))).first()[0] or 0.0


def pagerank(g: Graph, damping: float = 0.85, max_iter: int = 100, tol: float = 1e-6, weighted: bool = False) -> DataFrame:
    """(id, value): rank; the mass of vertices without out-edges is spread evenly; stops when the L1 change is below ``tol`` and returns the newest vector."""
    n = g.vertices.count()
    if not n:
        return g.vertices.select("id", F.lit(0.0).alias("value"))
    w = F.col("weight") if weighted else F.lit(1.0)
    out = g.edges.groupBy("src").agg(F.sum(w).alias("total"))
    shares = saved(g.edges.join(out, "src").select("src", "dst", (w / F.col("total")).alias("share")))
    ends = saved(g.vertices.select("id").join(out.select(F.col("src").alias("id"), F.lit(True).alias("has_out")), "id", "left"))
    start = ends.select("id", F.col("has_out").isNull().alias("dangling"), F.lit(1.0 / n).alias("value"))

    def step(state: DataFrame, _: int) -> DataFrame:
        lost = F.broadcast(state.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("value"))), F.lit(0.0)).alias("lost")))
        sent = shares.join(state.select(F.col("id").alias("src"), "value"), "src").groupBy("dst").agg(F.sum(F.col("share") * F.col("value")).alias("got"))
        new = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)
        return state.select("id", "dangling").join(sent, F.col("id") == F.col("dst"), "left").crossJoin(lost).select("id", "dangling", new.alias("value"))

    state, _ = iterate(start, step, lambda old, new, i: tol > 0 and _moved(old, new) < tol, max_iter)
    return state.select("id", "value")


def eigenvector_centrality(g: Graph, max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    """(id, value): power iteration over undirected neighbours from 1/n, L2-normalised (norm 0 counts as 1), stopped by L1 change."""
    n = max(g.vertices.count(), 1)
    moves = saved(both_ways(g))

    def step(state: DataFrame, _: int) -> DataFrame:
        sent = moves.join(state, moves.src == state.id).groupBy("dst").agg(F.sum("value").alias("got"))
        raw = state.select("id").join(sent, F.col("id") == F.col("dst"), "left").select("id", F.coalesce("got", F.lit(0.0)).alias("raw"))
        norm = F.broadcast(raw.agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm")))
        return raw.crossJoin(norm).select("id", (F.col("raw") / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)).alias("value"))

    start = g.vertices.select("id", F.lit(1.0 / n).alias("value"))
    return iterate(start, step, lambda old, new, i: tol > 0 and _moved(old, new) < tol, max_iter)[0]


def katz_centrality(g: Graph, alpha: float = 0.1, beta: float = 1.0, max_iter: int = 100, tol: float = 1e-6) -> DataFrame:
    """(id, value): beta + alpha times the sum over in-neighbours, from 0, not normalised."""
    moves = saved(g.edges.select("src", "dst"))

    def step(state: DataFrame, _: int) -> DataFrame:
        sent = moves.join(state, moves.src == state.id).groupBy("dst").agg(F.sum("value").alias("got"))
        return state.select("id").join(sent, F.col("id") == F.col("dst"), "left").select("id", (beta + alpha * F.coalesce("got", F.lit(0.0))).alias("value"))

    start = g.vertices.select("id", F.lit(0.0).alias("value"))
    return iterate(start, step, lambda old, new, i: tol > 0 and _moved(old, new) < tol, max_iter)[0]
