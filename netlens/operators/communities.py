"""Communities, modularity, bridging ties, and comparison of graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import Graph, both_ways, degrees, neighbor_counts, pairs
from ..plans import files, searches
from ..plans.loop import dense_index, join_spread, saved
from .centrality import BROADCAST_EDGES, betweenness_centrality, path_shares
from .components import components_of
from .paths import levels


def _labels_by_joins(ids: DataFrame, moves: DataFrame, max_iter: int, seed: int) -> DataFrame:
    """(id, label) after label_propagation()'s rounds over saved moves(src, dst)."""
    state = saved(ids.select("id", F.col("id").alias("label")))
    for i in range(max_iter):
        changed = 0
        for half in (0, 1):
            votes = moves.join(state.select(F.col("id").alias("src"), "label"), "src").groupBy(F.col("dst").alias("id"), "label").agg(F.count("*").alias("n"))
            votes = votes.join(state.select("id", F.col("label").alias("own")), "id")
            order = F.struct("n", (F.col("label") == F.col("own")).cast("int").alias("o"), F.xxhash64(F.lit(seed), F.lit(i), "label").alias("h"))
            best = votes.groupBy("id").agg(F.max_by("label", order).alias("new"))
            mine = F.pmod(F.xxhash64("id"), F.lit(2)) == half
            new = state.join(best, "id", "left").select("id", F.when(mine, F.coalesce("new", "label")).otherwise(F.col("label")).alias("label"), F.col("label").alias("old"))
            new = saved(new)
            changed += new.where("label <> old").count()
            state = new.select("id", "label")
        if not changed:
            break
    return state


#: Rounds whose hashes of labels are written at once.
AHEAD = 8
#: Rounds after which they look whether labels still move.
LOOK = 4
#: Rows of neighbours below which they are not dealt over more tasks, each of which reads all labels.
PART = 100_000


def _labels_in_tasks(ids: DataFrame, moves: DataFrame, max_iter: int, seed: int) -> DataFrame:
    """_labels_by_joins() without shuffles in the rounds: a task keeps the neighbours of its vertices, and reads all labels, of checked number, from the shared folder."""
    spark = ids.sparkSession
    numbers = saved(dense_index(ids, ["id"], "k").select("id", "k"))
    n, size = numbers.count(), moves.count()
    parts = max(1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions")), size // PART))
    a, b = numbers.select(F.col("id").alias("src"), F.col("k").alias("a")), numbers.select(F.col("id").alias("dst"), F.col("k").alias("b"))
    half = F.pmod(F.xxhash64("id"), F.lit(2)).cast("int").alias("half")
    near = moves.join(a, "src").join(b, "dst").select("a", "b", F.pmod(F.xxhash64("dst"), F.lit(2)).cast("int").alias("half"))
    near = near.union(numbers.select("k", "k", half)).withColumn("part", F.pmod("b", F.lit(parts)))  # a row of its own for each vertex
    near = files.written(near.repartition(parts, "part"), "near", "part")

    def step(labels: str | None, hashes: str, name: str, turn: int) -> str:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in (x for batch in batches for x in batch["id"].to_pylist()):
                rows = files.read(f"{near}/part={part}")
                now, rank = np.arange(n), np.zeros(n, np.int64)
                if labels:
                    old = files.read(labels)
                    now[old["k"].to_numpy()] = old["l"].to_numpy()
                table = files.read(hashes, ["k", name])
                rank[table["k"].to_numpy()] = table[name].to_numpy()
                yield _moved(rows["a"].to_numpy(), rows["b"].to_numpy(), rows["half"].to_numpy() == turn, parts, now, rank)

        return files.written(spark.range(0, parts, 1, parts).mapInArrow(task, "k long, l long, moved boolean"), "labels")

    table = lambda place: spark.read.schema("k long, l long, moved boolean").parquet(place)
    labels = None
    for i in range(max_iter if n else 0):
        if i % AHEAD == 0:
            hashes = files.written(numbers.select("k", *[F.xxhash64(F.lit(seed), F.lit(i + j), "id").alias(f"h{j}") for j in range(AHEAD)]), "hashes")
        first = step(labels, hashes, f"h{i % AHEAD}", 0)
        labels = step(first, hashes, f"h{i % AHEAD}", 1)
        # what once stays stays, as own labels win ties, so not every round need be looked at
        if i % LOOK == LOOK - 1 and not table(first).union(table(labels)).where("moved").limit(1).count():
            break
    if labels is None:
        return ids.select("id", F.col("id").alias("label"))
    return saved(table(labels).join(numbers, "k").select("id", F.col("l").alias("label")))


def _moved(a: np.ndarray, b: np.ndarray, moves: np.ndarray, parts: int, now: np.ndarray, rank: np.ndarray) -> pa.RecordBatch:
    """The new labels of the vertices that have a row b, b: for those that move, the commonest of the labels ``now`` of their neighbours a, ties to their own, then to the greatest ``rank``."""
    mine = b[a == b]
    new, at = now.copy(), moves & (a != b)
    if at.any():
        code, votes = np.unique(b[at] // parts * len(now) + now[a[at]], return_counts=True)
        vertex, label = code // len(now), code % len(now)
        to = vertex * parts + mine[0] % parts
        order = np.lexsort((rank[label], now[to] == label, votes, vertex))
        last = order[np.append(np.diff(vertex[order]) > 0, True)]
        new[to[last]] = label[last]
    return pa.RecordBatch.from_arrays([pa.array(mine), pa.array(new[mine]), pa.array(new[mine] != now[mine])], names=["k", "l", "moved"])


def label_propagation(g: Graph, max_iter: int = 50, seed: int = 42) -> DataFrame:
    """(id, component): majority label of the undirected neighbours until nothing changes.

    Half the vertices (by hash) move, then the other half, so labels do not oscillate; ties keep the own label if it is among
    the best, else go by hash of (seed, round, label).  Communities are named by their smallest member.
    """
    moves = saved(both_ways(g))
    if searches.fits(g.vertices, searches.VERTICES):
        state = _labels_in_tasks(g.vertices.select("id"), moves, max_iter, seed)
    else:
        state = _labels_by_joins(g.vertices.select("id"), moves, max_iter, seed)
    return join_spread(state, state.groupBy("label").agg(F.min("id").alias("component")), "label").select("id", "component")


def modularity(g: Graph, comm: DataFrame, variant: str = "newman") -> DataFrame:
    """One row for communities comm(id, component).

    ``newman``: over communities, L/m - (d/2m)^2 on the undirected view.  ``edges_only``: over directed edges inside
    communities, (1 - D_u D_v / 2m) / 2m, D being total degrees.
    """
    a, b = comm.select(F.col("id").alias("x"), F.col("component").alias("cx")), comm.select(F.col("id").alias("y"), F.col("component").alias("cy"))
    if variant == "edges_only":
        d = degrees(g)
        m = F.broadcast(g.edges.agg(F.count("*").alias("m")))
        e = g.edges.join(a, F.col("src") == F.col("x")).join(b, F.col("dst") == F.col("y")).where("cx = cy")
        e = e.join(d.select(F.col("id").alias("src"), F.col("degree").alias("du")), "src").join(d.select(F.col("id").alias("dst"), F.col("degree").alias("dv")), "dst")
        one = (1 - F.col("du") * F.col("dv") / (2 * F.col("m"))) / (2 * F.col("m"))
        return e.crossJoin(m).agg(F.coalesce(F.sum(one), F.lit(0.0)).alias("modularity"))
    p = pairs(g)
    m = F.broadcast(p.agg(F.count("*").alias("m")))
    inner = p.join(a, F.col("u") == F.col("x")).join(b, F.col("v") == F.col("y")).where("cx = cy").groupBy(F.col("cx").alias("component")).agg(F.count("*").alias("l"))
    mass = neighbor_counts(g).join(comm, "id").groupBy("component").agg(F.sum("n_neighbors").alias("d"))
    part = F.coalesce("l", F.lit(0)) / F.col("m") - F.pow(F.col("d") / (2 * F.col("m")), F.lit(2))
    return mass.join(inner, "component", "left").crossJoin(m).where("m > 0").agg(F.coalesce(F.sum(part), F.lit(0.0)).alias("modularity"))


def girvan_newman(g: Graph, k: int = 2) -> DataFrame:
    """(id, component) once there are at least k components, or no pairs: the pair of highest betweenness goes, ties to the smallest (u, v).  k < 1 raises ValueError.

    Betweenness is known for every component, and the leading pair of each is kept.  Taking a pair away changes its own component alone: only from that one's
    vertices paths are searched again.  It has come apart when an end of the pair does not reach all of it, and a search from that end parts it.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    both = both_ways(g)
    home = saved(components_of(g.vertices, both))
    both = saved(both.join(home.withColumnRenamed("id", "src"), "src").select("src", "dst", "component"))
    n = home.agg(F.count_distinct("component")).first()[0]
    if n >= k:
        return home
    few = searches.fits(both, BROADCAST_EDGES)
    net = searches.shared(both.select("src", "dst"), home) if few else None
    part = F.min(F.when(F.col("dst").isNotNull(), F.struct((-F.round(F.col("share"), 9)).alias("s"), F.col("src").alias("u"), F.col("dst").alias("v"))))

    def paired(shares: DataFrame) -> DataFrame:
        """Both directions of a pair together, u < v; rows of vertices as they are."""
        up = F.col("dst").isNull() | (F.col("src") < F.col("dst"))
        return shares.groupBy(F.when(up, F.col("src")).otherwise(F.col("dst")).alias("src"), F.when(up, F.col("dst")).otherwise(F.col("src")).alias("dst")).agg((F.sum("share") / 2).alias("share"), F.max("reached").alias("reached"))

    def leading(shares: DataFrame, where: DataFrame) -> DataFrame:
        """(component, top) of the components of where(id, component) that have pairs."""
        return shares.join(where.withColumnRenamed("id", "src"), "src").groupBy("component").agg(part.alias("top")).where("top IS NOT NULL")

    tops = saved(leading(paired(path_shares(both.select("src", "dst"), home.select("id"), few=few, before=net, same=True)), home))
    changed: dict = {}  # edges and vertices of the components that lost a pair, by name: one a round at most
    while n < k:
        best = tops.agg(F.min(F.struct("top.s", "top.u", "top.v", "component"))).first()[0]
        if best is None:
            break
        name, u, v = best.component, best.u, best.v
        edges, ids = changed.pop(name, None) or (both.where(F.col("component") == name).select("src", "dst"), home.where(F.col("component") == name).select("id"))
        edges = saved(edges.where(~(F.col("src").isin(u, v) & F.col("dst").isin(u, v))))
        shares = saved(paired(path_shares(edges, ids, few=few, before=net, same=True)))
        reached, size = shares.agg(F.max(F.when((F.col("src") == u) & F.col("dst").isNull(), F.col("reached"))), F.count(F.when(F.col("reached").isNotNull(), 1))).first()
        if reached == size:
            changed[name], where = (edges, ids), ids.select("id", F.lit(name).alias("component"))
        else:
            side = levels(edges, ids.where(F.col("id") == u)).select("id")
            sides = [saved(side), saved(ids.join(side, "id", "left_anti"))]
            where = None
            for some in sides:
                own = some.agg(F.min("id")).first()[0]
                changed[own] = (edges.join(some.withColumnRenamed("id", "src"), "src", "left_semi"), some)
                labelled = some.select("id", F.lit(own).alias("component"))
                where = labelled if where is None else where.union(labelled)
            n += 1
        tops = saved(tops.where(F.col("component") != name).union(leading(shares, where)))
    if not changed:
        return home
    moved = None
    for name, (_, ids) in changed.items():
        own = ids.select("id", F.lit(name).alias("component"))
        moved = own if moved is None else moved.union(own)
    moved = saved(moved)
    return home.join(moved, "id", "left_anti").union(moved)


def bridging_ties(g: Graph, comm: DataFrame, variant: str = "edges") -> DataFrame:
    """``edges``: id of the ends of edges between communities.  ``count``: (id, n_communities) of different other communities among
    neighbours.  ``betweenness``: (id, value), the ten highest."""
    if variant == "betweenness":
        return betweenness_centrality(g).orderBy(F.desc("value"), "id").limit(10)
    a, b = comm.select(F.col("id").alias("src"), F.col("component").alias("ca")), comm.select(F.col("id").alias("dst"), F.col("component").alias("cb"))
    cross = both_ways(g).join(a, "src").join(b, "dst").where("ca <> cb")
    if variant == "edges":
        return cross.select(F.col("src").alias("id")).distinct()
    n = cross.groupBy(F.col("src").alias("id")).agg(F.count_distinct("cb").alias("n"))
    return g.vertices.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_communities"))


def community_report(comm: DataFrame, top: int = 10, members: int = 8) -> DataFrame:
    """The ``top`` largest communities: component, size, first_members (ascending, at most ``members``), more.

    Members are ranked only inside the communities shown; the ranks of one community come from a range sort.
    """
    size = comm.groupBy("component").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "component").limit(top)
    ids = comm.join(F.broadcast(size), "component")
    salted = Window.partitionBy("component", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    few = ids.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= members)
    first = few.groupBy("component", "size").agg(F.slice(F.array_sort(F.collect_list("id")), 1, members).alias("first_members"))
    return first.select("component", "size", "first_members", F.greatest(F.col("size") - members, F.lit(0)).alias("more"))


def color_refinement(g: Graph, rounds: int = 3) -> DataFrame:
    """(id, c): a 64-bit colour of each vertex after ``rounds`` of refinement from its degrees; equal colours stand for equal ways to see the neighbourhood.

    A neighbourhood is folded into sums of the 32-bit halves of two hashes of its colours, for in- and out-neighbours apart: a multiset's hash of fixed size,
    added up before the shuffle, so that a hub costs no more than any vertex.
    """
    edges = saved(g.edges.select("src", "dst"))
    color = saved(degrees(g).select("id", F.xxhash64("in_degree", "out_degree").alias("c")))

    def seen(of: str, at: str, name: str) -> DataFrame:
        """(id, name): the sums over the neighbours ``of`` of each vertex ``at``."""
        hashes = [F.xxhash64("c", F.lit(i)) for i in (1, 2)]
        halves = [half for h in hashes for half in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]
        near = edges.join(color.withColumnRenamed("id", of), of)
        return near.groupBy(F.col(at).alias("id")).agg(*[F.sum(x).alias(f"s{i}") for i, x in enumerate(halves)]).select("id", F.struct("s0", "s1", "s2", "s3").alias(name))

    for _ in range(rounds):
        out, into = seen("dst", "src", "o"), seen("src", "dst", "i")
        color = saved(color.join(out, "id", "left").join(into, "id", "left").select("id", F.xxhash64("c", "o", "i").alias("c")))
    return color


def wl_compare(a: Graph, b: Graph, rounds: int = 3) -> str:
    """``different`` where vertex counts, edge counts, degrees or colour refinement tell the graphs apart, else ``not distinguished``."""
    if a.vertices.count() != b.vertices.count() or a.edges.count() != b.edges.count():
        return "different"
    x, y = (color_refinement(g, rounds).groupBy("c").agg(F.count("*").alias(n)) for g, n in ((a, "n"), (b, "k")))
    odd = x.join(y, "c", "full").where("n IS NULL OR k IS NULL OR n <> k").limit(1).count()
    return "different" if odd else "not distinguished"
