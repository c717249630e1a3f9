"""Traversal and shortest paths as loops of joins; unreachable vertices have no row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, both_ways
from ..plans import searches
from ..plans.loop import batches, dense_index, fresh, saved


def _moves(g: Graph, directed: bool) -> DataFrame:
    return g.edges.select("src", "dst") if directed else both_ways(g)


def levels(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, id, dist): breadth-first distances over edges(src, dst) from sources(id).

    Many sources are dealt over tasks that read the edges (see plans.searches); few, or more edges than that allows, go as joins.
    """
    edges = saved(edges)
    if searches.many(sources) and searches.fits(edges):
        return searches.level_rows(edges, sources)
    return _joined_levels(edges, sources)


def level_counts(moves: DataFrame, sources: DataFrame, batch: int = 1000) -> DataFrame:
    """(source, dist, n): how many vertices lie at each breadth-first distance over saved moves(src, dst) from each of sources(id)."""
    if searches.fits(moves):
        return searches.level_counts(moves, sources)
    parts = None
    for some in batches(sources, batch):
        p = _joined_levels(moves, some).groupBy("source", "dist").agg(F.count("*").alias("n"))
        parts = p if parts is None else parts.union(p)
    return parts


def _joined_levels(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """levels() of saved edges as joins, a round per level."""
    seen = saved(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("dist")))
    front, depth = seen, 0
    while True:
        step = edges.join(front.select("source", F.col("id").alias("src")), "src").select("source", F.col("dst").alias("id")).distinct()
        depth += 1
        front = saved(step.join(seen.select("source", "id"), ["source", "id"], "left_anti").select("source", "id", F.lit(depth).alias("dist")))
        if not front.limit(1).count():
            return seen
        seen = saved(seen.union(front))


def bfs(g: Graph, sources: DataFrame, directed: bool = True) -> DataFrame:
    """(source, id, dist, pred, pos): breadth-first search with the visit order.

    Successors are visited in ascending order, so within a level the order is that of (parent's position, id), and pred is the parent
    visited first.  A level is ranked by a range sort over all sources at once.
    """
    edges = saved(_moves(g, directed))
    if searches.many(sources) and searches.fits(edges):
        return searches.visit_rows(edges, sources)
    kind = g.vertices.schema["id"].dataType
    seen = saved(sources.select(F.col("id").alias("source"), "id", F.lit(0).alias("dist"), F.lit(None).cast(kind).alias("pred"), F.lit(0).cast("long").alias("pos")))
    front, depth = seen, 0
    while True:
        step = edges.join(front.select("source", F.col("id").alias("src"), "pos"), "src").groupBy("source", F.col("dst").alias("id")).agg(F.min(F.struct("pos", "src")).alias("p"))
        new = step.join(seen.select("source", "id"), ["source", "id"], "left_anti").select("source", "id", F.col("p.pos").alias("ppos"), F.col("p.src").alias("pred"))
        new = saved(new)
        if not new.limit(1).count():
            return seen
        depth += 1
        ranked = saved(dense_index(new, ["source", "ppos", "id"], "n"))
        first = ranked.groupBy("source").agg(F.min("n").alias("n0"))
        count = seen.groupBy("source").agg(F.count("*").alias("c"))
        front = saved(ranked.join(first, "source").join(count, "source").select("source", "id", F.lit(depth).alias("dist"), "pred", (F.col("n") - F.col("n0") + F.col("c")).alias("pos")))
        seen = saved(seen.union(front))


def reachable(g: Graph, sources: DataFrame, directed: bool = True) -> DataFrame:
    """(source, id): what breadth-first and depth-first search visit."""
    return levels(_moves(g, directed), sources).select("source", "id")


def path_to(tree: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target, path): vertices from the source to each of targets(id), from a tree (source, id, pred); no row where it is not reached.

    Ancestors 1, 2, 4, ... steps up are joined, so a path of length n takes log n rounds.
    """
    jump = saved(tree.where("pred IS NOT NULL").select("source", F.col("id").alias("a"), F.col("pred").alias("b")))
    on = saved(tree.join(targets.select("id").distinct(), "id").select("source", F.col("id").alias("target"), "id", F.lit(0).cast("long").alias("up")))
    step = 1
    while jump.limit(1).count():
        more = on.join(jump, (on.source == jump.source) & (on.id == jump.a)).select(on.source, "target", F.col("b").alias("id"), (F.col("up") + step).alias("up"))
        on = fresh(on.union(more).distinct())
        nxt = jump.select("source", F.col("a").alias("b"), F.col("b").alias("c"))
        jump = fresh(jump.join(nxt, ["source", "b"]).select("source", "a", F.col("c").alias("b")))
        step *= 2
    chain = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("k"), "id"))), lambda x: x["id"])
    return on.groupBy("source", "target").agg(chain.alias("path"))


def bellman_ford(g: Graph, sources: DataFrame) -> tuple[DataFrame, bool]:
    """((source, id, dist, pred), negative_cycle): shortest weighted distances from sources(id), of any sign.

    Only vertices whose distance has changed are relaxed again, and a round writes only what it has improved; the improvements are folded into one table when
    there are eight of them.  A change in round n means a negative cycle reachable from a source.
    """
    n = g.vertices.count()
    edges = saved(g.edges)
    kind = g.vertices.schema["id"].dataType
    front = saved(sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("dist"), F.lit(None).cast(kind).alias("pred")))
    newest = F.min_by(F.struct("dist", "pred"), F.col("dist")).alias("b")  # distances only fall
    known, later = front, 0
    for _ in range(n):
        offers = edges.join(front.select("source", F.col("id").alias("src"), "dist"), "src").groupBy("source", F.col("dst").alias("id")).agg(F.min(F.struct((F.col("dist") + F.col("weight")).alias("d"), F.col("src").alias("p"))).alias("o"))
        now = known.groupBy("source", "id").agg(F.min("dist").alias("dist"))
        front = saved(offers.join(now, ["source", "id"], "left").where("dist IS NULL OR o.d < dist").select("source", "id", F.col("o.d").alias("dist"), F.col("o.p").alias("pred")))
        if not front.limit(1).count():
            return known.groupBy("source", "id").agg(newest).select("source", "id", "b.*"), False
        known, later = known.unionByName(front), later + 1
        if later == 8:
            known, later = saved(known.groupBy("source", "id").agg(newest).select("source", "id", "b.*")), 0
    return known.groupBy("source", "id").agg(newest).select("source", "id", "b.*"), True


def _bucket_width(edges: DataFrame) -> float:
    """The least weight above 0, or an eighth of the mean where that is more: then few offers are made twice, and few buckets are empty."""
    least, mean = edges.where("weight > 0").agg(F.min("weight"), F.avg("weight")).first()
    return max(least, mean / 8) if least else 1.0


def delta_stepping(g: Graph, sources: DataFrame, width: float | None = None, target=None, heuristic: DataFrame | None = None) -> DataFrame:
    """(source, id, dist, pred) for non-negative weights, by buckets of ``width`` of the distance (Meyer and Sanders 2003).

    Only the bucket with the least open distance is joined to the edges: to the light ones (up to ``width``) until no offer falls into it any more, then, all its vertices at once, to
    the heavy ones.  What it holds is then settled, and leaves the table of open offers.  pred is the smallest of the vertices on a shortest path just before
    (among positive weights).  With ``target``, offers that cannot beat its distance (``heuristic(id, h)`` being lower bounds of the way left) are dropped,
    and the search ends when it is settled.
    """
    kind = g.vertices.schema["id"].dataType
    edges = saved(g.edges.select("src", "dst", "weight"))
    width = width or _bucket_width(edges)
    every = edges.where("weight > 0").agg(F.min("weight")).first()[0]
    zero = edges.where("weight = 0").limit(1).count() > 0
    light, heavy = edges.where(F.col("weight") <= width), edges.where(F.col("weight") > width)
    once = not zero and (every is None or every >= width)  # no light edge stays inside a bucket
    opened = saved(sources.select(F.col("id").alias("source"), "id", F.lit(0.0).alias("dist"), F.lit(None).cast(kind).alias("pred")))
    settled = None
    best = F.min(F.struct("dist", "pred")).alias("b")
    way = opened.select("id", F.lit(0.0).alias("h")).limit(0) if heuristic is None else heuristic.select("id", "h")

    def offers(rows: DataFrame, over: DataFrame) -> DataFrame:
        return over.join(rows.select("source", F.col("id").alias("src"), "dist"), "src").select("source", F.col("dst").alias("id"), (F.col("dist") + F.col("weight")).alias("dist"), F.col("src").alias("pred"))

    def merged(old: DataFrame, new: DataFrame, done: DataFrame) -> DataFrame:
        """The least offer of each vertex that is not settled."""
        own = new.groupBy("source", "id").agg(best).select("source", "id", "b.*")
        own = own if done is None else own.join(done.select("source", "id"), ["source", "id"], "left_anti")
        out = old.unionByName(own).groupBy("source", "id").agg(best).select("source", "id", "b.*")
        if target is not None:
            goal = out.where(F.col("id") == target).select("source", F.col("dist").alias("goal"))
            out = out.join(goal, "source", "left").join(way, "id", "left")
            out = out.where(F.col("goal").isNull() | (F.col("id") == target) | (F.col("dist") + F.coalesce("h", F.lit(0.0)) < F.col("goal"))).select("source", "id", "dist", "pred")
        return saved(out)

    rounds = 0
    while (low := opened.agg(F.min("dist")).first()[0]) is not None:
        top = (low // width + 1) * width
        top = top if top > low else low + width
        if once:
            inside = opened.where(F.col("dist") < top)
            new, rest = offers(inside, edges), opened.where(F.col("dist") >= top)
        else:
            todo = inside = opened.where(F.col("dist") < top)
            while True:
                before = opened
                opened = merged(before, offers(todo, light), settled)
                inside = opened.where(F.col("dist") < top)
                todo = saved(inside.join(before.where(F.col("dist") < top).select("source", "id", F.col("dist").alias("was")), ["source", "id"], "left").where("was IS NULL OR dist < was").select("source", "id", "dist", "pred"))
                if not todo.limit(1).count():
                    break
            new, rest = offers(inside, heavy), opened.where(F.col("dist") >= top)
        settled = inside if settled is None else settled.unionByName(inside)
        rounds += 1
        if rounds % 8 == 0:
            settled = saved(settled)  # the list of parts stays short
        if target is not None and inside.where(F.col("id") == target).limit(1).count():
            break
        opened = merged(rest, new, settled)
    return opened if settled is None else settled


def sssp(g: Graph, sources: DataFrame) -> DataFrame:
    """(source, id, dist, pred) for non-negative weights; a negative weight raises ValueError."""
    least = g.edges.agg(F.min("weight")).first()[0]
    if least is not None and least < 0:
        raise ValueError("negative weights: use bellman_ford")
    if least and searches.many(sources):
        edges = saved(g.edges.select("src", "dst", "weight"))
        if searches.fits(edges):
            return searches.length_rows(edges, sources, _bucket_width(edges))
    return delta_stepping(g, sources)


def shortest_path(g: Graph, source, target, heuristic: DataFrame | None = None) -> DataFrame:
    """One row source, target, reachable, distance, path.  Offers that cannot beat the target's distance are pruned;
    heuristic(id, h) holds lower bounds of the way left (default 0).  Of several shortest paths it is that of the smallest vertex before each, from the target back."""
    spark = g.spark
    start = g.vertices.where(F.col("id") == source).select("id")
    goal = g.vertices.where(F.col("id") == target).select("id")
    if g.edges.where("weight < 0").limit(1).count():
        raise ValueError("negative weights: use bellman_ford")
    tree = saved(delta_stepping(g, start, target=target, heuristic=heuristic))
    found = tree.where(F.col("id") == target).select("source", F.col("dist").alias("distance"))
    one = spark.range(1).select(F.lit(source).alias("source"), F.lit(target).alias("target"))
    return one.join(found, "source", "left").join(path_to(tree, goal).drop("target"), "source", "left").select("source", "target", F.col("distance").isNotNull().alias("reachable"), "distance", "path")


def all_pairs(g: Graph, sources: DataFrame | None = None, batch: int = 1000) -> DataFrame:
    """(source, id, dist, pred) for all sources, in batches; the diagonal is 0; a negative cycle raises ValueError."""
    out = None
    below = g.edges.where("weight < 0").limit(1).count() > 0
    for some in batches(sources if sources is not None else g.vertices.select("id"), batch):
        part, cycle = bellman_ford(g, some) if below else (delta_stepping(g, some), False)
        if cycle:
            raise ValueError("negative cycle")
        out = part if out is None else out.unionByName(part)
    return out


def _followed(f: DataFrame, n: int) -> DataFrame | None:
    """``f(id, to, b, w)``, level(id) = max(b, level(to) + w), with each ``to`` followed until it has no row of its own; None if some go round in a circle.

    Each round doubles the steps that a row has taken, so a chain of n vertices takes log n rounds.
    """
    for _ in range(max(n, 1).bit_length() + 1):
        far = f.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("b").alias("b2"), F.col("w").alias("w2"))
        f = fresh(f.join(far, "to", "left").select("id", F.coalesce("to2", "to").alias("to"), F.greatest("b", F.coalesce(F.col("b2") + F.col("w"), "b")).alias("b"), (F.col("w") + F.coalesce("w2", F.lit(0))).alias("w"), F.col("to2").isNotNull().alias("went")))
        if not f.where("went").limit(1).count():
            return f.drop("went")
        f = f.drop("went")
    return None


#: Edges for each part of the vertices in topological_levels(), and the most parts.
PEELED, PARTS = 500_000, 1000


def _cuts(ids: DataFrame, parts: int) -> list:
    """Ids that cut ids(id) into ``parts`` (at most PARTS) ranges of like size."""
    parts = min(parts, PARTS)
    if parts < 2:
        return []
    numbers = dense_index(ids, ["id"], "k")
    size = -(-ids.count() // parts)
    return sorted(r.id for r in numbers.where(f"k % {size} = 0 AND k > 0").collect())


def _peeled(left: DataFrame, edges: DataFrame, cuts: list) -> DataFrame:
    """(id, b) with b the level, of those of ``left(id, b, n)`` whose n predecessors by edges(src, dst, w) are none or leave before them from the same part."""
    bounds = F.array(*[F.lit(x) for x in cuts])
    part = lambda c: F.size(F.filter(bounds, lambda x: x <= F.col(c))) if cuts else F.lit(0)
    inner = edges.where(part("src") == part("dst")).select(part("src").alias("part"), "src", "dst", "w")
    return left.select(part("id").alias("part"), "id", "b", "n").groupBy("part").cogroup(inner.groupBy("part")).applyInArrow(_peel, f"id {left.schema['id'].dataType.simpleString()}, b long")


def _peel(rows: pa.Table, inner: pa.Table) -> pa.Table:
    """_peeled() of one part."""
    rows = rows.sort_by("id")
    ids = rows["id"].combine_chunks()
    level, missing = rows["b"].to_numpy().copy(), rows["n"].to_numpy().copy()
    tail, head = (pc.index_in(inner[c].combine_chunks(), ids).to_numpy() for c in ("src", "dst"))
    order = np.argsort(tail, kind="stable")
    head, w = head[order], inner["w"].to_numpy()[order]
    first = np.searchsorted(tail[order], np.arange(len(ids) + 1))
    gone, front = np.zeros(len(ids), bool), np.flatnonzero(missing == 0)
    while len(front):
        gone[front] = True
        size = first[front + 1] - first[front]
        at = np.repeat(first[front] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        to = head[at]
        np.maximum.at(level, to, np.repeat(level[front], size) + w[at])
        np.subtract.at(missing, to, 1)
        to = np.unique(to)
        front = to[missing[to] == 0]
    return pa.table({"id": ids.filter(pa.array(gone)), "b": level[gone]})


def topological_levels(g: Graph) -> DataFrame | None:
    """(id, level, pos): rounds in which vertices have no predecessor left, and the order by (level, id); None if there is a cycle.

    Vertices are parted by the order of their ids.  In each round those leave whose predecessors are gone or leave before them from the same part, so that a part that waits for no
    other goes at once; where parts wait for each other, a round takes at least those without predecessors.  Where at least a quarter of the rest has one predecessor left, those are folded: each is its predecessor's level
    plus a length, or a known level if that is more, and such functions compose; so paths and trees of any depth go in a logarithm of rounds.
    """
    edges = saved(g.edges.select("src", "dst", F.lit(1).cast("long").alias("w")))
    cuts = _cuts(g.vertices.select("id"), edges.count() // PEELED)
    # the vertices left, the least level that they have by what is done, and how many predecessors are left
    count = lambda rows: saved(rows.join(edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n")), "id", "left").select("id", "b", F.coalesce("n", F.lit(0)).alias("n")))
    left = count(g.vertices.select("id", F.lit(0).cast("long").alias("b")))
    done, folded, rounds = None, [], 0
    while True:
        total, free, single = left.agg(F.count("*"), F.count(F.when(F.col("n") == 0, 1)), F.count(F.when(F.col("n") == 1, 1))).first()
        if not total:
            break
        if not free and not single:
            return None
        if not free or 4 * single >= total:
            f = edges.join(left.where("n = 1").select(F.col("id").alias("dst"), "b"), "dst").select(F.col("dst").alias("id"), F.col("src").alias("to"), "b", "w") if single else None
            f = _followed(saved(f), single) if f is not None else None
            if f is None:
                return None
            folded.append(f)
            over = f.select(F.col("id").alias("src"), "to", "b", F.col("w").alias("w1"))
            moved = edges.join(f.select(F.col("id").alias("dst")), "dst", "left_anti").join(over, "src", "left")
            moved = saved(moved.select(F.coalesce("to", "src").alias("src"), "dst", (F.col("w") + F.coalesce("w1", F.lit(0))).alias("w"), (F.col("b") + F.col("w")).alias("c")))
            edges = saved(moved.groupBy("src", "dst").agg(F.max("w").alias("w")))
            least = moved.groupBy(F.col("dst").alias("id")).agg(F.max("c").alias("c"))
            rest = left.join(f.select("id"), "id", "left_anti")
        else:
            gone = saved(_peeled(left, edges, cuts))
            now = gone.select("id", F.col("b").alias("level"))
            done = now if done is None else done.union(now)
            least = edges.join(gone.select(F.col("id").alias("src"), "b"), "src").groupBy(F.col("dst").alias("id")).agg(F.max(F.col("b") + F.col("w")).alias("c"))
            edges = saved(edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti"))
            rest = left.join(gone.select("id"), "id", "left_anti")
        rest = rest.select("id", "b").join(least, "id", "left").select("id", F.greatest("b", F.coalesce("c", "b")).alias("b"))
        left, rounds = count(rest), rounds + 1
        if rounds % 16 == 0 and done is not None:
            done = saved(done)  # the list of parts stays short
    done = left.select("id", F.col("b").alias("level")) if done is None else done  # no vertices
    for f in reversed(folded):
        done = saved(done)
        at = done.select(F.col("id").alias("to"), "level")
        done = done.union(f.join(at, "to").select("id", F.greatest("b", F.col("level") + F.col("w"))))
    return dense_index(done.select("id", F.col("level").cast("int").alias("level")), ["level", "id"], "pos")


def has_cycle(g: Graph, directed: bool = True) -> bool:
    """Directed: some vertices never lose all predecessors.  Undirected: more pairs than a forest has."""
    if directed:
        return topological_levels(g) is None
    from .components import connected_components
    from ..graph import pairs

    n = g.vertices.count()
    return pairs(g).count() > n - connected_components(g).agg(F.count_distinct("component")).first()[0]


def distance_stats(g: Graph, batch: int = 1000) -> DataFrame:
    """One row max_distance, mean_distance over reachable ordered pairs of the undirected view."""
    rows = level_counts(saved(both_ways(g)), saved(g.vertices.select("id")), batch).where("dist > 0").agg(F.max("dist").alias("m"), F.sum(F.col("dist") * F.col("n")).alias("s"), F.sum("n").alias("n"))
    return rows.select(F.coalesce("m", F.lit(0)).alias("max_distance"), F.coalesce(F.try_divide("s", "n"), F.lit(0.0)).alias("mean_distance"))
