"""Connectivity: weak and strong components, cut vertices and edges, bipartiteness."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, pairs
from ..plans import files, searches
from ..plans.loop import dense_index, join_spread
from ..plans.loop import fresh as saved
from ..plans.loop import saved as checkpointed


#: Rows of a star table from which its hubs are dealt over several tasks, and up to which it stays in one partition, so that rounds need no shuffle.
SPREAD, FEW = 20_000, 20_000


def stars(edges: DataFrame, saved: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """(a, b) with b the smallest vertex of a's component, for every a that is not it.

    Large-star and small-star rounds (Kiveris et al. 2014), each checkpointed; only counts, a checksum and the ids of hubs come to
    the driver.  A hub's edges are dealt over several tasks; up to FEW edges stay together.  Loops and repeated edges are harmless, null ends are ignored.
    """
    star = saved(edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    seen, n = None, star.count()
    while n:
        many = n > SPREAD
        star = star.coalesce(1) if n <= FEW else star
        meet = lambda rows, low: join_spread(rows, low.drop("n"), "a", counts=low.select("a", "n")) if many else rows.join(low, "a")
        both = star.union(star.select("b", "a"))
        both = both.coalesce(1) if n <= FEW else both
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n"))
        large = meet(both.where("b > a"), low).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = saved(large) if many else large
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = meet(large, least).select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = small.union(least.select("a", "m")).where("a <> b")
        star = saved((star.coalesce(1) if n <= FEW else star).distinct())
        n, code = star.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if (n, code) == seen:
            break
        seen = (n, code)
    return star


def components_of(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) for ids(id): the smallest id that edges(src, dst) reach in either direction."""
    star = stars(edges, saved).select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ids.select("id").join(star, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def connected_components(g: Graph) -> DataFrame:
    """(id, component): weak components, named by their smallest member."""
    return components_of(g.vertices, g.edges)


def is_connected(g: Graph) -> DataFrame:
    """One row is_connected: at most one weak component."""
    return connected_components(g).agg((F.count_distinct("component") <= 1).alias("is_connected"))


def _ends_of_chains(inner: DataFrame, n: int) -> DataFrame:
    """(id, to, low) for ``inner(id, to)``: ``to`` followed until it is no id of the table, in log n rounds; on a circle ``to`` stays an id, and low is the circle's smallest."""
    f = saved(inner.select("id", "to", F.col("id").alias("low")))
    for _ in range(max(n, 1).bit_length() + 1):
        far = f.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        f = saved(f.join(far, "to", "left").select("id", F.coalesce("to2", "to").alias("to"), F.least("low", F.coalesce("low2", "low")).alias("low"), F.col("to2").isNotNull().alias("went")))
        if not f.where("went").limit(1).count():
            break
        f = f.drop("went")
    return f.select("id", "to", "low")


def scc(g: Graph) -> DataFrame:
    """(id, component): strong components, named by their smallest member.

    Rounds: vertices without in- or out-edges among the rest are components of their own.  Where at least a quarter of the rest has one edge in and one out, chains of them
    become edges: a chain belongs to a component if both its ends do, and a circle is one.  Of the others, the largest id that
    reaches a vertex is its colour; what reaches a colour's root inside the colour is one component.
    """
    ids = saved(g.vertices.select("id"))
    edges = saved(g.edges.select("src", "dst"))
    found, chains = [], []
    while ids.limit(1).count():
        while True:  # trim and fold
            into, out = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("i"), F.min("src").alias("a")), edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("o"), F.min("dst").alias("z"))
            shape = saved(ids.join(into, "id", "left").join(out, "id", "left"))
            total, lone, thin = shape.agg(F.count("*"), F.count(F.when(F.col("i").isNull() | F.col("o").isNull(), 1)), F.count(F.when((F.col("i") == 1) & (F.col("o") == 1), 1))).first()
            if thin and 4 * thin >= total:
                inner = shape.where("i = 1 AND o = 1")
                back, on = _ends_of_chains(inner.select("id", F.col("a").alias("to")), thin), _ends_of_chains(inner.select("id", F.col("z").alias("to")), thin)
                both = saved(back.join(on.select("id", F.col("to").alias("z")), "id").join(inner.select(F.col("id").alias("to"), F.lit(True).alias("circle")), "to", "left").select("id", F.col("to").alias("a"), "z", "low", "circle"))
                found.append(both.where("circle").select("id", F.col("low").alias("root")))
                chains.append(both.where("circle IS NULL").select("id", "a", "z"))
                rest = edges.join(both.select(F.col("id").alias("src")), "src", "left_anti").join(both.select(F.col("id").alias("dst")), "dst", "left_anti")
                edges = saved(rest.union(chains[-1].select(F.col("a").alias("src"), F.col("z").alias("dst"))).where("src <> dst").distinct())
                ids = saved(ids.join(both.select("id"), "id", "left_anti"))
                continue
            if not lone:
                break
            gone = shape.where("i IS NULL OR o IS NULL").select("id")
            found.append(gone.select("id", F.col("id").alias("root")))
            ids = saved(ids.join(gone, "id", "left_anti"))
            edges = saved(edges.join(gone, edges.src == gone.id, "left_anti").join(gone, edges.dst == gone.id, "left_anti"))
        if not ids.limit(1).count():
            break
        color = saved(ids.select("id", F.col("id").alias("color")))
        while True:  # the largest id flows along the edges
            sent = edges.join(color, edges.src == color.id).groupBy("dst").agg(F.max("color").alias("new"))
            new = saved(color.join(sent, color.id == sent.dst, "left").select("id", F.greatest("color", F.coalesce("new", "color")).alias("color")))
            moved = new.join(color.withColumnRenamed("color", "old"), "id").where("color <> old").limit(1).count()
            color = new
            if not moved:
                break
        a, b = color.select(F.col("id").alias("src"), F.col("color").alias("c1")), color.select(F.col("id").alias("dst"), F.col("color").alias("c2"))
        inside = saved(edges.join(a, "src").join(b, "dst").where("c1 = c2").select("src", "dst", F.col("c1").alias("root")))
        reached = saved(color.where("id = color").select("id", F.col("color").alias("root")))
        front = reached
        while True:  # backwards from the roots
            back = inside.join(front.withColumnRenamed("id", "dst"), ["dst", "root"]).select(F.col("src").alias("id"), "root").distinct()
            front = saved(back.join(reached, ["id", "root"], "left_anti"))
            if not front.limit(1).count():
                break
            reached = saved(reached.union(front))
        found.append(reached)
        done = reached.select("id")
        ids = saved(ids.join(done, "id", "left_anti"))
        edges = saved(edges.join(done, edges.src == done.id, "left_anti").join(done, edges.dst == done.id, "left_anti"))
    out = g.vertices.select("id", F.col("id").alias("root")).limit(0)
    for part in found:
        out = out.union(part)
    out = saved(out)
    for part in reversed(chains):
        a, z = out.select(F.col("id").alias("a"), F.col("root").alias("ra")), out.select(F.col("id").alias("z"), F.col("root").alias("rz"))
        out = saved(out.union(part.join(a, "a").join(z, "z").select("id", F.when(F.col("ra") == F.col("rz"), F.col("ra")).otherwise(F.col("id")))))
    return out.join(out.groupBy("root").agg(F.min("id").alias("component")), "root").select("id", "component")


def is_strongly_connected(g: Graph) -> DataFrame:
    """One row: at most one strong component."""
    return scc(g).agg((F.count_distinct("component") <= 1).alias("is_strongly_connected"))


def spanning_levels(p: DataFrame, roots: DataFrame) -> tuple[DataFrame, int]:
    """((id, dist, pred) of a breadth-first forest over undirected pairs (u, v), depth); pred is the smallest parent of the level above."""
    both = saved(p.select(F.col("u").alias("src"), F.col("v").alias("dst")).union(p.select("v", "u")))
    seen = saved(roots.select("id", F.lit(0).alias("dist"), F.lit(None).cast(roots.schema["id"].dataType).alias("pred")))
    front, depth = seen, 0
    while True:
        step = both.join(front.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("pred"))
        front = saved(step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(depth + 1).alias("dist"), "pred"))
        if not front.limit(1).count():
            return seen, depth
        depth += 1
        seen = saved(seen.union(front))


def _ranked(e: DataFrame, n: int) -> DataFrame:
    """``e(k, to)`` with d, the number of steps from k to the end of its list: list ranking by pointer jumping, log n rounds (Wyllie 1979)."""
    e = saved(e.withColumn("d", F.when(F.col("to").isNotNull(), 1).otherwise(0).cast("long")))
    for _ in range(max(n, 1).bit_length() + 1):
        far = e.where("d > 0").select(F.col("k").alias("to"), F.col("to").alias("to2"), F.col("d").alias("d2"))
        if not e.where("to IS NOT NULL").limit(1).count():
            break
        e = saved(e.join(far, "to", "left").select("k", F.col("to2").alias("to"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d")))
    return e.select("k", "d")


def euler_tour(forest: DataFrame, home: DataFrame) -> DataFrame:
    """(id, pred, first, last) of the trees of ``forest(u, v)``, rooted at the smallest member: a vertex's subtree are those with ``first`` between its first and last.

    Every tree is walked around: behind an edge that enters a vertex comes the one that leaves to the next neighbour.  Neighbours are in one range order
    of all edges, so no vertex's edges are gathered, and places in the walk come from list ranking; rounds go with the logarithm of the size, whatever the depth.
    ``home(id, component)`` holds the vertices and their trees.  Isolated ones have a first and a last too.
    """
    both = forest.select(F.col("u").alias("src"), F.col("v").alias("dst")).union(forest.select("v", "u"))
    e = saved(dense_index(both, ["src", "dst"], "k"))
    n = e.count()
    ends = saved(e.groupBy("src").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.count("*").alias("n")))
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("k").alias("t"))
    spread = e.join(back, ["src", "dst"]).select(F.col("dst").alias("at"), "src", "k", "t")
    walk = join_spread(spread, ends.select(F.col("src").alias("at"), "lo", "hi"), "at", counts=ends.select(F.col("src").alias("at"), "n"))
    walk = walk.select("k", F.when(F.col("t") < F.col("hi"), F.col("t") + 1).otherwise(F.col("lo")).alias("to"))
    start = home.where("id = component").join(ends, F.col("id") == F.col("src")).select(F.col("lo").alias("to"), F.lit(True).alias("begins"))
    walk = walk.join(start, "to", "left").select("k", F.when(F.col("begins").isNull(), F.col("to")).alias("to"))
    rank = _ranked(walk, n)
    tree = home.select(F.col("id").alias("src"), "component")
    placed = e.join(rank, "k").join(tree, "src").select("component", (-F.col("d")).alias("step"), "src", "dst")
    placed = saved(dense_index(placed, ["component", "step"], "p").select("component", "src", "dst", (2 * F.col("p") + 1).alias("p")))
    up = placed.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("p").alias("q"))
    down = placed.join(up, ["src", "dst"]).where("p < q").select(F.col("dst").alias("id"), F.col("src").alias("pred"), F.col("p").alias("first"), F.col("q").alias("last"))
    roots = placed.groupBy("component").agg((F.min("p") - 1).alias("first"), (F.max("p") + 1).alias("last"))
    own = home.where("id = component").join(roots, "component", "left").select("id", F.lit(None).cast(home.schema["id"].dataType).alias("pred"), F.coalesce("first", F.lit(-1)).cast("long").alias("first"), F.coalesce("last", F.lit(-1)).cast("long").alias("last"))
    return saved(down.union(own))


def _subtree_extremes(tour: DataFrame, values: DataFrame) -> DataFrame:
    """(id, low, high) of ``values(id, lo, hi)`` over each subtree of an euler_tour(): least lo and greatest hi between its first and last.

    Extremes over stretches of 1, 2, 4, ... places are doubled; a subtree is covered by two stretches of one length.  Roots have no row.  Up to searches.VERTICES
    vertices tasks take subtrees and read the values of all places from the shared folder; beyond, stretches are doubled by joins.
    """
    if searches.fits(tour, searches.VERTICES):
        return _extremes_in_tasks(tour, values)
    inner = tour.where("pred IS NOT NULL").select("id", ((F.col("first") - 1) / 2).cast("long").alias("a"), ((F.col("last") - 1) / 2).cast("long").alias("z"))
    inner = saved(inner.withColumn("j", F.floor(F.log2((F.col("z") - F.col("a") + 1).cast("double")) + 1e-12).cast("int")))
    level = saved(inner.join(values, "id").select(F.col("a").alias("p"), "lo", "hi").union(inner.select(F.col("z").alias("p"), F.lit(None).cast("long"), F.lit(None).cast("long"))))
    most, out, j = inner.agg(F.max("j")).first()[0], None, 0
    while most is not None and j <= most:
        one, two = level.select(F.col("p").alias("a"), F.col("lo").alias("l1"), F.col("hi").alias("h1")), level.select(F.col("p").alias("b"), F.col("lo").alias("l2"), F.col("hi").alias("h2"))
        own = inner.where(F.col("j") == j).withColumn("b", F.col("z") - (1 << j) + 1).join(one, "a").join(two, "b").select("id", F.least("l1", "l2").alias("low"), F.greatest("h1", "h2").alias("high"))
        out = own if out is None else out.union(own)
        # by a grouping: joins of a table with itself, round after round, would double what the optimizer knows of its columns
        both = level.union(level.select(F.col("p") - (1 << j), "lo", "hi").where(F.col("p") >= (1 << j)))
        level = saved(both.groupBy("p").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
        j += 1
    return saved(out) if out is not None else values.select("id", F.col("lo").alias("low"), F.col("hi").alias("high")).limit(0)


def _extremes_in_tasks(tour: DataFrame, values: DataFrame) -> DataFrame:
    """_subtree_extremes() of a tour of checked size, in one round."""
    inner = tour.where("pred IS NOT NULL").select("id", ((F.col("first") - 1) / 2).cast("long").alias("a"), ((F.col("last") - 1) / 2).cast("long").alias("z"))
    inner = saved(inner)
    size = (inner.agg(F.max("z")).first()[0] or 0) + 1
    places = files.written(inner.join(values, "id").select("a", "lo", "hi"), "places")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [batch for batch in batches if batch.num_rows]
        if not rows:
            return
        asked, known = pa.Table.from_batches(rows), files.read(places)
        a, z = asked["a"].to_numpy(), asked["z"].to_numpy()
        kind = np.frexp(z - a + 1)[1] - 1
        low, high = np.full(size, np.iinfo(np.int64).max), np.full(size, np.iinfo(np.int64).min)
        low[known["a"].to_numpy()], high[known["a"].to_numpy()] = known["lo"].to_numpy(), known["hi"].to_numpy()
        least, most = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        for j in range(int(kind.max()) + 1):
            if j:
                half = 1 << j - 1
                low, high = np.minimum(low[:-half], low[half:]), np.maximum(high[:-half], high[half:])
            at = np.flatnonzero(kind == j)
            one, two = a[at], z[at] - (1 << j) + 1
            least[at], most[at] = np.minimum(low[one], low[two]), np.maximum(high[one], high[two])
        yield pa.RecordBatch.from_arrays([asked["id"].combine_chunks(), pa.array(least), pa.array(most)], names=["id", "low", "high"])

    return saved(inner.mapInArrow(task, f"id {tour.schema['id'].dataType.simpleString()}, low long, high long"))


def biconnected(g: Graph) -> DataFrame:
    """(u, v, block): the block of every undirected pair u < v, named by its smallest member pair's child end.

    Tarjan and Vishkin (1985): a spanning forest, its Euler tour, the range of places in the tour that each subtree reaches by other
    edges, and components of an auxiliary graph on tree edges.  All rounds go with the logarithm of the size, not with a tree's depth or a vertex's degree.
    """
    from .trees import minimum_spanning_forest

    p, ids = saved(pairs(g)), saved(g.vertices.select("id"))
    home = saved(components_of(ids, p.select(F.col("u").alias("src"), F.col("v").alias("dst"))))
    even = p.select(F.col("u").alias("src"), F.col("v").alias("dst"), F.lit(1.0).alias("weight"))
    pre = euler_tour(minimum_spanning_forest(Graph(ids, even)).select("u", "v"), home)
    at = lambda name: pre.select(F.col("id").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("first", "last", "pred")])
    e = p.join(at("u"), "u").join(at("v"), "v")
    is_tree = F.coalesce(F.col("pred_u") == F.col("v"), F.lit(False)) | F.coalesce(F.col("pred_v") == F.col("u"), F.lit(False))
    e = saved(e.withColumn("tree", is_tree))
    rest = e.where("NOT tree")
    ends = rest.select(F.col("u").alias("id"), F.col("first_v").alias("x")).union(rest.select("v", "first_u")).union(pre.select("id", "first"))
    low = _subtree_extremes(pre, ends.groupBy("id").agg(F.min("x").alias("lo"), F.max("x").alias("hi")))
    # tree edges are named by their lower end; other edges join the edges of their ends where neither is the other's ancestor
    apart = rest.where("NOT first_v BETWEEN first_u AND last_u AND NOT first_u BETWEEN first_v AND last_v")
    aux = apart.select(F.col("u").alias("src"), F.col("v").alias("dst"))
    parent = pre.select(F.col("id").alias("pid"), F.col("first").alias("pfirst"), F.col("last").alias("plast"), F.col("pred").alias("ppred"))
    child = pre.select("id", "pred").join(low, "id")
    leaves = child.join(parent, child.pred == parent.pid).where("ppred IS NOT NULL AND (low < pfirst OR high > plast)")
    aux = aux.union(leaves.select(F.col("id").alias("src"), F.col("pid").alias("dst")))
    blocks = saved(components_of(pre.where("pred IS NOT NULL").select("id"), aux))
    lower = F.when(F.col("tree"), F.when(F.coalesce(F.col("pred_u") == F.col("v"), F.lit(False)), F.col("u")).otherwise(F.col("v"))).otherwise(F.when(F.col("first_u") > F.col("first_v"), F.col("u")).otherwise(F.col("v")))
    return e.withColumn("id", lower).join(blocks, "id").select("u", "v", F.col("component").alias("block"))


def bridges(blocks: DataFrame) -> DataFrame:
    """(u, v) of blocks with one edge, from biconnected()."""
    return blocks.groupBy("block").agg(F.count("*").alias("n"), F.min("u").alias("u"), F.min("v").alias("v")).where("n = 1").select("u", "v")


def articulation_points(blocks: DataFrame) -> DataFrame:
    """id of vertices in several blocks, from biconnected()."""
    ends = blocks.select(F.col("u").alias("id"), "block").union(blocks.select("v", "block"))
    return ends.groupBy("id").agg(F.count_distinct("block").alias("n")).where("n > 1").select("id")


def two_coloring(g: Graph) -> DataFrame:
    """(id, color): parity of the distance from the smallest id of the component."""
    p = pairs(g)
    roots = connected_components(g).where("id = component").select("id")
    return spanning_levels(p, roots)[0].select("id", F.pmod("dist", F.lit(2)).alias("color"))


def is_bipartite(g: Graph) -> DataFrame:
    """One row is_bipartite: no pair joins equal colours."""
    c = saved(two_coloring(g))
    a, b = c.select(F.col("id").alias("u"), F.col("color").alias("cu")), c.select(F.col("id").alias("v"), F.col("color").alias("cv"))
    return pairs(g).join(a, "u").join(b, "v").where("cu = cv").agg((F.count("*") == 0).alias("is_bipartite"))
