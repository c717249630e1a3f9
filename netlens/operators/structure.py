"""Density, clustering, triangles, eccentricity, assortativity and shape of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, both_ways, degrees, edge_count, neighbor_counts, pairs, vertex_count
from ..plans import searches
from ..plans.loop import saved
from .components import connected_components
from .paths import level_counts


def density(g: Graph, directed: bool = True) -> DataFrame:
    """One row: m/(n(n-1)), or 2m/(n(n-1)) of undirected pairs; 0 where n <= 1."""
    c = vertex_count(g).crossJoin(edge_count(g, directed))
    room = F.col("n") * (F.col("n") - 1)
    return c.select(F.when(F.col("n") > 1, F.col("m") * (1 if directed else 2) / F.when(room > 0, room)).otherwise(0.0).alias("density"))


def triangle_rows(g: Graph) -> DataFrame:
    """(a, b, c): every undirected triangle once.

    Each pair points from its end of lower (degree, id) to the other, so a vertex has few out-pairs even where
    it has many neighbours; wedges of out-pairs are closed by a semi-join.
    """
    p = saved(pairs(g))
    k = p.select(F.col("u").alias("id")).union(p.select("v")).groupBy("id").agg(F.count("*").alias("k"))
    both = p.join(k.select(F.col("id").alias("u"), F.col("k").alias("ku")), "u").join(k.select(F.col("id").alias("v"), F.col("k").alias("kv")), "v")
    lower = (F.col("ku") < F.col("kv")) | ((F.col("ku") == F.col("kv")) & (F.col("u") < F.col("v")))
    out = saved(both.select(F.when(lower, F.col("u")).otherwise(F.col("v")).alias("a"), F.when(lower, F.col("v")).otherwise(F.col("u")).alias("b")))
    wedge = out.join(out.withColumnRenamed("b", "c"), "a").where("b < c").select("a", "b", "c", F.col("b").alias("u"), F.col("c").alias("v"))
    return wedge.join(p, ["u", "v"], "left_semi").select("a", "b", "c")


def _corners(g: Graph) -> DataFrame:
    """(id, triangles, links) of the vertices of triangles: their number, and the directed edges opposite the vertex in them.

    Tasks that read the pairs count without making a row per triangle; more pairs than plans.searches allows go as joins.
    """
    once = saved(g.edges.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.count("*").cast("double").alias("weight")))
    if searches.fits(once):
        return searches.corners(once)
    t = saved(triangle_rows(g))
    corner = None
    for x, (y, z) in (("a", ("b", "c")), ("b", ("a", "c")), ("c", ("a", "b"))):
        part = t.select(F.col(x).alias("id"), F.least(y, z).alias("src"), F.greatest(y, z).alias("dst"))
        corner = part if corner is None else corner.union(part)
    return corner.join(once, ["src", "dst"]).groupBy("id").agg(F.count("*").alias("triangles"), F.sum("weight").cast("long").alias("links"))


def triangle_counts(g: Graph) -> DataFrame:
    """(id, triangles), zeros included."""
    return g.vertices.select("id").join(_corners(g), "id", "left").select("id", F.coalesce("triangles", F.lit(0)).alias("triangles"))


def triangles(g: Graph) -> DataFrame:
    """One row: the number of undirected triangles."""
    return _corners(g).agg((F.coalesce(F.sum("triangles"), F.lit(0)) / 3).cast("long").alias("triangles"))


def transitivity(g: Graph) -> DataFrame:
    """One row: closed neighbour pairs over all neighbour pairs, 0 where there is none."""
    pairs_ = neighbor_counts(g).agg(F.coalesce(F.sum(F.col("n_neighbors") * (F.col("n_neighbors") - 1) / 2), F.lit(0.0)).alias("w"))
    return triangles(g).crossJoin(pairs_).select(F.when(F.col("w") > 0, 3 * F.col("triangles") / F.when(F.col("w") > 0, F.col("w"))).otherwise(0.0).alias("transitivity"))


def clustering(g: Graph, variant: str = "pairs") -> DataFrame:
    """(id, value): ``pairs``: linked neighbour pairs (either direction) over all; ``directed``: directed links among neighbours over k(k-1); 0 where k < 2."""
    k = neighbor_counts(g)
    links = _corners(g).select("id", (2 * F.col("triangles") if variant == "pairs" else F.col("links")).alias("links"))
    room = F.col("n_neighbors") * (F.col("n_neighbors") - 1)
    return k.join(links, "id", "left").select("id", F.when(F.col("n_neighbors") >= 2, F.coalesce("links", F.lit(0)) / F.when(room > 0, room)).otherwise(0.0).alias("value"))


def average_clustering(g: Graph, variant: str = "pairs") -> DataFrame:
    """One row: the mean over all vertices, 0 without vertices."""
    return clustering(g, variant).agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("average_clustering"))


def eccentricity(g: Graph, batch: int = 1000) -> DataFrame:
    """(id, value): largest undirected distance from the vertex, infinite where the graph is not connected."""
    ids = saved(g.vertices.select("id"))
    counts = level_counts(saved(both_ways(g)), ids, batch)
    far = counts.groupBy(F.col("source").alias("id")).agg(F.max("dist").cast("double").alias("e"), F.sum("n").alias("r"))
    return far.crossJoin(F.broadcast(ids.agg(F.count("*").alias("n")))).select("id", F.when(F.col("r") == F.col("n"), F.col("e")).otherwise(F.lit(float("inf"))).alias("value"))


def diameter_and_radius(g: Graph) -> DataFrame:
    """One row diameter, radius; infinite where the graph is not connected, 0 without vertices."""
    return eccentricity(g).agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("diameter"), F.coalesce(F.min("value"), F.lit(0.0)).alias("radius"))


def assortativity(g: Graph, variant: str = "out_in") -> DataFrame:
    """One row: Pearson correlation over directed edges of (out-degree of the source, in-degree of the target), or of total degrees (``total``); 0 on zero variance."""
    d = degrees(g)
    x, y = ("out_degree", "in_degree") if variant == "out_in" else ("degree", "degree")
    rows = g.edges.join(d.select(F.col("id").alias("src"), F.col(x).cast("double").alias("x")), "src").join(d.select(F.col("id").alias("dst"), F.col(y).cast("double").alias("y")), "dst")
    s = rows.agg(F.count("*").alias("n"), *[F.sum(e).alias(k) for k, e in (("sx", F.col("x")), ("sy", F.col("y")), ("sxx", F.col("x") * F.col("x")), ("syy", F.col("y") * F.col("y")), ("sxy", F.col("x") * F.col("y")))])
    spread = (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy"))
    value = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(F.when(spread > 0, spread))
    return s.select(F.coalesce(value, F.lit(0.0)).alias("assortativity"))


def vertices_by_pattern(g: Graph, pattern: str) -> DataFrame:
    """id of ``isolated`` (no edges), ``source`` (no in-edges but some out) or ``sink`` (no out-edges but some in) vertices."""
    rule = {"isolated": "degree = 0", "source": "in_degree = 0 AND out_degree > 0", "sink": "out_degree = 0 AND in_degree > 0"}[pattern]
    return degrees(g).where(rule).select("id")


def is_regular(g: Graph) -> DataFrame:
    """One row: at most one different total degree."""
    return degrees(g).agg((F.count_distinct("degree") <= 1).alias("is_regular"))


def degree_extremes(g: Graph) -> DataFrame:
    """One row max_id, max_degree, min_id, min_degree; ties go to the smallest id."""
    d = degrees(g)
    high, low = d.groupBy("degree").agg(F.min("id").alias("id")), F.struct("degree", "id")
    return high.agg(F.max_by("id", "degree").alias("max_id"), F.max("degree").alias("max_degree"), F.min_by("id", low).alias("min_id"), F.min("degree").alias("min_degree"))


def topology_label(n: Column, m: Column, regular: Column, isolated: Column) -> Column:
    """The first that holds of: empty, no edges, complete, regular, has isolated vertices, dense (at least half of all edges), sparse."""
    room = n * (n - 1)
    return (
        F.when(n == 0, "empty")
        .when(m == 0, "no edges")
        .when(m == room, "complete")
        .when(regular, "regular")
        .when(isolated > 0, "has isolated vertices")
        .when(m * 2 >= room, "dense")
        .otherwise("sparse")
    )


def structural_summary(g: Graph) -> DataFrame:
    """One row of 12 fields: vertices, edges, density, regular, isolated, sources, sinks, max_id, max_degree, min_id, min_degree, topology."""
    d = degrees(g)
    count = lambda rule, name: F.sum(F.when(F.expr(rule), 1).otherwise(0)).alias(name)
    s = d.agg(
        F.count("*").alias("vertices"),
        F.coalesce(F.sum("out_degree"), F.lit(0)).alias("edges"),
        (F.count_distinct("degree") <= 1).alias("regular"),
        F.coalesce(count("degree = 0", "isolated"), F.lit(0)).alias("isolated"),
        F.coalesce(count("in_degree = 0 AND out_degree > 0", "sources"), F.lit(0)).alias("sources"),
        F.coalesce(count("out_degree = 0 AND in_degree > 0", "sinks"), F.lit(0)).alias("sinks"),
    )
    room = F.col("vertices") * (F.col("vertices") - 1)
    s = s.withColumn("density", F.when(F.col("vertices") > 1, F.col("edges") / F.when(room > 0, room)).otherwise(0.0))
    s = s.crossJoin(degree_extremes(g))
    return s.withColumn("topology", topology_label(F.col("vertices"), F.col("edges"), F.col("regular"), F.col("isolated")))


def interpret(density_: Column, assortativity_: Column) -> tuple[Column, Column]:
    """Words for a density (below 0.01, below 0.1, above) and an assortativity (below -0.1, up to 0.1, above)."""
    return (
        F.when(density_ < 0.01, "very sparse").when(density_ < 0.1, "sparse").otherwise("dense"),
        F.when(assortativity_ > 0.1, "assortative").when(assortativity_ < -0.1, "disassortative").otherwise("neutral"),
    )


def planarity_screen(g: Graph) -> DataFrame:
    """One row maybe_planar: a screen by counts, not a proof.  True for n <= 4; false above 3n-6 pairs, for the counts of K5, and for those of K3,3 without triangles."""
    p = saved(pairs(g))
    k = p.select(F.col("u").alias("id")).union(p.select("v")).groupBy("id").agg(F.count("*").alias("k")).agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    row = vertex_count(g).crossJoin(p.agg(F.count("*").alias("m"))).crossJoin(k).crossJoin(triangles(g))
    five = (F.col("n") == 5) & (F.col("m") == 10)
    three = (F.col("n") == 6) & (F.col("m") == 9) & (F.col("lo") == 3) & (F.col("hi") == 3) & (F.col("triangles") == 0)
    return row.select((F.when(F.col("n") <= 4, True).when(F.col("m") > 3 * F.col("n") - 6, False).when(five, False).when(F.coalesce(three, F.lit(False)), False).otherwise(True)).alias("maybe_planar"))


def graph_info(g: Graph, name: str) -> DataFrame:
    """One row name, vertices, edges, is_connected, is_complete, is_empty."""
    c = connected_components(g).agg((F.count_distinct("component") <= 1).alias("is_connected"))
    return vertex_count(g).crossJoin(edge_count(g)).crossJoin(c).select(F.lit(name).alias("name"), F.col("n").alias("vertices"), F.col("m").alias("edges"), "is_connected", ((F.col("n") <= 1) | (F.col("m") == F.col("n") * (F.col("n") - 1))).alias("is_complete"), (F.col("m") == 0).alias("is_empty"))
