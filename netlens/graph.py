"""A graph is a pair of DataFrames: vertices(id, label, weight) and edges(src, dst, weight).

Edges are directed, without self-loops, one per (src, dst), of a weight other than 0.  Ids are of any
orderable type.  All operators return new DataFrames; nothing is changed in place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .plans.loop import dense_index, saved


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame

    def saved(self) -> Graph:
        """Both tables computed once, for use in loops."""
        return Graph(saved(self.vertices), saved(self.edges))

    @property
    def spark(self):
        return self.edges.sparkSession


def graph(edges: DataFrame, vertices: DataFrame | None = None) -> Graph:
    """A graph from rows (src, dst[, weight]): self-loops, null ends and zero weights go, the last of repeated pairs does not matter as equal pairs keep the largest weight; missing vertices are added with weight 1."""
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    clean = edges.select("src", "dst", weight.alias("weight")).where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst AND weight <> 0")
    clean = clean.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    ends = clean.select(F.col("src").alias("id")).union(clean.select("dst")).distinct()
    if vertices is None:
        return Graph(ends.select("id", F.col("id").cast("string").alias("label"), F.lit(1.0).alias("weight")), clean)
    label = F.coalesce(F.col("label"), F.col("id").cast("string")) if "label" in vertices.columns else F.col("id").cast("string")
    mass = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in vertices.columns else F.lit(1.0)
    given = vertices.select("id", label.alias("label"), mass.alias("weight")).dropDuplicates(["id"])
    rest = ends.join(given, "id", "left_anti").select("id", F.col("id").cast("string").alias("label"), F.lit(1.0).alias("weight"))
    return Graph(given.union(rest), clean)


def pairs(g: Graph) -> DataFrame:
    """Undirected pairs (u, v), u < v, each once."""
    return g.edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()


def both_ways(g: Graph) -> DataFrame:
    """Neighbour rows (src, dst) of the underlying undirected graph, both directions, each once."""
    p = pairs(g)
    return p.select(F.col("u").alias("src"), F.col("v").alias("dst")).union(p.select("v", "u"))


# ---------------------------------------------------------------- editing


def upsert_edges(g: Graph, edges: DataFrame) -> Graph:
    """Add edges; a pair that is there gets the new weight (null: keeps its own, or 1 where new)."""
    new = edges.where("src <> dst").groupBy("src", "dst").agg(F.max("weight").alias("new"))
    merged = g.edges.join(new, ["src", "dst"], "full").select("src", "dst", F.coalesce("new", "weight", F.lit(1.0)).alias("weight"))
    return graph(merged, g.vertices)


def remove_edges(g: Graph, probes: DataFrame) -> Graph:
    """Remove pairs; absent ones do not matter."""
    return Graph(g.vertices, g.edges.join(probes.select("src", "dst"), ["src", "dst"], "left_anti"))


def add_vertices(g: Graph, vertices: DataFrame) -> Graph:
    """Add vertices(id[, label, weight]); ids that are there stay as they are."""
    return graph(g.edges, g.vertices.unionByName(vertices.join(g.vertices.select("id"), "id", "left_anti"), allowMissingColumns=True))


def set_vertex_weights(g: Graph, weights: DataFrame) -> Graph:
    """Weights from weights(id, weight); other vertices keep theirs."""
    new = weights.select("id", F.col("weight").cast("double").alias("new"))
    return Graph(g.vertices.join(new, "id", "left").select("id", "label", F.coalesce("new", "weight").alias("weight")), g.edges)


def set_labels(g: Graph, labels: DataFrame) -> Graph:
    """Labels from labels(id, label); other vertices keep theirs."""
    new = labels.select("id", F.col("label").alias("new"))
    return Graph(g.vertices.join(new, "id", "left").select("id", F.coalesce("new", "label").alias("label"), "weight"), g.edges)


def undirected(g: Graph, weight: str = "mean") -> Graph:
    """The underlying undirected graph, as edges in both directions.

    ``mean``: opposite edges average.  ``first``: the weight of the edge that leaves the smaller id, else the other's.
    ``mirror``: each edge keeps its weight and a missing reverse edge gets the same.  The given graph is unchanged.
    """
    if weight == "mirror":
        back = g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight")
        return Graph(g.vertices, g.edges.unionByName(back.join(g.edges.select("src", "dst"), ["src", "dst"], "left_anti")))
    value = {"mean": F.avg("weight"), "first": F.min_by("weight", "src")}[weight]
    once = g.edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), "src", "weight").groupBy("u", "v").agg(value.alias("weight"))
    both = once.select(F.col("u").alias("src"), F.col("v").alias("dst"), "weight").union(once.select("v", "u", "weight"))
    return Graph(g.vertices, both)


def graph_union(a: Graph, b: Graph) -> Graph:
    """Vertices and edges of both; a pair in both keeps the larger weight."""
    return graph(a.edges.unionByName(b.edges), a.vertices.unionByName(b.vertices.join(a.vertices.select("id"), "id", "left_anti")))


def restrict(g: Graph, ids: DataFrame) -> Graph:
    """The subgraph induced by ids(id)."""
    keep = ids.select("id").distinct()
    inside = g.edges.join(keep.withColumnRenamed("id", "src"), "src", "left_semi").join(keep.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return Graph(g.vertices.join(keep, "id", "left_semi"), inside.select("src", "dst", "weight"))


# ---------------------------------------------------------------- the graph API, as set operators


def vertex_count(g: Graph) -> DataFrame:
    return g.vertices.agg(F.count("*").alias("n"))


def edge_count(g: Graph, directed: bool = True) -> DataFrame:
    return (g.edges if directed else pairs(g)).agg(F.count("*").alias("m"))


def has_edge(g: Graph, probes: DataFrame) -> DataFrame:
    """Each probe (src, dst) with has_edge; a self pair is false."""
    there = g.edges.select("src", "dst", F.lit(True).alias("_there"))
    return probes.join(there, ["src", "dst"], "left").withColumn("has_edge", F.col("_there").isNotNull()).drop("_there")


def is_successor(g: Graph, probes: DataFrame) -> DataFrame:
    """Each probe (u, v) with is_successor: v follows u."""
    return has_edge(g, probes.withColumnsRenamed({"u": "src", "v": "dst"})).select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col("has_edge").alias("is_successor"))


def is_predecessor(g: Graph, probes: DataFrame) -> DataFrame:
    """Each probe (u, v) with is_predecessor: v precedes u."""
    return has_edge(g, probes.withColumnsRenamed({"u": "dst", "v": "src"})).select(F.col("dst").alias("u"), F.col("src").alias("v"), F.col("has_edge").alias("is_predecessor"))


def divergent(g: Graph, probes: DataFrame, strict: bool = True) -> DataFrame:
    """Probes (u1, v1, u2, v2) with divergent: both edges exist and leave one vertex (strict: to different ones)."""
    return _edge_relation(g, probes, F.col("u1") == F.col("u2"), F.col("v1") != F.col("v2"), strict, "divergent")


def convergent(g: Graph, probes: DataFrame, strict: bool = True) -> DataFrame:
    """Probes (u1, v1, u2, v2) with convergent: both edges exist and enter one vertex (strict: from different ones)."""
    return _edge_relation(g, probes, F.col("v1") == F.col("v2"), F.col("u1") != F.col("u2"), strict, "convergent")


def _edge_relation(g, probes, same, differ, strict, name):
    out = probes
    for i in ("1", "2"):
        out = out.join(g.edges.select(F.col("src").alias("u" + i), F.col("dst").alias("v" + i), F.lit(True).alias("_e" + i)), ["u" + i, "v" + i], "left")
    there = F.col("_e1").isNotNull() & F.col("_e2").isNotNull() & same
    return out.select(*probes.columns, (there & differ if strict else there).alias(name))


def divergent_counts(g: Graph) -> DataFrame:
    """id and the number of unordered pairs of edges that leave it: d(d-1)/2, without making the pairs."""
    return g.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d")).select("id", (F.col("d") * (F.col("d") - 1) / 2).cast("long").alias("n_pairs"))


def convergent_counts(g: Graph) -> DataFrame:
    """id and the number of unordered pairs of edges that enter it."""
    return g.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("d")).select("id", (F.col("d") * (F.col("d") - 1) / 2).cast("long").alias("n_pairs"))


def divergent_pairs(g: Graph, limit: int) -> DataFrame:
    """Pairs of edges with one source, the first ``limit`` by (src, dst1, dst2); the limit is the feature."""
    return _shared_end(g, "src", "dst", limit)


def convergent_pairs(g: Graph, limit: int) -> DataFrame:
    """Pairs of edges with one target, the first ``limit`` by (dst, src1, src2)."""
    return _shared_end(g, "dst", "src", limit)


def _shared_end(g: Graph, shared: str, other: str, limit: int) -> DataFrame:
    """Edges are numbered by (shared, other) in a range sort.  Only the first ends of pairs that can be among the first ``limit`` of their vertex are joined to the vertex's edges, so a hub makes few rows."""
    e = saved(dense_index(g.edges.select(shared, other), [shared, other], "k"))
    hub = e.groupBy(shared).agg(F.min("k").alias("k0"), F.count("*").alias("d"))
    ranked = e.join(hub, shared).select(shared, other, (F.col("k") - F.col("k0")).alias("r"), "d")
    before = F.col("r") * F.col("d") - F.col("r") * (F.col("r") + 1) / 2
    a = ranked.where(before < limit).select(shared, F.col(other).alias(other + "1"), F.col("r").alias("r1"))
    b = ranked.select(shared, F.col(other).alias(other + "2"), F.col("r").alias("r2"))
    both = a.join(b, shared).where(f"r1 < r2 AND r2 - r1 <= {limit}").drop("r1", "r2")
    return both.orderBy(shared, other + "1", other + "2").limit(limit)


def incident(g: Graph, ids: DataFrame) -> DataFrame:
    """(id, src, dst, weight): the edges that touch each of ids(id), as two equi-joins."""
    probe = ids.select("id").distinct()
    out = g.edges.join(probe, F.col("src") == F.col("id")).select("id", "src", "dst", "weight")
    return out.union(g.edges.join(probe, F.col("dst") == F.col("id")).select("id", "src", "dst", "weight"))


def degrees(g: Graph) -> DataFrame:
    """id, in_degree, out_degree, degree (their sum), zeros included: one aggregation over both ends."""
    ends = g.edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).union(g.edges.select("dst", F.lit(1), F.lit(0)))
    ends = ends.union(g.vertices.select("id", F.lit(0), F.lit(0)))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.sum(F.col("i") + F.col("o")).alias("degree"))


def degree_sequence(g: Graph) -> DataFrame:
    """degree and the number of vertices with it: the ordered sequence in run lengths."""
    return degrees(g).groupBy("degree").agg(F.count("*").alias("n"))


def neighbor_counts(g: Graph) -> DataFrame:
    """id and n_neighbors: different vertices joined by an edge in either direction, zeros included."""
    near = both_ways(g).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("k"))
    return g.vertices.select("id").join(near, "id", "left").select("id", F.coalesce("k", F.lit(0)).alias("n_neighbors"))


def neighbors(g: Graph, kind: str = "any") -> DataFrame:
    """id and its sorted set of ``out`` (successors), ``in`` (predecessors) or ``any`` neighbours, empty ones included."""
    rows = {"out": g.edges.select("src", "dst"), "in": g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "any": both_ways(g)}[kind]
    sets = rows.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_set("dst")).alias("neighbors"))
    return g.vertices.select("id").join(sets, "id", "left").select("id", F.coalesce("neighbors", F.array().cast(sets.schema["neighbors"].dataType)).alias("neighbors"))


def adjacency_list(g: Graph) -> DataFrame:
    """id and its list of (dst, weight) in ascending order, empty where there is none."""
    lists = g.edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("dst", "weight"))).alias("adjacent"))
    return g.vertices.select("id").join(lists, "id", "left").select("id", F.coalesce("adjacent", F.array().cast(lists.schema["adjacent"].dataType)).alias("adjacent"))


def is_empty(g: Graph, variant: str = "edges") -> bool:
    """Whether there is no vertex (``vertices``) or no edge (``edges``)."""
    return not (g.vertices if variant == "vertices" else g.edges).limit(1).count()


def is_complete(g: Graph, directed: bool = True) -> DataFrame:
    """One row is_complete: every possible edge is there; at most one vertex counts as complete."""
    n, m = vertex_count(g), edge_count(g, directed)
    full = F.col("n") * (F.col("n") - 1) / (1 if directed else 2)
    return n.crossJoin(m).select(((F.col("n") <= 1) | (F.col("m") == full)).alias("is_complete"))
