"""Minimum spanning forests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, pairs
from ..plans.loop import fresh as saved
from .components import components_of, connected_components


def minimum_spanning_forest(g: Graph, start=None) -> DataFrame:
    """(u, v, weight) of the forest that is minimal in the order (weight, u, v): Borůvka rounds, each on the components and the least pairs between them that the last one left.

    A pair's weight is that of its lighter direction.  With ``start`` only that vertex's component is covered.
    """
    once = g.edges.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.min("weight").alias("weight"))
    if start is not None:
        comp = saved(connected_components(g))
        own = comp.join(comp.where(F.col("id") == start).select("component"), "component").select(F.col("id").alias("u"))
        once = once.join(own, "u", "left_semi")
    once = saved(once)
    # pairs between components a and b, of which only the least of each two is kept, so a round works on what the last one left
    cross, chosen = once.select(F.col("u").alias("a"), F.col("v").alias("b"), F.struct("weight", "u", "v").alias("e")), None
    while True:
        ends = cross.select(F.col("a").alias("c"), "e", "a", "b").union(cross.select("b", "e", "a", "b"))
        best = saved(ends.groupBy("c").agg(F.min(F.struct("e", "a", "b")).alias("x")).select("c", "x.e", "x.a", "x.b"))
        if not best.limit(1).count():
            return chosen if chosen is not None else once.limit(0)
        picked = best.select("e.u", "e.v", "e.weight").distinct()
        chosen = saved(picked if chosen is None else chosen.union(picked))
        home = saved(components_of(best.select(F.col("c").alias("id")), best.select(F.col("a").alias("src"), F.col("b").alias("dst"))))
        a, b = home.select(F.col("id").alias("a"), F.col("component").alias("ca")), home.select(F.col("id").alias("b"), F.col("component").alias("cb"))
        far = cross.join(a, "a").join(b, "b").where("ca <> cb")
        cross = saved(far.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.min("e").alias("e")))


def is_tree(g: Graph) -> DataFrame:
    """One row is_tree: connected with n - 1 undirected pairs."""
    n = g.vertices.agg(F.count("*").alias("n"))
    m = pairs(g).agg(F.count("*").alias("m"))
    c = connected_components(g).agg(F.count_distinct("component").alias("c"))
    return n.crossJoin(m).crossJoin(c).select(((F.col("c") == 1) & (F.col("m") == F.col("n") - 1)).alias("is_tree"))
