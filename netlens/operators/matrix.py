"""Matrices as tables of (row, column, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, pairs
from ..plans.loop import dense_index


def adjacency_coo(g: Graph) -> DataFrame:
    """(row, col, value) of the weights."""
    return g.edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.col("weight").alias("value"))


def laplacian_coo(g: Graph) -> DataFrame:
    """(row, col, value): minus the weight off the diagonal, the sum of out-weights on it (zeros kept)."""
    out = g.edges.groupBy(F.col("src").alias("id")).agg(F.sum("weight").alias("w"))
    diagonal = g.vertices.select("id").join(out, "id", "left").select(F.col("id").alias("row"), F.col("id").alias("col"), F.coalesce("w", F.lit(0.0)).alias("value"))
    return diagonal.union(g.edges.select("src", "dst", -F.col("weight")))


def incidence_coo(g: Graph) -> DataFrame:
    """(row, col, value): 1 at both ends of each undirected pair; columns number the pairs by (u, v) from 0."""
    p = dense_index(pairs(g), ["u", "v"], "col")
    return p.select(F.explode(F.array("u", "v")).alias("row"), "col", F.lit(1).alias("value"))
