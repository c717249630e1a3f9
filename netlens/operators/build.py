"""Interactions to graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.activity import CLOSURE, COMMENT, MERGE, REVIEW, type_weight
from ..graph import Graph, graph

#: Weights of the shared-vertex form.
SHARED_WEIGHTS = {"comment": 2.0, "issue_response": 3.0, "review": 4.0, "merge": 5.0, "issue_close": 4.0}


def people(inter: DataFrame) -> DataFrame:
    """id: everyone who appears at either end, also in self pairs only."""
    return inter.select(F.col("actor").alias("id")).union(inter.select("target")).where("id IS NOT NULL").distinct()


def simple_graph(inter: DataFrame, types: list[str]) -> Graph:
    """Different pairs of the given types, weight 1; users seen only in self pairs stay as isolated vertices."""
    rows = inter.where(F.col("type").isin(types))
    return graph(rows.select(F.col("actor").alias("src"), F.col("target").alias("dst")), people(rows))


def weighted_graph(inter: DataFrame, weights: dict | None = None, default: float = 1.0) -> Graph:
    """Sum of type weights per pair; an unknown type weighs ``default``."""
    rows = inter.where("actor <> target")
    total = rows.groupBy(F.col("actor").alias("src"), F.col("target").alias("dst")).agg(F.sum(type_weight(F.col("type"), weights, default)).alias("weight"))
    return graph(total, people(inter))


def build_all_graphs(inter: DataFrame) -> dict[str, Graph]:
    """graph1 comments, graph2 closures, graph3 reviews and merges, integrated: all, weighted."""
    return {"graph1": simple_graph(inter, [COMMENT]), "graph2": simple_graph(inter, [CLOSURE]), "graph3": simple_graph(inter, [REVIEW, MERGE]), "integrated": weighted_graph(inter)}


def build_graphs_shared_vertices(inter: DataFrame, weights: dict | None = None) -> dict[str, Graph]:
    """Graphs comments, closures, reviews_merges and integrated on one vertex set; unknown types and self pairs make no edge, yet their users remain."""
    weights = weights or SHARED_WEIGHTS
    vertices = people(inter)
    known = inter.where(F.col("type").isin(list(weights)) & (F.col("actor") != F.col("target")))
    parts = {"comments": ["comment"], "closures": ["issue_response", "issue_close"], "reviews_merges": ["review", "merge"], "integrated": list(weights)}

    def one(types: list[str]) -> Graph:
        rows = known.where(F.col("type").isin(types)).groupBy(F.col("actor").alias("src"), F.col("target").alias("dst"))
        return graph(rows.agg(F.sum(type_weight(F.col("type"), weights, 0.0)).alias("weight")), vertices)

    return {name: one(types) for name, types in parts.items()}
