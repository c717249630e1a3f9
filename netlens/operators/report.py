"""Rankings and bundles of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph, degrees
from .centrality import pagerank
from .communities import label_propagation
from .structure import assortativity, density, graph_info


def top_k(metric: DataFrame, k: int, labels: DataFrame | None = None, value: str = "value") -> DataFrame:
    """The k highest of metric(id, value), descending, ties by id, with labels(id, label) if given."""
    top = metric.orderBy(F.desc(value), "id").limit(k)
    return top if labels is None else top.join(labels.select("id", "label"), "id", "left")


def full_analysis(g: Graph, name: str, k: int = 10) -> DataFrame:
    """One tall table (metric, id, value) of counts, density, assortativity, the top ranks and the community sizes."""
    info = graph_info(g, name)
    text = F.col("id").cast("string")
    one = lambda df, c, m: df.select(F.lit(m).alias("metric"), F.lit(None).cast("string").alias("id"), F.col(c).cast("double").alias("value"))
    out = one(info, "vertices", "vertices").union(one(info, "edges", "edges")).union(one(density(g), "density", "density")).union(one(assortativity(g), "assortativity", "assortativity"))
    out = out.union(top_k(pagerank(g), k).select(F.lit("pagerank"), text, "value"))
    out = out.union(top_k(degrees(g).select("id", F.col("degree").cast("double").alias("value")), k).select(F.lit("degree"), text, "value"))
    return out.union(label_propagation(g).groupBy(F.col("component").cast("string").alias("id")).agg(F.count("*").cast("double").alias("value")).select(F.lit("community_size"), "id", "value"))
