"""Sinks: GEXF, edge lists, interaction CSV, refined JSON.  Executors format and write the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.loop import dense_index


def _escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def write_gexf(g: Graph, path: str, directed: bool = True, vertex_weight: bool = False) -> None:
    """A folder of text parts that, in name order, are one GEXF 1.3 document.

    Header, nodes, edges and footer are rows with a section number and are range-sorted into the parts, so that no
    row passes through the driver.  Edge weights have four decimals, edge ids run from 0 by (src, dst); an
    undirected graph is written with each pair once.
    """
    spark = g.spark
    kind = "directed" if directed else "undirected"
    text = lambda section, line: spark.createDataFrame([(section, 0, line)], "s int, n long, value string")
    mass = F.format_string(' weight="%.4f"', F.col("weight")) if vertex_weight else F.lit("")
    nodes = dense_index(g.vertices.select("id", "label", "weight"), ["id"], "n")
    nodes = nodes.select(F.lit(1).alias("s"), "n", F.concat(F.lit('<node id="'), _escape(F.col("id").cast("string")), F.lit('" label="'), _escape(F.col("label")), F.lit('"'), mass, F.lit("/>")).alias("value"))
    edges = g.edges if directed else g.edges.where("src < dst")
    edges = dense_index(edges, ["src", "dst"], "n")
    edges = edges.select(F.lit(3).alias("s"), "n", F.concat(F.lit('<edge id="'), F.col("n"), F.lit('" source="'), _escape(F.col("src").cast("string")), F.lit('" target="'), _escape(F.col("dst").cast("string")), F.format_string('" weight="%.4f"/>', F.col("weight"))).alias("value"))
    head = text(0, f'<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3">\n<graph defaultedgetype="{kind}">\n<nodes>')
    rows = head.union(nodes).union(text(2, "</nodes>\n<edges>")).union(edges).union(text(4, "</edges>\n</graph>\n</gexf>"))
    rows.repartitionByRange("s", "n").sortWithinPartitions("s", "n").select("value").write.mode("overwrite").text(path)


def write_edgelist(g: Graph, path: str, sep: str = " ") -> None:
    """One line ``u v w`` per undirected pair, the weight that of the edge leaving the smaller id where there is one."""
    once = g.edges.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.min_by("weight", "src").alias("w"))
    once.select(F.concat_ws(sep, "u", "v", "w").alias("value")).write.mode("overwrite").text(path)


def write_interactions_csv(df: DataFrame, path: str) -> None:
    """actor, target, type with a header, from rows (author, mentions array[, assignees array], type) or (actor, target, type); self and empty pairs go."""
    if "mentions" in df.columns:
        names = [F.coalesce(c, F.array().cast("array<string>")) for c in ("mentions", "assignees") if c in df.columns]
        df = df.select(F.col("author").alias("actor"), F.explode(F.array_distinct(F.concat(*names))).alias("target"), "type")
    df.where("actor <> '' AND target <> '' AND actor <> target").select("actor", "target", "type").write.mode("overwrite").csv(path, header=True)


def write_refined_json(interactions: DataFrame, users: DataFrame, path: str) -> None:
    """``interactions`` (source, target, type) and ``users`` (login, id) as JSON lines in two folders below ``path``, with a one-row metadata folder."""
    interactions.select("source", "target", "type").write.mode("overwrite").json(f"{path}/interactions")
    users.select("login", "id").write.mode("overwrite").json(f"{path}/users")
    users.agg(F.count("*").alias("total_users")).crossJoin(interactions.agg(F.count("*").alias("total_interactions"))).write.mode("overwrite").json(f"{path}/metadata")


def export_four_graphs(graphs: dict[str, Graph], directory: str, prefix: str) -> list[str]:
    """One GEXF folder per graph; returns their paths."""
    paths = [f"{directory}/{prefix}_{name}.gexf" for name in graphs]
    for path, g in zip(paths, graphs.values()):
        write_gexf(g, path)
    return paths
