"""Interactions and graphs from the star-schema tables.

A thread is (props.k, day of ts); an event answers the one before it in its thread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import Graph, graph

#: Event types as interaction types; others are unknown.
EVENT_TYPES = {"click": "comment", "view": "issue_commented", "signup": "review", "purchase": "merge"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def interactions_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """actor, target, type (``unknown`` for other event types), created_at, ref_id; first events of threads answer nobody and go."""
    e = read(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    before = Window.partitionBy("k", F.to_date("ts")).orderBy("ts", "event_id")
    kind = F.coalesce(*[F.when(F.col("event_type") == a, b) for a, b in EVENT_TYPES.items()], F.lit("unknown"))
    rows = e.select(F.col("user_id").alias("actor"), F.lag("user_id").over(before).alias("target"), kind.alias("type"), F.col("ts").alias("created_at"), F.col("event_id").alias("ref_id"))
    return rows.where("target IS NOT NULL")


def all_pairs_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Every pair of different users who interacted, weighted by how often."""
    i = interactions_from_tables(spark, sf_dir).where("actor <> target")
    return graph(i.groupBy(F.col("actor").alias("src"), F.col("target").alias("dst")).agg(F.count("*").cast("double").alias("weight")))


def frequent_graph(spark: SparkSession, sf_dir: str, least: int = 3) -> Graph:
    """Undirected pairs with at least ``least`` interactions in either direction, as edges both ways, weighted by their number."""
    i = interactions_from_tables(spark, sf_dir).where("actor <> target")
    p = i.groupBy(F.least("actor", "target").alias("u"), F.greatest("actor", "target").alias("v")).agg(F.count("*").cast("double").alias("weight")).where(F.col("weight") >= least)
    return graph(p.select(F.col("u").alias("src"), F.col("v").alias("dst"), "weight").union(p.select("v", "u", "weight")))


def acyclic_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The edges of all_pairs_graph that lead to larger ids."""
    g = all_pairs_graph(spark, sf_dir)
    return graph(g.edges.where("src < dst"), g.vertices)


def trade_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Supplier nation → customer nation, weighted by the number of order lines."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    sellers = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("src"))
    buyers = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("dst"))
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    return graph(rows.groupBy("src", "dst").agg(F.count("*").cast("double").alias("weight")))
