"""Maximum flow and minimum cut: excess pushed in waves along exact distances.

The source fills its edges.  A wave finds every vertex's distance to the sink over open edges, and pushes all excess one
distance down at a time, from the farthest that holds any: only distances that occur are walked.  Vertices that reach the sink no longer (a gap
in the distances) are left out.  Once no excess reaches the sink the cut is known, and the same waves bring the rest back to the source, which cancels
the paths of flow that ended nowhere.  An edge carries flow in one direction and once in a wave, so the residual table is written once for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import Graph
from ..plans.loop import saved
from .paths import levels

#: Residual capacity below this counts as none.
TINY = 1e-9
#: Lanes over which the open edges of one vertex are dealt, so that a hub's edges do not pass through one task.
LANES = 32


def _between(edges: DataFrame, source, sink) -> DataFrame:
    """The edges with capacity on which flow from source to sink can lie: between vertices that the source reaches and that reach the sink."""
    one = edges.sparkSession.range(1)
    some = saved(edges.where(F.col("cap") > TINY))
    ahead = levels(some.select("src", "dst"), one.select(F.lit(source).alias("id"))).select("id")
    some = saved(some.join(ahead.withColumnRenamed("id", "src"), "src", "left_semi"))
    behind = levels(some.select(F.col("dst").alias("src"), F.col("src").alias("dst")), one.select(F.lit(sink).alias("id"))).select("id")
    return some.join(behind.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "cap")


def _pushed(down: DataFrame, have: DataFrame) -> DataFrame:
    """(src, dst, sent): what each of ``have(id, x)`` sends along its edges of ``down(src, dst, cap)``, filled in the order of lanes and ends."""
    at = down.join(have.select(F.col("id").alias("src"), "x"), "src").withColumn("lane", F.pmod(F.xxhash64("dst"), F.lit(LANES)))
    before = lambda order, *by: F.coalesce(F.sum("cap").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    lanes = at.groupBy("src", "lane").agg(F.sum("cap").alias("cap"))  # LANES rows a vertex at most
    at = at.withColumn("inside", before("dst", "src", "lane")).join(lanes.select("src", "lane", before("lane", "src").alias("base")), ["src", "lane"])
    sent = F.least("cap", F.col("x") - F.col("base") - F.col("inside"))
    return at.select("src", "dst", sent.alias("sent")).where(F.col("sent") > 0)


def _waves(residual: DataFrame, excess: DataFrame, goal, other) -> tuple[DataFrame, DataFrame]:
    """Residual and excess once nothing but ``goal`` and ``other`` holds excess that reaches ``goal`` without passing ``other``."""
    start = residual.sparkSession.range(1).select(F.lit(goal).alias("id"))
    while True:
        waiting = excess.where((F.col("id") != goal) & (F.col("id") != other) & (F.col("x") > TINY))
        if not waiting.limit(1).count():
            return residual, excess
        open_ = saved(residual.where((F.col("cap") > TINY) & (F.col("src") != other)))
        height = levels(open_.select(F.col("dst").alias("src"), F.col("src").alias("dst")), start).select("id", F.col("dist").alias("h"))
        waiting = saved(waiting.join(height, "id"))
        held = {r.h for r in waiting.select("h").distinct().collect()}  # as many as there are distances
        if not held:
            return residual, excess
        h, lower = height.select(F.col("id").alias("src"), "h"), height.select(F.col("id").alias("dst"), F.col("h").alias("hd"))
        down = saved(open_.join(h, "src").join(lower, "dst").where("hd = h - 1").select("src", "dst", "cap", "h"))
        moved = sent = None
        for level in range(max(held), 0, -1):
            if level not in held and sent is None:
                continue
            have = waiting.where(F.col("h") == level).select("id", "x")
            if sent is not None:
                have = have.union(sent.select(F.col("dst").alias("id"), F.col("sent").alias("x"))).groupBy("id").agg(F.sum("x").alias("x"))
            sent = saved(_pushed(down.where(F.col("h") == level).drop("h"), have))
            moved = sent if moved is None else moved.union(sent)
        residual = _sent(residual, moved)
        change = moved.select(F.col("src").alias("id"), (-F.col("sent")).alias("x")).union(moved.select("dst", "sent"))
        excess = saved(excess.union(change).groupBy("id").agg(F.sum("x").alias("x")))


def _residual(g: Graph, source, sink) -> tuple[DataFrame, float]:
    """(residual(src, dst, cap), value) of a maximum flow, on the part of the graph between source and sink."""
    if g.edges.where("weight < 0").limit(1).count():
        raise ValueError("negative capacity")
    edges = g.edges.select("src", "dst", F.col("weight").alias("cap"))
    if source == sink:
        return edges, 0.0
    edges = _between(edges, source, sink)
    residual = saved(edges.union(edges.select("dst", "src", F.lit(0.0))).groupBy("src", "dst").agg(F.sum("cap").alias("cap")))
    filled = saved(residual.where((F.col("src") == source) & (F.col("cap") > TINY)).select("src", "dst", F.col("cap").alias("sent")))
    residual, excess = _sent(residual, filled), saved(filled.groupBy(F.col("dst").alias("id")).agg(F.sum("sent").alias("x")))
    residual, excess = _waves(residual, excess, sink, source)
    value = excess.where(F.col("id") == sink).agg(F.coalesce(F.sum("x"), F.lit(0.0))).first()[0]
    return _waves(residual, excess, source, sink)[0], value


def _sent(residual: DataFrame, sent: DataFrame) -> DataFrame:
    """The residual table after amounts sent(src, dst, sent)."""
    delta = sent.select("src", "dst", (-F.col("sent")).alias("d")).union(sent.select("dst", "src", "sent")).groupBy("src", "dst").agg(F.sum("d").alias("d"))
    return saved(residual.join(delta, ["src", "dst"], "left").select("src", "dst", (F.col("cap") + F.coalesce("d", F.lit(0.0))).alias("cap")))


def max_flow(g: Graph, source, sink) -> tuple[float, DataFrame]:
    """(value, flow edges (src, dst, flow) above 1e-9); capacities are the edge weights; source = sink gives 0.

    A negative weight raises ValueError; a sink that is not reached has value 0 and no edges.
    """
    residual, value = _residual(g, source, sink)
    used = g.edges.join(residual, ["src", "dst"]).select("src", "dst", (F.col("weight") - F.col("cap")).alias("flow"))
    return value, used.where(F.col("flow") > TINY)


def min_cut(g: Graph, source, sink) -> tuple[float, DataFrame]:
    """(value, (id, source_side)): what the residual still reaches from the source, and the rest."""
    residual, value = _residual(g, source, sink)
    untouched = g.edges.join(residual, ["src", "dst"], "left_anti").select("src", "dst", F.col("weight").alias("cap"))
    start = g.vertices.where(F.col("id") == source).select("id")
    side = levels(residual.union(untouched).where(F.col("cap") > TINY).select("src", "dst"), start).select("id", F.lit(True).alias("_s"))
    return value, g.vertices.select("id").join(side, "id", "left").select("id", F.col("_s").isNotNull().alias("source_side"))
