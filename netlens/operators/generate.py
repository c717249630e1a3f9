"""Generated graphs.  Random ones hash (seed, position), so they repeat under any partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..graph import Graph, graph
from ..plans.loop import saved


def _ids(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).toDF("id")


def _both(p: DataFrame) -> DataFrame:
    return p.select("src", "dst").union(p.select("dst", "src"))


def _uniform(seed: int, *cols) -> Column:
    """In [0, 1), a hash of seed and columns."""
    return F.xxhash64(F.lit(seed), *cols).bitwiseAND(F.lit(2**53 - 1)).cast("double") / float(2**53)


def empty(spark: SparkSession, n: int) -> Graph:
    return graph(spark.createDataFrame([], "src long, dst long"), _ids(spark, n))


def complete(spark: SparkSession, n: int) -> Graph:
    """Every ordered pair, each vertex making its own row of pairs."""
    e = _ids(spark, n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n - 1, 0)).cast("long"))).alias("dst"))
    return graph(e, _ids(spark, n))


def path(spark: SparkSession, n: int) -> Graph:
    return graph(_both(spark.range(max(n - 1, 0)).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))), _ids(spark, n))


def cycle(spark: SparkSession, n: int) -> Graph:
    """A path, closed where n > 2."""
    if n <= 2:
        return path(spark, n)
    return graph(_both(spark.range(n).select(F.col("id").alias("src"), F.pmod(F.col("id") + 1, F.lit(n)).alias("dst"))), _ids(spark, n))


def star(spark: SparkSession, n: int) -> Graph:
    """Centre 0 and n leaves."""
    return graph(_both(spark.range(1, n + 1).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))), _ids(spark, n + 1))


def two_cliques_bridge(spark: SparkSession, size: int) -> Graph:
    """Two cliques of ``size`` vertices that share vertex 0."""
    n = 2 * size - 1
    side = lambda c: F.when(c == 0, F.lit(None)).otherwise((c >= size).cast("int"))
    e = complete(spark, n).edges
    return graph(e.where(F.coalesce(side(F.col("src")) == side(F.col("dst")), F.lit(True))), _ids(spark, n))


def erdos_renyi(spark: SparkSession, n: int, p: float, seed: int = 42) -> Graph:
    """Each undirected pair with probability p, both directions.  A row u draws its partners v > u by geometric skips, so
    work follows the number of pairs kept, not of all pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            src, dst = [], []
            for u in batch.column(0).to_pylist():
                rng, v = np.random.default_rng([seed, u]), u
                while 0 < p:
                    v += int(rng.geometric(p)) if p < 1 else 1
                    if v >= n:
                        break
                    src.append(u)
                    dst.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return graph(_both(saved(_ids(spark, n).mapInArrow(run, "src long, dst long"))), _ids(spark, n))


def barabasi_albert(spark: SparkSession, n: int, m: int, seed: int = 42) -> Graph:
    """Preferential attachment of m edges per vertex; 1 <= m < n, else ValueError.

    Ends are slots of a list in which vertex m + i // m owns slot 2i and slot 2i + 1 copies a uniformly drawn earlier slot
    (Sanders and Schulz 2016); each is retraced from hashes alone, so slots need no shared state.  Repeated pairs collapse.
    """
    if not 1 <= m < n:
        raise ValueError("m must be at least 1 and below n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.column(0).to_numpy().astype(np.int64)
            slot = 2 * i + 1
            odd = np.ones(len(i), bool)
            while odd.any():
                at = slot[odd].astype(np.uint64)
                x = (at + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
                x ^= x >> np.uint64(31)
                x *= np.uint64(0xD6E8FEB86659FD93)
                x ^= x >> np.uint64(32)
                slot[odd] = (x % at).astype(np.int64)
                odd = slot % 2 == 1
            owner = m + i // m
            target = m + (slot // 2) // m
            # the first vertex's own slots stand for the m starting vertices
            target = np.where(target >= owner, i % m, target)
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(target)], names=["src", "dst"])

    return graph(_both(spark.range((n - m) * m).mapInArrow(run, "src long, dst long")), _ids(spark, n))


def watts_strogatz(spark: SparkSession, n: int, k: int, p: float, seed: int = 42) -> Graph:
    """A ring with k (even, below n) neighbours each, every edge's far end rewired with probability p.  A draw that hits itself or a
    pair taken is drawn again, in rounds, and stays unrewired after 20."""
    if k % 2 or k >= n:
        raise ValueError("k must be even and below n")
    ring = spark.range(n).select(F.col("id").alias("u"), F.explode(F.sequence(F.lit(1), F.lit(k // 2))).alias("j"))
    ring = saved(ring.select("u", "j", F.pmod(F.col("u") + F.col("j"), F.lit(n)).alias("v"), (_uniform(seed, "u", "j") < p).alias("move")))
    kept = ring.where("NOT move").select("u", "v")
    left = saved(ring.where("move"))
    for i in range(20):
        if not left.limit(1).count():
            break
        draw = left.withColumn("w", F.floor(_uniform(seed + 1, F.lit(i), "u", "j") * n))
        a, b = F.least("u", "w"), F.greatest("u", "w")
        taken = kept.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
        ok = draw.where("w <> u").withColumn("a", a).withColumn("b", b).join(taken, ["a", "b"], "left_anti")
        won = saved(ok.groupBy("a", "b").agg(F.min(F.struct("u", "j", "w")).alias("x")).select("x.u", "x.j", F.col("x.w").alias("v")))
        kept = saved(kept.union(won.select("u", "v")))
        left = saved(left.join(won.select("u", "j"), ["u", "j"], "left_anti"))
    kept = kept.union(left.select("u", "v"))
    return graph(_both(kept.select(F.col("u").alias("src"), F.col("v").alias("dst"))), _ids(spark, n))
