"""Iteration: every round ends with a checkpoint in the folder that the cluster shares."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window


def checkpoint_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, the folder that driver and executors share.

    Where it is unset, a temporary folder is set for the session if the master is local; on a cluster that is an error,
    as other machines would not see the folder.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        place = "file://" + tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", place)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(place)
    return place.rstrip("/")


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed and written to the shared checkpoint folder; its lineage ends there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame) -> DataFrame:
    """``df`` as saved() does, and without the size that the optimizer has estimated for it.

    That estimate outlives a checkpoint, and a join multiplies those of its sides: in a loop that joins a table to what came of it the digits of the
    number double every round, until the driver spends its memory and time on it.
    """
    spark, table = df.sparkSession, saved(df)
    return DataFrame(spark._jsparkSession.createDataFrame(table._jdf.javaRDD(), table._jdf.schema()), spark)


def iterate(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], done: Callable[[DataFrame, DataFrame, int], bool], max_iter: int) -> tuple[DataFrame, int]:
    """Apply ``step(state, round)`` until ``done(old, new, round)`` or ``max_iter`` rounds; returns (state, rounds)."""
    state = saved(state)
    for i in range(max_iter):
        new = saved(step(state, i))
        if done(state, new, i):
            return new, i + 1
        state = new
    return state, max_iter


def hot_keys(counts: DataFrame, on: str, least: int = 1000, most: int = 100_000) -> list[tuple]:
    """(key, number of salts) of the keys of ``counts(on, n)`` with more than ``least`` rows, four times as many as long as there are more than ``most`` such keys."""
    conf, name = counts.sparkSession.conf, "spark.sql.limit.initialNumPartitions"
    before, limit = conf.get(name), least
    conf.set(name, 1 << 20)  # the bounded collect looks at all partitions in one job
    try:
        while len(hot := counts.where(F.col("n") > limit).select(on, "n").limit(most + 1).collect()) > most:
            limit *= 4
    finally:
        conf.set(name, before)
    return [(r[0], -(-r[1] // limit)) for r in hot]


def join_spread(rows: DataFrame, table: DataFrame, on: str, how: str = "inner", counts: DataFrame | None = None, hot: list[tuple] | None = None, least: int = 1000, most: int = 100_000) -> DataFrame:
    """``rows`` joined (inner or left) to ``table``, which has few rows per key, where one key may hold any share of ``rows``.

    The rows of hot_keys() are dealt over as many salts as they fill, and their rows of ``table`` are repeated for each.  ``counts(on, n)`` saves counting the keys,
    ``hot`` finding the hot ones; null keys are spread too.  Columns: ``on``, the others of rows, the others of table.
    """
    spark = rows.sparkSession
    columns = [on, *[c for c in rows.columns if c != on], *[c for c in table.columns if c != on]]
    if hot is None:
        hot = hot_keys(rows.groupBy(on).agg(F.count("*").alias("n")) if counts is None else counts, on, least, most)
    if not hot:
        return rows.join(table, on, how).select(*columns)
    salts = F.broadcast(spark.createDataFrame(hot, StructType([StructField(on, rows.schema[on].dataType), StructField("_salts", LongType())])))
    place = F.xxhash64(*[c for c in rows.columns if c != on])
    left = rows.join(salts, on, "left").withColumn("_salt", F.pmod(place, F.when(F.col(on).isNull(), 1000).otherwise(F.coalesce("_salts", F.lit(1)))))
    right = table.join(salts, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.drop("_salts").join(right, [on, "_salt"], how).select(*columns)


def dense_index(df: DataFrame, order: list[str], name: str = "index") -> DataFrame:
    """Adds 0..n-1 in the given order: range sort, then each partition's rank plus the rows before it.

    Only one count per partition passes through a single task.
    """
    ordered = saved(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    counts = ordered.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("_part", before.alias("_base"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ordered.withColumn("_rank", rank).join(base, "_part").withColumn(name, (F.col("_base") + F.col("_rank") - 1).cast("long")).drop("_part", "_rank", "_base")


def batches(ids: DataFrame, size: int):
    """The ids in batches of about ``size`` rows, each a DataFrame (column id), for algorithms with a state per source."""
    n = ids.count()
    parts = max(1, -(-n // size))
    for i in range(parts):
        yield ids if parts == 1 else ids.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == i)
