"""Structured Streaming forms: raw part files arriving in a folder, de-duplicated, as running weights and windowed counts."""

from __future__ import annotations

import json
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.activity import type_weight
from ..plans import files
from ..sources.readers import RAW_SCHEMAS


def stream_raw(spark: SparkSession, directory: str, kind: str, schema: str | None = None, files_per_trigger: int = 100) -> DataFrame:
    """Records of JSON part files as they arrive; a file that is there counts once."""
    reader = spark.readStream.schema(schema or RAW_SCHEMAS[kind]).option("maxFilesPerTrigger", files_per_trigger)
    return reader.option("multiLine", True).option("pathGlobFilter", f"{kind}_part_*.json").json(directory)


def stream_dedupe(df: DataFrame, key: str = "id", time: str = "created_at", delay: str = "1 day") -> DataFrame:
    """The first record of every key within the watermark; state for older keys is dropped."""
    return df.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def stream_edge_weights(df: DataFrame, weights: dict | None = None) -> DataFrame:
    """Running (src, dst, weight) of a stream of (actor, target, type), for update or complete mode: equal to the batch graph of the same rows."""
    rows = df.where("actor <> target")
    return rows.groupBy(F.col("actor").alias("src"), F.col("target").alias("dst")).agg(F.sum(type_weight(F.col("type"), weights)).alias("weight"))


def stream_window_counts(df: DataFrame, width: str = "1 day", delay: str = "1 day", time: str = "created_at") -> DataFrame:
    """Interactions per type and tumbling window; rows later than the watermark are dropped; append mode, or complete mode, which drops nothing."""
    return df.withWatermark(time, delay).groupBy(F.window(time, width), "type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "type", "n")


def _latest(path: str) -> tuple[int, dict[int, str]]:
    """(number of the last batch that was merged, folder of each bucket)."""
    where, root = files.filesystem(path)
    states = sorted(f.path for f in where.get_file_info(fs.FileSelector(f"{root}/state", allow_not_found=True)) if f.path.endswith(".json"))
    if not states:
        return -1, {}
    with where.open_input_stream(states[-1]) as f:
        state = json.loads(f.read())
    return state["batch"], {int(k): v for k, v in state["buckets"].items()}


def merge_weights(spark: SparkSession, path: str, buckets: int = 64, keep: int = 2):
    """A foreachBatch function that keeps the latest weight per pair of update batches in a bucketed store below ``path``, for merged_weights().

    Pairs lie in ``buckets`` by hash.  A batch reads and writes only the buckets that it touches, each as one new file, and then a small state file that names every bucket's folder; a
    batch counts once that file is there, so one that is run again, or an older one, changes nothing, and numbers may be skipped.  The ``keep`` newest states and what they name stay,
    older folders go.
    """

    def write(batch: DataFrame, number: int) -> None:
        last, held = _latest(path)
        if number <= last:
            return
        bucket = F.pmod(F.xxhash64("src", "dst"), F.lit(buckets)).cast("int").alias("bucket")
        new = batch.select("src", "dst", "weight", bucket).persist()
        touched = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets``
        old = [f"{path}/{held[b]}/bucket={b}" for b in touched if b in held]
        rows = new
        if old:
            rest = batch.sparkSession.read.schema(batch.select("src", "dst", "weight").schema).parquet(*old).join(new, ["src", "dst"], "left_anti")
            rows = rest.select("src", "dst", "weight", bucket).unionByName(new)
        folder = f"data/{number:020d}-{uuid.uuid4().hex}"
        if touched:
            rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{folder}")
        new.unpersist()
        where, root = files.filesystem(path)
        where.create_dir(f"{root}/state", recursive=True)
        draft = f"{root}/state/{uuid.uuid4().hex}.draft"
        with where.open_output_stream(draft) as f:
            f.write(json.dumps({"batch": number, "buckets": held | {b: folder for b in touched}}).encode())
        where.move(draft, f"{root}/state/{number:020d}.json")
        _drop_old(path, keep)

    return write


def _drop_old(path: str, keep: int) -> None:
    """Delete states but the newest, and folders that none of the rest names."""
    where, root = files.filesystem(path)
    states = sorted(f.path for f in where.get_file_info(fs.FileSelector(f"{root}/state")) if f.path.endswith(".json"))
    named: set[str] = set()
    for state in states[-keep:]:
        with where.open_input_stream(state) as f:
            named |= set(json.loads(f.read())["buckets"].values())
    for state in states[:-keep]:
        where.delete_file(state)
    for folder in where.get_file_info(fs.FileSelector(f"{root}/data", allow_not_found=True)):
        if f"data/{folder.base_name}" not in named:
            where.delete_dir(folder.path)


def merged_weights(spark: SparkSession, path: str) -> DataFrame:
    """(src, dst, weight) of the store that merge_weights() keeps, as of the last batch; an empty store raises ValueError."""
    held = _latest(path)[1]
    if not held:
        raise ValueError(f"no batch was merged into {path}")
    return spark.read.parquet(*[f"{path}/{folder}/bucket={b}" for b, folder in held.items()]).select("src", "dst", "weight")
