"""Shared helpers of the training-data operators: places to write, files, components."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import stars
from ..plans.loop import checkpoint_dir

# ---------------------------------------------------------------- places


def new_place(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: lineage ends here."""
    place = new_place(df.sparkSession, name)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def filesystem(uri: str):
    """(pyarrow filesystem, path) of a URI, for use inside tasks."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def make_folder(uri: str) -> None:
    where, path = filesystem(uri)
    where.create_dir(path, recursive=True)


def drop_folder(uri: str) -> None:
    """Remove a folder that :func:`new_place` named."""
    where, path = filesystem(uri)
    if where.get_file_info(path).type != fs.FileType.NotFound:
        where.delete_dir(path)


# ---------------------------------------------------------------- Arrow columns


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """A string column of a batch with nulls as empty texts."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)), "")


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores behind it as long as a column of ``taken`` has that name (in any case)."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name += "_"
    return name


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def slices(batch: pa.RecordBatch, name: str, limit: int = 2 << 20):
    """The batch in pieces of about ``limit`` bytes of its binary column ``name``, which has no nulls."""
    bounds = np.append(0, np.cumsum(pc.binary_length(column(batch, name)).to_numpy(zero_copy_only=False).astype(np.int64)))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + limit, "right")) - 1)
        yield batch.slice(i, j - i)
        i = j


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges(src, dst)``: rows ``(id, component)``, each id with the smallest id that it reaches.

    Self-loops and repeated edges are harmless; null ends are ignored; an empty table gives an empty result.
    """
    found = stars(edges).select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found.union(found.select(F.col("component").alias("id"), "component").distinct())
