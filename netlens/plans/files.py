"""Tables of checked size that tasks read for themselves, from the folder that the cluster shares."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame

from .loop import checkpoint_dir


def written(df: DataFrame, name: str, *by: str) -> str:
    """``df`` as Parquet in a fresh folder below the shared one, with a folder per value of columns ``by``; returns its URI."""
    place = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(place) if by else df.write.parquet(place)
    return place


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a URI or an absolute local path."""
    return (fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)


def read(place: str, columns: list[str] | None = None) -> pa.Table:
    """The table of a folder that written() made (or those columns of it), inside a task."""
    where, path = filesystem(place)
    return ds.dataset(path, filesystem=where, format="parquet").to_table(columns)


def there(place: str) -> bool:
    """Whether a folder exists; that of a value of written()'s ``by`` is missing where it has no rows."""
    where, path = filesystem(place)
    return where.get_file_info(path).type != fs.FileType.NotFound


def shape(place: str) -> tuple[list[str], int]:
    """(columns, rows) of a folder that written() made."""
    where, path = filesystem(place)
    table = ds.dataset(path, filesystem=where, format="parquet")
    return table.schema.names, table.count_rows()


def stream(place: str, rows: int, columns: list[str]) -> Iterator[pa.RecordBatch]:
    """The columns of a folder that written() made, at most so many rows at a time, none of them from two files."""
    where, path = filesystem(place)
    return ds.dataset(path, filesystem=where, format="parquet").to_batches(columns=columns, batch_size=rows, batch_readahead=1, fragment_readahead=1)
