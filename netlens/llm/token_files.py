"""Operator 1: token ids in binary shards with one shared zstandard dictionary.

A shard file is::

    frame*  index  footer
    index   one record per document: doc_id int64, has_id uint8, width uint8,
            n_tokens uint32, offset uint64, length uint32
    footer  index offset uint64, documents uint64, dictionary SHA-256 (32 bytes), magic

Every document is one zstandard frame over its id array (little-endian, 2 bytes an
id where all fit, else 4), so one short document is read with two small range reads
and one decompression.  A shard holds ascending doc_ids; the manifest table gives
shards in order with the number of tokens before each.  Files carry a
random suffix and count only once Spark has committed the manifest row that names them,
so retried or speculative tasks never mix.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bpe import encoder, with_end
from .common import column, filesystem, make_folder, new_place, text_column

MAGIC = b"NLTOKENS"
ENTRY = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("width", "u1"), ("n_tokens", "<u4"), ("offset", "<u8"), ("length", "<u4")])
FOOTER = "<QQ32s8s"


def serialise(ids: np.ndarray) -> tuple[bytes, int]:
    """(bytes, bytes per id) of an id array."""
    width = 2 if not len(ids) or int(ids.max()) < 65536 else 4
    return ids.astype(f"<u{width}").tobytes(), width


def train_dictionary(samples: list[bytes], size: int):
    """A zstandard dictionary from serialised id arrays; raw content where there are too few to train on."""
    import zstandard

    samples = [x for x in samples if len(x) >= 8]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def _dictionary(data: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(data) if data else None


def write_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int = 0,
    place: str | None = None,
    dictionary_bytes: int = 65_536,
    dictionary_documents: int = 1_000,
    dictionary_stretch: int = 4_096,
    level: int = 3,
) -> tuple[str, DataFrame]:
    """Encode ``docs(doc_id, text)`` and write shards; returns (folder, manifest).

    Ids are those of the tokenizers library for the whole text (null: empty; an added token's string gets its id), then
    ``end_id``.  Shards and rows ascend by doc_id, null ids first; repeated doc_ids are
    all kept, in any order among themselves.  Other columns are ignored.  The
    dictionary is trained on at most ``dictionary_documents`` documents, those with the smallest hash of their id, from each
    a stretch of at most ``dictionary_stretch`` ids at a place given by its hash; it
    only affects size.  An empty table gives an empty manifest.
    Manifest: shard, path, documents, tokens, start, dictionary.
    """
    spark = docs.sparkSession
    place = place or new_place(spark, "tokens")
    make_folder(place)
    docs = docs.select("doc_id", "text")
    hashed = F.xxhash64("doc_id")
    lowest = docs.select(hashed.alias("h")).orderBy("h").limit(dictionary_documents).agg(F.max("h")).first()[0]
    samples: list[bytes] = []
    if lowest is not None:

        def stretch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                where = column(batch, "h").to_numpy(zero_copy_only=False).view(np.uint64)
                for at, ids, bounds in encoder(tokenizer_path).encode(text_column(batch, "text")):
                    n = np.diff(bounds)
                    low = bounds[:-1] + (where[at : at + len(n)] % np.maximum(n - dictionary_stretch + 1, 1).astype(np.uint64)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([serialise(ids[a : min(a + dictionary_stretch, b)])[0] for a, b in zip(low, bounds[1:])], pa.binary())], names=["ids"])

        some = docs.where(hashed <= lowest).select(hashed.alias("h"), "text").limit(dictionary_documents)
        samples = [r.ids for r in some.mapInArrow(stretch, "ids binary").collect()]  # bounded by documents and stretch
    dictionary = train_dictionary(samples, dictionary_bytes)
    digest = hashlib.sha256(dictionary).digest()
    where, path = filesystem(place)
    with where.open_output_stream(f"{path}/dictionary-{digest.hex()}") as out:
        out.write(dictionary)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        shared = _dictionary(dictionary)
        if shared:
            shared.precompute_compress(level=level)
        compress = zstandard.ZstdCompressor(level=level, dict_data=shared).compress
        where, path = filesystem(place)
        shard, out, index, at, tokens = TaskContext.get().partitionId(), None, [], 0, 0
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}"
        for batch in batches:
            if out is None and batch.num_rows:
                out = where.open_output_stream(f"{path}/{name}")
            doc_ids = column(batch, "doc_id").to_pylist()
            for first, ids, bounds in encoder(tokenizer_path).encode(text_column(batch, "text")):
                ids, bounds = with_end(ids, bounds, end_id)
                for i in range(len(bounds) - 1):
                    raw, width = serialise(ids[bounds[i] : bounds[i + 1]])
                    frame = compress(raw)
                    out.write(frame)
                    doc_id = doc_ids[first + i]
                    index.append((doc_id or 0, doc_id is not None, width, bounds[i + 1] - bounds[i], at, len(frame)))
                    at, tokens = at + len(frame), tokens + int(bounds[i + 1] - bounds[i])
        if out is not None:
            out.write(np.array(index, ENTRY).tobytes())
            out.write(struct.pack(FOOTER, at, len(index), digest, MAGIC))
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [f"{place}/{name}"], "documents": [len(index)], "tokens": [tokens], "dictionary": [digest.hex()]})

    schema = "shard long, path string, documents long, tokens long, dictionary string"
    ordered = docs.repartitionByRange(docs.doc_id).sortWithinPartitions("doc_id")
    committed = f"{place}/manifest"
    ordered.mapInArrow(write, schema).write.parquet(committed)
    return place, _with_start(spark.read.schema(schema).parquet(committed))


def _with_start(manifest: DataFrame) -> DataFrame:
    """Adds the tokens before each shard: sums within groups of 1024 shards, then over the groups' totals."""
    group = F.floor(F.col("shard") / 1024)
    m = manifest.withColumn("g", group)
    totals = m.groupBy("g").agg(F.sum("tokens").alias("t"))
    before = totals.select("g", F.coalesce(F.sum("t").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("tokens").over(Window.partitionBy("g").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return m.withColumn("inside", inside).join(before, "g").select("shard", "path", "documents", "tokens", (F.col("base") + F.col("inside")).alias("start"), "dictionary")


def open_shard(uri: str):
    """(file, index array, dictionary hash) of a shard."""
    where, path = filesystem(uri)
    source = where.open_input_file(path)
    size = source.size()
    at, n, digest, magic = struct.unpack(FOOTER, source.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER)))
    if magic != MAGIC:
        raise ValueError(f"{uri} is not a token shard")
    return source, np.frombuffer(source.read_at(n * ENTRY.itemsize, at), ENTRY), digest


def load_dictionary(place: str, digest: bytes) -> bytes:
    """The shared dictionary, its hash verified."""
    where, path = filesystem(place)
    with where.open_input_stream(f"{path}/dictionary-{digest.hex()}") as source:
        data = source.read()
    if hashlib.sha256(data).digest() != digest:
        raise ValueError("the dictionary does not have the hash in the shard")
    return data


def read_document(uri: str, row: int) -> np.ndarray:
    """The ids of one document of a shard, by range reads alone."""
    import zstandard

    source, index, digest = open_shard(uri)
    x = index[row]
    data = load_dictionary(uri.rpartition("/")[0], digest)
    raw = zstandard.ZstdDecompressor(dict_data=_dictionary(data)).decompress(source.read_at(int(x["length"]), int(x["offset"])))
    return np.frombuffer(raw, f"<u{x['width']}").astype("<u4")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """All documents of the shards: doc_id, start, n_tokens, ids (binary, little-endian unsigned 32-bit)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for path, start in zip(column(batch, "path").to_pylist(), column(batch, "start").to_pylist()):
                source, index, digest = open_shard(path)
                unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(load_dictionary(path.rpartition("/")[0], digest))).decompress
                starts = start + np.cumsum(index["n_tokens"], dtype=np.int64) - index["n_tokens"]
                ends = np.cumsum(index["n_tokens"], dtype=np.int64)
                i = 0
                while i < len(index):  # about 8 MB of ids at once
                    j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + (2 << 20), "right")))
                    some = index[i:j]
                    low = int(some["offset"][0])
                    data = source.read_at(int(some["offset"][-1] + some["length"][-1]) - low, low)
                    ids = [np.frombuffer(unpack(data[int(o) - low : int(o) - low + int(n)]), f"<u{w}").astype("<u4").tobytes() for o, n, w in zip(some["offset"], some["length"], some["width"])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some["doc_id"].astype(np.int64), mask=some["has_id"] == 0), pa.array(starts[i:j]), pa.array(some["n_tokens"].astype(np.int64)), pa.array(ids, pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )
                    i = j
                source.close()

    # a stated number of partitions, as the few manifest rows would otherwise be coalesced into one task
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "start").repartition(parts, "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: all documents with end id 0: doc_id, start, n_tokens, ids_crc32 from the files."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    _, manifest = write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
