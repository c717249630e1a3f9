"""Operator 7: homomorphic multiset fingerprints of documents.

A document is the multiset of its paragraphs (lines).  A paragraph hashes to a wide vector: four 64-bit lanes
of its exact bytes, and LANES 16-bit lanes that hold a signed count of its words' 3-grams.  The fingerprint is the sum of
its paragraphs' vectors, modulo 2**64 and 2**16, so the order of paragraphs does not matter and
a paragraph is added to or taken from a fingerprint by adding or subtracting its vector.  Equal multisets have equal
fingerprints; the narrow lanes of a difference estimate how much of the text differs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import column, new_place, text_column
from .hashing import EXACT, mix, owners, shingles, span_hashes, text_bytes, word_hashes

LANES, STRONG = 128, 4
WIDTH = LANES * 2 + STRONG * 8


def vectors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(strong lanes: texts x 4 uint64, narrow lanes: texts x LANES uint16) of UTF-8 texts."""
    n = len(texts)
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([offsets[1:], breaks]), kind="stable")
    text_of = np.searchsorted(breaks, offsets) + np.arange(n + 1)  # paragraphs before each text
    own = owners(text_of)
    code = span_hashes(data, starts, ends, EXACT)
    strong = np.stack([_sums(mix(code + np.uint64(i + 1)), text_of) for i in range(STRONG)], 1)
    words, bounds = word_hashes(data, np.append(starts, len(data)))  # words never hold a line break
    grams, to = shingles(words, bounds, 3)
    place = own[owners(to)] * LANES + (grams % np.uint64(LANES)).astype(np.int64)
    signs = np.where(grams >> np.uint64(63), 1.0, -1.0)
    narrow = np.bincount(place, signs, n * LANES).astype(np.int64).astype(np.uint16).reshape(n, LANES)
    return strong, narrow


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def combine(a: bytes, b: bytes, sign: int = 1) -> bytes:
    """The fingerprint of a text with paragraphs inserted (sign 1) or deleted (-1), from theirs."""
    k = STRONG * 8
    wide = np.frombuffer(a[:k], "<u8") + np.frombuffer(b[:k], "<u8") * np.uint64(sign % 2**64)
    slim = np.frombuffer(a[k:], "<u2") + np.frombuffer(b[k:], "<u2") * np.uint16(sign % 2**16)
    return wide.tobytes() + slim.tobytes()


def likeness(sa: np.ndarray, na: np.ndarray, sb: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """0 to 1: 1 - |a - b|^2 / (|a|^2 + |b|^2) of the narrow lanes' signed counts; 1 exactly where fingerprints are equal."""
    a, b = na.astype(np.int16).astype(np.float64), nb.astype(np.int16).astype(np.float64)
    d = (na - nb).astype(np.int16).astype(np.float64)
    whole = (a * a).sum(1) + (b * b).sum(1)
    like = np.clip(1 - (d * d).sum(1) / np.where(whole > 0, whole, 1), 0, 1) * (whole > 0)
    same = (sa == sb).all(1) & (na == nb).all(1)
    return np.where(same, 1.0, np.minimum(like, 1 - 1e-9))


def fingerprint_bytes(strong: np.ndarray, narrow: np.ndarray) -> list[bytes]:
    return [s.tobytes() + x.tobytes() for s, x in zip(strong, narrow)]


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint (binary, WIDTH bytes) of ``docs(doc_id, text)``; null text counts as empty; all rows are kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, texts in _slices(text_column(batch, "text").to_pylist()):
                prints = fingerprint_bytes(*vectors([x.encode() for x in texts]))
                yield pa.RecordBatch.from_arrays([column(batch, "doc_id").slice(own, len(texts)), pa.array([len(x) for x in texts], pa.int64()), pa.array(prints, pa.binary())], names=["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint binary")


def _slices(texts: list[str], limit: int = 4 << 20):
    """(first, texts) of about ``limit`` characters."""
    i, held = 0, 0
    for j, x in enumerate(texts):
        held += len(x)
        if held >= limit:
            yield i, texts[i : j + 1]
            i, held = j + 1, 0
    if i < len(texts):
        yield i, texts[i:]


RESULT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
KINDS = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _compared(texts: list[str], pairs: list[tuple[int, int]], ids: list) -> list[pa.Array]:
    """The columns of RESULT for texts and their successors, pairs of places in ``texts``."""
    edits = [(texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[j][: len(texts[i]) // 2]).encode() for i, j in pairs]
    strong, narrow = vectors([x.encode() for x in texts] + edits)
    a, b = np.array([i for i, _ in pairs], np.int64), np.array([j for _, j in pairs], np.int64)
    e = np.arange(len(texts), len(texts) + len(edits))
    prints = fingerprint_bytes(strong, narrow)
    return [
        pa.array([ids[i] for i in a], pa.int64()),
        pa.array([len(texts[i]) for i in a], pa.int64()),
        pa.array([hashlib.sha256(x).digest() for x in edits], pa.binary()),
        pa.array([prints[i] for i in a], pa.binary()),
        pa.array([prints[i] for i in e], pa.binary()),
        pa.array(likeness(strong[a], narrow[a], strong[e], narrow[e]), pa.float64()),
        pa.array(likeness(strong[a], narrow[a], strong[b], narrow[b]), pa.float64()),
    ]


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edit against the next document, by descending doc_id.

    The edit replaces the last floor(n_chars / 2) code points by the first as many (or all) of the next document's text; after the last document
    comes the first.  Null text counts as empty, null ids come last, rows with equal ids follow one
    another in the order of their texts' hashes.  A lone document is its own successor.

    A range sort deals the documents out, and each partition compares its rows in order.  Its last row's successor is the next partition's first: every
    partition keeps those two rows, and they meet by a join on the partitions' numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        ids, texts, first, size = [], [], None, 0
        edge = [pa.int64(), pa.string(), pa.string()]
        names = [*RESULT, "part", "first_text", "last_text"]

        def emit() -> pa.RecordBatch:
            n = len(texts) - 1
            return pa.RecordBatch.from_arrays([*_compared(texts, [(i, i + 1) for i in range(n)], ids), *[pa.nulls(n, kind) for kind in edge]], names=names)

        for batch in batches:
            for doc_id, text in zip(column(batch, "doc_id").to_pylist(), column(batch, "text").to_pylist()):
                first = text if first is None else first
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if size > 2 << 20 and len(texts) > 1:
                    yield emit()
                    ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
        if len(texts) > 1:
            yield emit()
        if texts:
            nothing = [pa.nulls(1, f) for f in (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(ids[-1:], pa.int64()), *nothing, pa.array([part]), pa.array([first], pa.string()), pa.array(texts[-1:], pa.string())], names=names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, after in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "last_text", "after"))):
                yield pa.RecordBatch.from_arrays(_compared([text, after], [(0, 1)], [doc_id]), names=RESULT)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = [F.desc_nulls_last("doc_id"), F.xxhash64("text")]
    ordered = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    found = ordered.mapInArrow(run, KINDS + ", part long, first_text string, last_text string")
    place = new_place(docs.sparkSession, "prints")
    found.write.option("compression", "zstd").parquet(place)
    found = docs.sparkSession.read.schema(found.schema).parquet(place)
    edges = found.where("part IS NOT NULL")
    parts = edges.select("part")  # a number per partition
    after = F.coalesce(F.lead("part").over(Window.orderBy("part")), F.min("part").over(Window.partitionBy(F.lit(0))))
    ends = edges.select("part", "doc_id", "last_text").join(parts.select("part", after.alias("next")), "part")
    ends = ends.join(edges.select(F.col("part").alias("next"), F.col("first_text").alias("after")), "next").select("doc_id", "last_text", "after")
    out = found.where("part IS NULL").select(*RESULT).union(ends.mapInArrow(meet, KINDS))
    text = lambda name: F.lower(F.hex(name)).alias(name)
    return out.select("doc_id", "n_chars", text("edited_sha256"), text("fingerprint"), text("edited_fingerprint"), "near_edited", "near_next")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents."""
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
