"""Operator 10: repeated passages by content-defined chunking with a gear rolling hash.

A 32-bit gear hash (each byte shifts out after 32 steps) is taken at every word start.  A word start
is a cut if its value is the smallest of some WINDOW consecutive word starts of the document, so cuts depend on
nearby bytes alone, survive insertions elsewhere and are at most WINDOW words apart.  From every chunk on and back, the
fewest chunks of together at least MIN_WORDS words are a sequence; sequences with equal digests are copies of the first one (smallest doc_id, then
place).  A maximal run of overlapping or adjacent copies is a repeated passage; all but its first occurrence can be removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans import files
from ..plans.loop import join_spread
from .common import column, fresh, staged, text_column
from .hashing import EXACT, INVERSE, mix, owners, parts, powers, release, span_hashes, text_bytes, word_spans

#: Cuts are minima of so many word starts; a passage of 51 words then holds whole chunks of
#: at least 51 - 2 * (WINDOW - 1) words less those within 32 bytes of its start.
WINDOW, MIN_WORDS = 10, 20
#: Leading bits of a digest by which a bitmap (32 MB) tells those that may repeat; a fuller one only lets more through.
FILTER = 28
#: Values of the bytes; 0 is neutral, so that texts can be set apart by zero bytes.
GEAR = (mix(np.arange(256, dtype=np.uint64) + np.uint64(31)) >> np.uint64(32)).astype(np.uint32)
GEAR[0] = 0


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash after each byte: sum of GEAR[b] << age over the last 32 bytes, modulo 2**32 (log-step doubling)."""
    h = GEAR[data]
    for step in (1, 2, 4, 8, 16):
        if len(h) > step:
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def cut(data: np.ndarray, offsets: np.ndarray, window: int = WINDOW):
    """(first word, word after the last, text) of every chunk, with the words' starts and ends."""
    starts, ends, bounds = word_spans(data, offsets)
    n = len(starts)
    own = owners(bounds)
    is_cut = np.zeros(n, bool)
    is_cut[bounds[:-1][bounds[1:] > bounds[:-1]]] = True
    if n >= window:
        # 32 neutral bytes before each text keep its neighbour out of the hash
        shift = 32 * np.arange(1, len(offsets))
        apart = np.zeros(len(data) + 32 * len(offsets), np.uint8)
        apart[np.arange(len(data)) + np.repeat(shift, np.diff(offsets))] = data
        value = gear(apart)[starts + shift[own] - 1]
        views = np.lib.stride_tricks.sliding_window_view(value, window)
        at = np.arange(n - window + 1)
        at = at[own[: n - window + 1] == own[window - 1 :]]
        for i in range(0, len(at), 1 << 18):
            some = at[i : i + (1 << 18)]
            is_cut[some + views[some].argmin(1)] = True
    first = np.flatnonzero(is_cut)
    after = np.append(first[1:], n)
    return first, after, own[first], starts, ends


def sequences(digest: np.ndarray, first: np.ndarray, after: np.ndarray, own: np.ndarray, min_words: int):
    """(first chunk, last chunk, two digests) of the shortest sequences of at least ``min_words`` words that begin or end with each chunk, where its text has room for them."""
    n = np.arange(len(first))
    begin = np.append(n, np.searchsorted(first, after - min_words, "right") - 1)
    last = np.append(np.searchsorted(after, first + min_words), n)
    room = np.flatnonzero((begin >= 0) & (last < len(n)))
    room = room[own[begin[room]] == own[last[room]]]
    begin, last = np.divmod(np.unique(begin[room] * len(n) + last[room]), max(len(n), 1))
    joint = []
    for seed in (0, 0x5851F42D4C957F2D):
        total = np.zeros(len(digest) + 1, np.uint64)
        np.cumsum(mix(digest ^ np.uint64(seed)) * powers(len(digest)), out=total[1:])
        joint.append(mix((total[last + 1] - total[begin]) * powers(len(digest) + 1, INVERSE)[begin] + (last + 1 - begin).astype(np.uint64)))
    return begin, last, *joint


def _repeated(docs: DataFrame, min_words: int) -> str:
    """Folder (k, bits) of a bitmap of the leading FILTER bits of the digests that occur more than once: only digests are shuffled."""
    digests = sequence_rows(docs, min_words).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    place = F.shiftrightunsigned("digest", 64 - FILTER)
    return files.written(digests.groupBy(F.shiftright(place, 15).alias("k")).agg(F.bitmap_construct_agg(place % 32768).alias("bits")), "repeated")


def _bitmap(place: str) -> np.ndarray:
    """The bytes of a bitmap that _repeated() wrote."""
    rows, out = files.read(place), np.zeros((1 << FILTER - 15, 4096), np.uint8)
    for k, bits in zip(rows["k"].to_pylist(), rows["bits"]):
        out[k] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out.reshape(-1)


def sequence_rows(docs: DataFrame, min_words: int, repeated: str | None = None) -> DataFrame:
    """digest and check (128 bits together), doc_id, start, stop (byte offsets: first byte, start of the next chunk or end of the last word), word (number of the first one), words: the sequences of ``docs(doc_id, text)``, or those of them that a bitmap by _repeated() holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _bitmap(repeated) if repeated else None
        for batch in batches:
            ids = column(batch, "doc_id").to_numpy(zero_copy_only=False)
            for at, texts in parts(text_column(batch, "text"), 1 << 20):
                data, offsets = text_bytes(texts)
                first, after, own, starts, ends = cut(data, offsets)
                if not len(first):
                    continue
                digest = span_hashes(data, starts[first], ends[after - 1], EXACT)
                begin = starts[first] - offsets[own]
                same = np.append(own[1:] == own[:-1], False)
                stop = np.where(same, np.append(begin[1:], 0), ends[after - 1] - offsets[own])
                a, b, joint, check = sequences(digest, first, after, own, min_words)
                if held is not None:
                    bit = joint >> np.uint64(64 - FILTER)
                    may = np.flatnonzero(held[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
                    a, b, joint, check = a[may], b[may], joint[may], check[may]
                word = first - np.searchsorted(starts, offsets)[own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(joint.view(np.int64)), pa.array(check.view(np.int64)), pa.array(ids[at : at + len(texts)][own[a]]), pa.array(begin[a]), pa.array(stop[b]), pa.array(word[a].astype(np.int32)), pa.array((after[b] - first[a]).astype(np.int32))],
                    names=["digest", "check", "doc_id", "start", "stop", "word", "words"],
                )

    docs = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(run, "digest long, check long, doc_id long, start long, stop long, word int, words int")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Repeated passages of ``docs(doc_id, text)``: doc_id, start, stop (byte offsets in UTF-8), n_words, first_doc_id.

    A span is a maximal run of overlapping or adjacent sequences of at least ``min_words`` words whose first occurrence is elsewhere; first_doc_id is the document where
    its first sequence occurs first (the same document for repeats within one).  A copy that overlaps its first occurrence begins where that
    ends, so that this stays whole; what is then left of fewer words is no span.  White space between words counts within a
    chunk.  Null, empty and short texts have no spans, null doc_ids are ignored; of rows with equal doc_id the
    spans are those of all their texts together and equal places count as one.  An empty table gives no rows.
    """
    # most sequences occur once: a bitmap of fixed size keeps them from the shuffles of whole rows
    rows = sequence_rows(docs, min_words, _repeated(docs, min_words))
    first = rows.groupBy("digest", "check").agg(F.min(F.struct("doc_id", "start", "stop", "word", "words")).alias("f"), F.count("*").alias("n")).where("n > 1")
    first = first.select("digest", F.col("check").alias("f_check"), "n", F.col("f.doc_id").alias("f_doc"), F.col("f.start").alias("f_start"), F.col("f.stop").alias("f_stop"), (F.col("f.word") + F.col("f.words")).alias("f_after"))
    first = staged(first, "repeated-sequences")
    # a digest that many documents share is dealt over several tasks
    counts = first.groupBy("digest").agg(F.sum("n").alias("n"))
    copies = join_spread(rows, first.drop("n"), "digest", counts=counts, least=100_000).where("check = f_check AND NOT (doc_id = f_doc AND start = f_start AND stop = f_stop)")
    inside = (F.col("doc_id") == F.col("f_doc")) & (F.col("start") < F.col("f_stop"))
    copies = copies.select("doc_id", F.when(inside, F.col("f_stop")).otherwise(F.col("start")).alias("start"), "stop", F.when(inside, F.col("f_after")).otherwise(F.col("word")).alias("word"), (F.col("word") + F.col("words")).alias("after"), "f_doc").where("start < stop")
    in_order = Window.partitionBy("doc_id").orderBy("start", "stop")
    runs = copies.repartition("doc_id").dropDuplicates(["doc_id", "start", "stop"])
    far = F.max("stop").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.withColumn("new", F.when(far >= F.col("start"), 0).otherwise(1))
    runs = runs.withColumn("run", F.sum("new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    spans = runs.groupBy("doc_id", "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), (F.max("after") - F.min("word")).cast("long").alias("n_words"), F.min(F.struct("start", "f_doc")).alias("f"))
    return spans.where(F.col("n_words") >= min_words).select("doc_id", "start", "stop", "n_words", F.col("f.f_doc").alias("first_doc_id"))


def remove_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the spans cut out of ``text`` (and n_chars, if there, set anew where there is a text); columns and rows stay as they are.

    Spans go by doc_id; rows that share a doc_id get each other's cuts, so ids should be unique here.
    """
    columns = docs.columns
    extra = fresh("_cuts", columns)
    cuts = spans.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias(extra))
    joined = docs.join(cuts, "doc_id", "left").select(*[F.col(f"`{c}`") for c in columns], extra)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = column(batch, "text").to_pylist()
            chars = column(batch, "n_chars").to_pylist() if "n_chars" in columns else None
            for i, cuts in enumerate(column(batch, extra).to_pylist()):
                if not cuts:
                    continue
                data, out, at = (texts[i] or "").encode(), [], 0
                for c in cuts:
                    out.append(data[at : c["start"]])
                    at = max(at, c["stop"])
                out.append(data[at:])
                texts[i] = b"".join(out).decode("utf-8", "ignore")
            made = {"text": pa.array(texts, pa.string())}
            if "n_chars" in columns:
                made["n_chars"] = pa.array([n if x is None else len(x) for x, n in zip(texts, chars)], pa.int64())
            yield pa.RecordBatch.from_arrays([made.get(c, column(batch, c)) for c in columns], names=columns)
            del texts, made
            release()

    return joined.mapInArrow(run, kinds)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the repeated passages of all documents, as spans."""
    return repeated_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
