"""Operator 13: collocations of words by prefix-free parsing.

1. Texts are parsed into chunks.  Two neighbouring words whose hash is 0 modulo PERIOD end a chunk, and the next one starts with
   the same two words, so that cuts depend on the words alone and copies fall into the same chunks.  Chunks and how often
   each occurs are the dictionary of the corpus; what follows never looks at a text again.
2. n-grams are counted inside the distinct chunks, times the chunk's number.  A chunk owns the n-grams that start in it, but
   for those that start in the overlap with the next chunk, so each occurrence counts once.
3. Only phrases with ``least`` occurrences matter, and so do only their parts.  Hashes of n-grams are counted first, in two steps: all of one and two words, then those
   of three words whose both pairs are frequent.  Their bitmaps let through every frequent n-gram, and the strings of
   only those are counted, exactly.

A piece's end is the word ``\\n`` of a chunk's text; no n-gram crosses it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.loop import join_spread
from .common import column, new_place, slices, staged, text_column
from .hashing import EXACT, mix, parts, release, span_hashes, text_bytes
from .words import runs

#: Words in a chunk on average, and at most before it is cut anyway.
PERIOD, LONGEST = 16, 256
#: Bits of the bitmaps for each frequent n-gram, and at most (32 MB); a fuller one lets more rare n-grams through, which are then counted in vain.
BITS_EACH, MOST_BITS = 16, 1 << 28
#: Hashes of n-grams are counted by so many bits; those that meet let each other through.
KEY_BITS = 44
#: Tasks over which a language's phrases are ranked before the last step.
LANES = 64
ENDS = np.zeros(256, bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BLANK = ENDS.copy()
BLANK[[0x20, 0x09]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends of the words, bounds per text, whether each word is followed by another of its piece)."""
    inside = ~BLANK[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    begin, end = offsets[:-1][full], offsets[1:][full] - 1
    first[begin], last[end] = inside[begin], inside[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.searchsorted(starts, offsets)
    breaks = np.append(0, np.cumsum(ENDS[data], dtype=np.int32))
    more = np.zeros(len(starts), bool)
    more[:-1] = breaks[starts[1:]] == breaks[ends[:-1]]
    more[bounds[1:][bounds[1:] > 0] - 1] = False
    return starts, ends, bounds, more


def chunk_starts(words: np.ndarray, bounds: np.ndarray, period: int = PERIOD, longest: int = LONGEST) -> np.ndarray:
    """The words at which chunks start, from word hashes; a text's last chunk has at least three words, or all of the text."""
    n = len(words)
    cut = np.zeros(n, bool)
    if n > 1:
        cut[:-1] = mix(words[:-1] * np.uint64(3) + words[1:]) % np.uint64(period) == 0
    for back in (1, 2):
        cut[np.maximum(bounds[1:] - back, 0)[bounds[1:] > bounds[:-1]]] = False
    cut[bounds[:-1][bounds[1:] > bounds[:-1]]] = True
    starts = np.flatnonzero(cut)
    stop = bounds[np.searchsorted(bounds, starts, "right")]
    after = np.minimum(np.append(starts[1:], n), np.maximum(stop - 2, starts + 1))  # where another start would be possible
    extra = np.maximum(after - starts - 1, 0) // longest
    return np.repeat(starts, extra + 1) + runs(np.zeros(len(extra), np.int64), extra + 1) * longest


def chunks_of(texts: pa.Array, period: int = PERIOD, longest: int = LONGEST) -> tuple[pa.Array, np.ndarray]:
    """(chunks, the text of each).  A chunk starts with a sign, ``+`` if it is its text's last and owns all its words and ``-`` otherwise, then its words with a space or, where a piece ends, a line break between."""
    data, offsets = text_bytes(texts)
    data = FOLD[data]
    starts, ends, bounds, more = split(data, offsets)
    if not len(starts):
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    length = ends - starts
    to = np.cumsum(length + 1)
    plain = np.empty(to[-1], np.uint8)
    plain[runs(to - length - 1, length)] = data[runs(starts, length)]
    plain[to - 1] = np.where(more, 0x20, 0x0A)
    first = chunk_starts(span_hashes(data, starts, ends, EXACT), bounds, period, longest)
    own = np.searchsorted(bounds, first, "right") - 1
    stop = bounds[own + 1]
    last = np.append(own[1:] != own[:-1], True)
    end = np.where(last, stop, np.minimum(np.append(first[1:], 0) + 2, stop))
    low, high = to[first] - length[first] - 1, to[end - 1] - 1
    size = high - low + 1
    at = np.append(0, np.cumsum(size))
    out = np.empty(at[-1], np.uint8)
    out[at[:-1]] = np.where(last, ord("+"), ord("-"))
    out[runs(at[:-1] + 1, size - 1)] = plain[runs(low, size - 1)]
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at), pa.py_buffer(out)]), own


def dictionary(docs: DataFrame, period: int = PERIOD, longest: int = LONGEST) -> DataFrame:
    """(lang, chunk, n) of ``docs(lang, text)``: the distinct chunks of each language (null: ``und``) and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = column(batch, "lang").dictionary_encode()
            names, of = langs.dictionary, langs.indices.to_numpy(zero_copy_only=False)
            for at, texts in parts(text_column(batch, "text"), 4 << 20):
                found, own = chunks_of(texts, period, longest)
                coded = found.dictionary_encode()
                key = of[at + own].astype(np.int64) * max(len(coded.dictionary), 1) + coded.indices.to_numpy(zero_copy_only=False)
                key, n = np.unique(key, return_counts=True)
                lang, which = np.divmod(key, max(len(coded.dictionary), 1))
                yield pa.RecordBatch.from_arrays([names.take(pa.array(lang)), coded.dictionary.take(pa.array(which)).cast(pa.binary()), pa.array(n)], names=["lang", "chunk", "n"])

    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    return docs.mapInArrow(run, "lang string, chunk binary, n long").groupBy("lang", "chunk").agg(F.sum("n").alias("n"))


class Inside:
    """The words of a batch of chunks: places in the bytes, hashes (of word and language), the n-grams that start at each, the number of each word's chunk."""

    def __init__(self, batch: pa.RecordBatch):
        cells = column(batch, "chunk")
        self.data, offsets = text_bytes(cells)
        self.starts, self.ends, bounds, more = split(self.data, offsets)
        sign = self.data[offsets[:-1]] == ord("+")
        self.starts[bounds[:-1]] += 1  # the sign is no part of the first word
        self.row = np.repeat(np.arange(len(cells)), np.diff(bounds))
        owns = np.ones(len(self.starts), bool)
        for back in (1, 2):
            owns[(bounds[1:] - back)[~sign & (np.diff(bounds) >= back)]] = False
        self.count = column(batch, "n").to_numpy(zero_copy_only=False)[self.row]
        self.owned = owns
        langs = column(batch, "lang").dictionary_encode()
        self.langs, self.lang = langs.dictionary, langs.indices.to_numpy(zero_copy_only=False)[self.row]
        seeds = span_hashes(*_flat(self.langs), EXACT) if len(self.langs) else np.zeros(0, np.uint64)
        self.words = mix(span_hashes(self.data, self.starts, self.ends, EXACT) + seeds[self.lang])
        n = len(self.starts)
        two = more.copy()
        three = np.zeros(n, bool)
        three[:-1] = more[:-1] & more[1:]
        self.at = {1: np.flatnonzero(owns), 2: np.flatnonzero(owns & two), 3: np.flatnonzero(owns & three)}

    def keys(self, k: int, at: np.ndarray) -> np.ndarray:
        """Hashes (KEY_BITS) of the k-grams that start at the words ``at``."""
        x = self.words[at]
        for j in range(1, k):
            x = mix(x * np.uint64(0x9E3779B97F4A7C15) + self.words[at + j])
        return (mix(x + np.uint64(k)) >> np.uint64(64 - KEY_BITS)).astype(np.int64)

    def strings(self, k: int, at: np.ndarray) -> pa.Array:
        low, size = self.starts[at], self.ends[at + k - 1] - self.starts[at]
        to = np.append(0, np.cumsum(size))
        return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(to), pa.py_buffer(self.data[runs(low, size)])])


def _flat(cells: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = text_bytes(cells)
    return data, offsets[:-1], offsets[1:]


def marked(keys: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Whether the bitmap (a power of two of bits) holds the keys."""
    at = (mix(keys.astype(np.uint64)) & np.uint64(len(bitmap) * 8 - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bitmap_of(keys: DataFrame) -> np.ndarray:
    """A bitmap of ``keys(key)`` with BITS_EACH bits a key, MOST_BITS at most."""
    bits = 1 << max(18, min(MOST_BITS.bit_length() - 1, (keys.count() * BITS_EACH).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (mix(batch.column(0).to_numpy(zero_copy_only=False).astype(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at)], names=["p"])

    out = np.zeros(bits // 8, np.uint8)
    part = keys.select("key").mapInArrow(run, "p long").groupBy(F.floor(F.col("p") / 32768).alias("k")).agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("bits"))
    for k, cell in part.collect():  # at most MOST_BITS / 32768 rows of 4 KB
        out[k * 4096 : (k + 1) * 4096] = np.frombuffer(cell, np.uint8)
    return out


def frequent_keys(chunks: DataFrame, sizes: tuple[int, ...], least: int, pairs: np.ndarray | None = None) -> DataFrame:
    """(key) of the n-grams of ``sizes`` words with at least ``least`` occurrences, and of some others by chance; of three words, only where the bitmap ``pairs`` holds both pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "chunk"):
                own, keys, counts = Inside(some), [], []
                for k in sizes:
                    at = _frequent(own, k, pairs)
                    keys.append(own.keys(k, at))
                    counts.append(own.count[at])
                keys, which = np.unique(np.concatenate(keys), return_inverse=True)
                n = np.bincount(which, np.concatenate(counts), len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])
            release()

    return chunks.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key")


def _frequent(own: Inside, k: int, pairs: np.ndarray | None) -> np.ndarray:
    """Where k-grams start; of three words only those whose pairs the bitmap holds."""
    at = own.at[k]
    if k == 3 and pairs is not None:
        good = marked(own.keys(2, at), pairs)
        at = at[good]
        at = at[marked(own.keys(2, at + 1), pairs)]
    return at


def counted(chunks: DataFrame, pairs: np.ndarray, triples: np.ndarray, least: int) -> DataFrame:
    """(lang, k, phrase, n): exact counts of all phrases of one to three words with at least ``least`` occurrences, and k = 0 with the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch, "chunk"):
                own = Inside(some)
                total = np.bincount(own.lang[own.owned], own.count[own.owned], len(own.langs)).astype(np.int64)
                n_langs = len(total)
                yield pa.RecordBatch.from_arrays([own.langs, pa.array(np.zeros(n_langs, np.int32)), pa.array([""] * n_langs, pa.string()), pa.array(total)], names=["lang", "k", "phrase", "n"])
                for k in (1, 2, 3):
                    at = _frequent(own, k, pairs)
                    at = at[marked(own.keys(k, at), triples if k == 3 else pairs)]
                    coded = own.strings(k, at).dictionary_encode()
                    size = max(len(coded.dictionary), 1)
                    key, which = np.unique(own.lang[at].astype(np.int64) * size + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)
                    n = np.bincount(which, own.count[at], len(key)).astype(np.int64)
                    lang, word = np.divmod(key, size)
                    yield pa.RecordBatch.from_arrays([own.langs.take(pa.array(lang)), pa.array(np.full(len(key), k, np.int32)), coded.dictionary.take(pa.array(word)).cast(pa.string()), pa.array(n)], names=["lang", "k", "phrase", "n"])
            release()

    sums = chunks.mapInArrow(run, "lang string, k int, phrase string, n long").groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))
    return sums.where((F.col("k") == 0) | (F.col("n") >= least))


def collocations(docs: DataFrame, least: int = 10, cover: int = 50, most: int = 2000, period: int = PERIOD, longest: int = LONGEST) -> DataFrame:
    """The ``most`` strongest phrases of two or three words of each language of ``docs(lang, text)``: lang, rank, phrase, a, l, r, n, score.

    A-Z are lower-cased; pieces end at ``. , ; : ! ?`` and line breaks (0x0A-0x0D), words at spaces and tabs.  A phrase occurs ``a`` times, at least ``least``;
    its score is the smallest floor(1000000 * a * a / (l * r)) over its cuts in two parts with l and r occurrences, of equal ones that behind fewer words.  Phrases that lie in a
    longer candidate with at least ``cover`` per cent of their occurrences go.  n counts all words of the language.
    Order: score, then a, both falling, then phrase in UTF-8 order.  A null language is ``und``; null and empty texts have no words; a language without
    candidates has no rows; ``period`` and ``longest`` of the chunks change no result; repeated rows count each time; other columns are ignored; an empty table gives no rows.
    """
    place = new_place(docs.sparkSession, "chunks")
    found = dictionary(docs, period, longest)
    found.write.option("compression", "zstd").parquet(place)
    chunks = docs.sparkSession.read.schema(found.schema).parquet(place)
    pairs = bitmap_of(staged(frequent_keys(chunks, (1, 2), least), "pairs"))
    triples = bitmap_of(staged(frequent_keys(chunks, (3,), least, pairs), "triples"))
    counts = staged(counted(chunks, pairs, triples, least), "phrases")

    parts_of = lambda cut, left, right: F.struct(F.lit(cut).alias("cut"), F.substring_index("phrase", " ", left).alias("left"), F.substring_index("phrase", " ", -right).alias("right"))
    cuts = F.when(F.col("k") == 2, F.array(parts_of(1, 1, 1))).otherwise(F.array(parts_of(1, 1, 2), parts_of(2, 2, 1)))
    candidates = counts.where("k >= 2")
    cut = candidates.select("lang", "k", "phrase", F.col("n").alias("a"), F.explode(cuts).alias("c"))
    part = lambda name: counts.where("k BETWEEN 1 AND 2").select(F.struct("lang", "phrase").alias("part"), F.col("n").alias(name))
    cut = cut.select(F.struct("lang", F.col("c.left").alias("phrase")).alias("part"), "k", "phrase", "a", F.col("c.cut").alias("cut"), F.col("c.right").alias("right"))
    cut = join_spread(cut, part("l"), "part")
    cut = cut.select(F.struct("part.lang", F.col("right").alias("phrase")).alias("part"), "k", "phrase", "a", "cut", "l")
    cut = join_spread(cut, part("r"), "part").withColumn("lang", F.col("part.lang"))
    exact = lambda name: F.col(name).cast("decimal(15,0)")  # noqa: E731  15 + 15 + 7 digits fit a decimal
    cut = cut.withColumn("over", F.lit(1_000_000).cast("decimal(7,0)") * (exact("a") * exact("a"))).withColumn("under", exact("l") * exact("r"))
    best = cut.groupBy("lang", "k", "phrase", "a").agg(F.min(F.struct(F.expr("over div under").alias("score"), "cut", "l", "r")).alias("b"))

    triple = candidates.where("k = 3")
    held = triple.select("lang", "n", F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("n").alias("longer"))
    rest = best.where("k = 3").select("lang", "phrase", "a", "b").union(
        best.where("k = 2").join(held, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < cover * F.col("a"), F.lit(True))).select("lang", "phrase", "a", "b")
    )
    order = [F.desc("score"), F.desc("a"), "phrase"]
    rows = rest.select("lang", "phrase", "a", "b.l", "b.r", F.col("b.score").cast("long").alias("score"), F.pmod(F.xxhash64("phrase"), F.lit(LANES)).alias("lane"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "lane").orderBy(*order))).where(F.col("rank") <= most)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    words = counts.where("k = 0").select("lang", F.col("n"))
    return rows.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: all documents."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
