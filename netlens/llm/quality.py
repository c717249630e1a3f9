"""Operator 6: quality by importance resampling over hashed n-grams.

Two generative models over hashed word unigrams and bigrams: one of the raw text (counts over
all documents), one of the target (a bounded labelled sample of clean documents).  A document's log importance weight is the log of
the ratio of its probabilities; adding Gumbel noise and taking the k largest keys samples k
documents without replacement in proportion to their weights.

A mean over the whole text hardly moves for a few toxic words, so a third model (documents labelled toxic
against clean ones, bounded samples) scores every text by its strongest n-gram; its cut is the one
with the fewest errors on held-out documents of both kinds.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, staged, text_column
from .hashing import LOWER, mix, owners, parts, span_hashes, text_bytes, word_hashes, word_spans

BUCKETS = 1 << 16
#: A weight is that of so many n-grams at the text's mean log ratio, so that long and short texts compare.
LENGTH = 256.0
#: N-grams of the toxic model, by whole hashes: in buckets, long clean texts would often hit that of a toxic word.
MODEL = 1 << 16
#: So many signs are taken off each side of a word.
AROUND = 4
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[ord(x) for x in string.punctuation]] = True
#: Scores are counted in steps of 1 / STEPS to set the cut.
STEPS = 64


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every word and of every pair of neighbours, text of each)."""
    words, bounds = word_hashes(*text_bytes(texts))
    code, own = grams(words, owners(bounds))
    return (code % np.uint64(BUCKETS)).astype(np.int64), own


def bare_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word and pair, text of each), without ASCII punctuation around the words, so that a word counts as the same before a comma."""
    data, offsets = text_bytes(texts)
    starts, ends, bounds = word_spans(data, offsets)
    for _ in range(AROUND if len(starts) else 0):
        starts = starts + ((starts < ends) & PUNCTUATION[data[np.minimum(starts, len(data) - 1)]])
        ends = ends - ((starts < ends) & PUNCTUATION[data[np.maximum(ends - 1, 0)]])
    some = starts < ends
    return grams(span_hashes(data, starts[some], ends[some], LOWER), owners(bounds)[some])


def grams(words: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(every word hash and a hash of every pair of neighbours in a text, text of each)."""
    near = own[:-1] == own[1:]
    pair = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])[near]
    return np.concatenate([words, pair]), np.concatenate([own, own[:-1][near]])


def fit(docs: DataFrame, clean: DataFrame, sample: int = 20_000) -> np.ndarray:
    """Log ratio target / raw per bucket.

    ``clean(doc_id)`` names clean documents; of them at most ``sample``, those with the smallest hash of their id, make
    the target model.  The raw model counts every document.
    """
    some = clean.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    marked = docs.select("doc_id", "text").join(F.broadcast(some.withColumn("hit", F.lit(1))), "doc_id", "left").select("text", F.coalesce("hit", F.lit(0)).alias("hit"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS), np.int64)
        for batch in batches:
            hit = column(batch, "hit").to_numpy(zero_copy_only=False).astype(bool)
            for at, texts in parts(text_column(batch, "text"), 1 << 20):
                code, own = features(texts)
                total[0] += np.bincount(code, minlength=BUCKETS)
                total[1] += np.bincount(code[hit[at : at + len(texts)][own]], minlength=BUCKETS)
        b = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(total[0, b]), pa.array(total[1, b])], names=["b", "raw", "target"])

    raw, target = np.full(BUCKETS, 0.5), np.full(BUCKETS, 0.0)
    counts = marked.mapInArrow(count, "b long, raw long, target long").groupBy("b").agg(F.sum("raw"), F.sum("target"))
    for b, r, t in counts.collect():  # at most BUCKETS rows
        raw[b] += r
        target[b] += t
    raw = raw / raw.sum()
    # the target is smoothed towards the raw model, worth a hundredth of its own mass
    mass = max(target.sum(), 1.0)
    target = (target + 0.01 * mass * raw) / (target.sum() + 0.01 * mass)
    return np.log(target / raw)


def fit_toxic(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, log ratio of each): the shares of toxic and of clean documents that hold an n-gram.

    At most ``sample`` labelled documents of each kind and of fold 0 count, and the MODEL n-grams that are in most of the toxic ones (in three at least).
    Both shares are raised by that of five toxic documents, so that what few hold says little. Without documents of both kinds the model is empty.
    """

    def marked(good: DataFrame) -> DataFrame:
        some = good.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text")

    def count(keys: np.ndarray | None):
        """Documents by n-gram, of ``keys`` if given; those of key null are all."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, texts in parts(text_column(batch, "text"), 1 << 20):
                    code, own = bare_features(texts)
                    if keys is not None:
                        at, hit = find(keys, code)
                        code, own = keys[at], own[hit]
                    order = np.lexsort((own, code))
                    code, own = code[order], own[order]
                    new = np.append(True, (code[1:] != code[:-1]) | (own[1:] != own[:-1]))[: len(code)]
                    b, n = np.unique(code[new].view(np.int64), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([*b.tolist(), None], pa.int64()), pa.array([*n.tolist(), len(texts)], pa.int64())], names=["b", "n"])

        return run

    found = staged(marked(toxic(labels, 0)).mapInArrow(count(None), "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).where("b IS NULL OR n >= 3"), "toxic-grams")
    top = found.where("b IS NOT NULL").orderBy(F.desc("n"), "b").limit(MODEL).toArrow()
    order = np.argsort(top["b"].to_numpy().view(np.uint64))
    keys, bad = top["b"].to_numpy().view(np.uint64)[order], top["n"].to_numpy()[order].astype(float)
    n_bad = (found.where("b IS NULL").first() or {"n": 0})["n"]
    rows = marked(clean(labels, 0)).mapInArrow(count(keys), "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()  # at most MODEL + 1 rows
    at = dict(zip(rows["b"].to_pylist(), rows["n"].to_pylist()))
    n_good = at.get(None, 0)
    if not n_bad or not n_good:
        return keys[:0], bad[:0]
    good = np.array([at.get(k, 0) for k in keys.view(np.int64).tolist()], float)
    return keys, np.log((bad / n_bad + 5 / n_bad) / (good / n_good + 5 / n_bad))


def find(keys: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the ascending ``keys``, place in ``code``) of every code that is one of them."""
    maybe = np.zeros(1 << 20, bool)
    maybe[keys & np.uint64((1 << 20) - 1)] = True
    hit = np.flatnonzero(maybe[code & np.uint64((1 << 20) - 1)])
    at = np.searchsorted(keys, code[hit])
    same = keys[np.minimum(at, len(keys) - 1)] == code[hit] if len(keys) else np.zeros(0, bool)
    return at[same], hit[same]


def weigh(table: DataFrame, ratio: np.ndarray, carry: list[str], names_out: tuple[str, ...] = ("log_weight", "gumbel_key", "toxic_score"), seed: int = 17, toxic_model: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``carry`` columns and more, named by ``names_out``: log_weight (mean log ratio of the n-grams times LENGTH, 0.0 for a text without words), gumbel_key
    and, with ``toxic_model``, toxic_score (the largest ratio in it of any n-gram of the whole text, 0.0 at least).

    The noise is a hash of (seed, doc_id), so equal ids get equal noise under any partitioning.
    """
    u = (F.xxhash64(F.lit(seed), "doc_id").bitwiseAND(F.lit(2**52 - 1)).cast("double") + 0.5) / float(2**52)
    names = names_out[:2] if toxic_model is None else names_out
    words = "c_text" if "text" in carry else "_text"  # a text that is carried anyway is sent once
    table = table.select(*[F.col(f"`{c}`").alias(f"c_{c}") for c in carry], *([] if "text" in carry else [F.col("text").alias("_text")]), (-F.log(-F.log(u))).alias("_noise"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, texts in parts(text_column(batch, words), 1 << 20):
                code, own = features(texts)
                weight = np.bincount(own, ratio[code], len(texts)) * LENGTH / np.maximum(np.bincount(own, minlength=len(texts)), 1)
                some = batch.slice(row, len(texts))
                key = weight + column(some, "_noise").to_numpy(zero_copy_only=False)
                made = [pa.array(weight), pa.array(key)]
                if toxic_model is not None:
                    score = np.zeros(len(texts))
                    code, own = bare_features(texts)
                    at, hit = find(toxic_model[0], code)
                    np.maximum.at(score, own[hit], toxic_model[1][at])
                    made.append(pa.array(score))
                yield pa.RecordBatch.from_arrays([*[column(some, f"c_{c}") for c in carry], *made], names=[*carry, *names])

    kinds = ", ".join(f"`{c}` {table.schema[f'c_{c}'].dataType.simpleString()}" for c in carry)
    return table.mapInArrow(run, ", ".join([kinds, *[f"`{x}` double" for x in names]]))


def kth_largest(table: DataFrame, key: str, k: int) -> float:
    """The k-th largest value of a finite double column, by narrowing histograms: 1024 counts per round come to the driver."""
    low, high, n = table.agg(F.min(key), F.max(key), F.count(key)).first()
    if not n or k <= 0:
        return float("inf")
    if k >= n:
        return low
    rest = k
    while low < high:
        width = (high - low) / 1024
        if width <= 0 or low + width == low:
            break
        bin_ = F.least(F.floor((F.col(key) - low) / width), F.lit(1023)).cast("int")
        part = table.where(F.col(key).between(low, high)).groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()
        for b in sorted(part, key=lambda r: -r.b):
            if b.n >= rest:
                low, high = b.lo, b.hi
                break
            rest -= b.n
        if len(part) == 1 and (low, high) == (part[0].lo, part[0].hi) and part[0].n == rest:
            return low
    return low


def clean(labels: DataFrame, fold: int) -> DataFrame:
    """doc_ids of the clean labelled documents in one of two folds: 0 fits the target model, 1 sets the cut."""
    good = labels.where("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select("doc_id")
    return good.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == fold)


def toxic(labels: DataFrame, fold: int) -> DataFrame:
    """doc_ids of the documents labelled toxic in one of two folds, as in clean()."""
    bad = labels.where("toxic = 1 AND doc_id IS NOT NULL").select("doc_id")
    return bad.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == fold)


def toxic_cut(weighed: DataFrame, labels: DataFrame) -> float:
    """The toxic_score from which documents go: of all cuts the one with the fewest held-out errors, toxic documents kept and clean ones lost.

    Of equal ones it is the highest; without held-out toxic documents, or if no cut is better than none, nothing goes.
    """
    held = clean(labels, 1).withColumn("bad", F.lit(0)).union(toxic(labels, 1).withColumn("bad", F.lit(1))).distinct()
    step = F.floor(F.col("toxic_score") * STEPS).alias("step")
    rows = weighed.select("doc_id", step).join(held, "doc_id").groupBy("step").agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).collect()  # a row per step of a bounded score
    best, gain, limit = 0, 0, float("inf")
    for r in sorted(rows, key=lambda r: -r.step):
        gain += r.bad - (r.n - r.bad)
        if gain > best:
            best, limit = gain, r.step / STEPS
    return limit


def cut_off(weighed: DataFrame, labels: DataFrame, lost: float = 0.005) -> float:
    """The key below which a share ``lost`` of the held-out clean documents falls; without any, all documents are kept."""
    good = weighed.select("doc_id", "gumbel_key").join(clean(labels, 1), "doc_id", "left_semi")
    n = good.count()
    return kth_largest(good, "gumbel_key", n - int(n * lost)) if n else float("-inf")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: doc_id, log_weight, gumbel_key, toxic_score and kept for every document.

    kept marks those of the Gumbel top-k that are below the toxic cut, k being the number of documents whose key is not below that of all but 0.5 % of
    the labelled clean documents that the model has not seen.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weighed = staged(weigh(docs, fit(docs, clean(labels, 0)), ["doc_id"], toxic_model=fit_toxic(docs, labels)), "weights")
    return weighed.withColumn("kept", (F.col("gumbel_key") >= F.lit(cut_off(weighed, labels))) & (F.col("toxic_score") < F.lit(toxic_cut(weighed, labels))))
