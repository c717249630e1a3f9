"""Operator 9: language identification by Bayesian fusion of evidence.

Evidence of a document: its text (hashed byte trigram model per language), the language its markup declares,
the suffix of its address, and its host.  Priors are smoothed in steps: all documents → address suffix →
host.  They and the reliability of declarations come from grouped aggregation of the text
posteriors over all documents; only the trigram models are fitted on a bounded labelled sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.loop import join_spread
from .common import column, staged, text_column
from .hashing import parts, text_bytes

BUCKETS = 1 << 16
UNDETERMINED = "und"
#: A text speaks with the weight of so many trigrams at most, so that neighbours' dependence does not count as proof.
EVIDENCE = 100.0
#: Documents' worth of belief in the level above, for suffixes and hosts.
SUFFIX_WEIGHT, HOST_WEIGHT = 20.0, 10.0
#: Hosts up to which the priors are broadcast; above, they are joined by shuffle, frequent hosts over several tasks.
BROADCAST_HOSTS = 100_000

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = _LETTER[128:] = True


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every byte trigram with a letter in its middle, text of each)."""
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    c = _FOLD[data]
    code = ((c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]) * np.uint32(2654435761)
    use = _LETTER[data[1:-1]]
    own = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    use &= own[:-2] == own[2:]
    at = np.flatnonzero(use)
    return (code[at] >> np.uint32(16)).astype(np.int64), own[at]


def tag_of(label: Column) -> Column:
    """The language that a label names: what stands before its first ``-``, ``_``, ``.``, ``;``, ``,`` or white space, in lower case (``pt-BR`` and ``PT`` are ``pt``).

    Null where that is empty or ``und``.  Labels may have any length and script.
    """
    tag = F.lower(F.regexp_extract(label, "^\\s*([^-_.;,\\s]+)", 1))
    return F.when(~tag.isin("", UNDETERMINED), tag)


def fit(docs: DataFrame, label: str, languages: list[str], sample: int = 20_000, least: int = 200) -> np.ndarray:
    """Log probabilities (languages x BUCKETS) from labelled documents, of each language those with the smallest hash of their id.

    A language gives at most ``sample / number of languages`` documents, or ``least`` where that is less, so that a rare one is learned from all it has.
    """
    known = docs.select(F.xxhash64("doc_id").alias("h"), "text", tag_of(F.col(label)).alias("l")).where(F.col("l").isNotNull())
    most = max(least, sample // max(len(languages), 1))
    first = known.select("l", "h").withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy("h"))).where(F.col("r") <= most)  # each task passes on so many of a language at most
    cuts = first.groupBy("l").agg(F.max("h").alias("cut"))
    counts = np.full((len(languages), BUCKETS), 0.5)
    place = {x: i for i, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int32)
        for batch in batches:
            which = np.array([place[x] for x in column(batch, "l").to_pylist()], np.int64)
            for at, texts in parts(text_column(batch, "text"), 1 << 20):
                code, own = trigrams(*text_bytes(texts))
                some, n = np.unique(which[at : at + len(texts)][own] * BUCKETS + code, return_counts=True)
                total.ravel()[some] += n.astype(np.int32)
        l, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(l), pa.array(b), pa.array(total[l, b].astype(np.int64))], names=["l", "b", "n"])

    rows = known.join(F.broadcast(cuts), "l").where(F.col("h") <= F.col("cut")).select("text", "l").mapInArrow(count, "l long, b long, n long")
    found = rows.groupBy("l", "b").agg(F.sum("n").alias("n")).toArrow()  # at most languages x BUCKETS rows
    np.add.at(counts, (found["l"].to_numpy(), found["b"].to_numpy()), found["n"].to_numpy())
    return np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def languages_of(docs: DataFrame, label: str, most: int = 512) -> list[str]:
    """All languages that the labels name (tag_of), in order; more than ``most`` (256 KB of model each) are an error, none is left out."""
    found = sorted(r.l for r in docs.select(tag_of(F.col(label)).alias("l")).where(F.col("l").isNotNull()).distinct().limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"{label} names more than {most} languages: raise `most` (256 KB a language in every task), or clean the labels")
    return found


def text_scores(texts: pa.Array, model: np.ndarray) -> np.ndarray:
    """Log likelihoods (texts x languages + 1), scaled down to EVIDENCE trigrams; the last is a uniform background.  NaN rows have no evidence."""
    code, own = trigrams(*text_bytes(texts))
    n = np.bincount(own, minlength=len(texts))
    out = np.empty((len(texts), len(model) + 1))
    for i, logs in enumerate(model):
        out[:, i] = np.bincount(own, logs[code], len(texts))
    out[:, -1] = -np.log(BUCKETS) * n
    out *= np.minimum(1, EVIDENCE / np.maximum(n, 1))[:, None]
    out[n == 0] = np.nan
    return out


def _posterior(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def identify(table: DataFrame, model: np.ndarray, languages: list[str], carry: list[str], text: str, host: Column, suffix: Column, declared: Column, names_out: tuple[str, str] = ("language", "confidence"), background: float = 1e-3) -> DataFrame:
    """Language of each row of ``table`` from its column ``text``, and host, address suffix and declared language.

    Returns the columns ``carry`` (any of the table's) and two more, named by ``names_out``: language (``und`` where the background explains the text best or there is no letter
    trigram at all) and confidence, the posterior probability of that language (0.0 without evidence).  Null host, suffix
    or declaration is a value of its own; declarations are read by tag_of(), and those of no known language are one value.  Every row is kept; an empty table gives no rows.
    """
    names, width = [f"p{i}" for i in range(len(languages) + 1)], len(languages) + 1
    known = F.coalesce(tag_of(declared), F.lit(""))
    words = f"c_{text}" if text in carry else "_text"  # a text that is carried anyway is sent once
    table = table.select(
        *[F.col(f"`{c}`").alias(f"c_{c}") for c in carry],
        *([] if text in carry else [F.col(f"`{text}`").alias("_text")]),
        F.coalesce(host, F.lit("")).alias("_host"),
        F.coalesce(suffix, F.lit("")).alias("_suffix"),
        F.when(known.isin("", *languages), known).otherwise(F.lit("?")).alias("_declared"),
    )
    start = np.log(np.append(np.full(len(languages), (1 - background) / max(len(languages), 1)), background))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in parts(text_column(batch, words), 1 << 20):
                scores = text_scores(texts, model)
                seen = ~np.isnan(scores[:, 0])
                p = _posterior(np.where(seen[:, None], scores, 0.0) + start) * seen[:, None]
                keys = [column(batch, c).slice(at, len(texts)) for c in ("_host", "_suffix", "_declared")]
                yield pa.RecordBatch.from_arrays([*keys, *[pa.array(p[:, i]) for i in range(width)]], names=["host", "suffix", "declared", *names])

    thin = table.select(words, "_host", "_suffix", "_declared").mapInArrow(first, "host string, suffix string, declared string, " + ", ".join(f"{x} double" for x in names))
    sums = staged(thin.groupBy("host", "suffix", "declared").agg(*[F.sum(x).alias(x) for x in names], F.count("*").alias("n")), "language-sums")
    by_declared = {r.declared: np.array(r[1 : width + 1]) for r in sums.groupBy("declared").agg(*[F.sum(x) for x in names]).collect()}  # at most languages + 2 rows
    overall = sum(by_declared.values(), np.zeros(width)) + 1.0
    overall = overall / overall.sum()
    options = ["", "?", *languages]
    table_d = np.stack([by_declared.get(d, np.zeros(width)) for d in options]) + 0.5
    trust = np.log(table_d / table_d.sum(0))  # log P(declared | language)

    hosts = sums.groupBy("host", "suffix").agg(*[F.sum(x).alias(x) for x in names], F.sum("n").alias("n"))
    suffixes = hosts.groupBy("suffix").agg(*[F.sum(x).alias(f"s{x}") for x in names])
    hosts = hosts.join(suffixes, "suffix")
    plus = lambda prefix: reduce(lambda a, b: a + b, [F.col(f"{prefix}{x}") for x in names])
    above = [(F.col(f"s{x}") + SUFFIX_WEIGHT * float(overall[i])) / (plus("s") + SUFFIX_WEIGHT) for i, x in enumerate(names)]
    prior = F.array(*[F.log((F.col(x) + HOST_WEIGHT * above[i]) / (plus("") + HOST_WEIGHT)) for i, x in enumerate(names)])
    priors = staged(hosts.select(F.struct("host", "suffix").alias("_place"), prior.alias("_prior"), "n"), "host-priors")
    placed = table.withColumn("_place", F.struct(F.col("_host").alias("host"), F.col("_suffix").alias("suffix"))).drop("_host", "_suffix")
    if priors.count() <= BROADCAST_HOSTS:
        joined = placed.join(F.broadcast(priors.drop("n")), "_place").drop("_place")
    else:
        joined = join_spread(placed, priors.drop("n"), "_place", counts=priors.select("_place", "n")).drop("_place")

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = {d: i for i, d in enumerate(options)}
        for batch in batches:
            for at, texts in parts(text_column(batch, words), 1 << 20):
                scores = text_scores(texts, model)
                own = slice(at, at + len(texts))
                some = batch.slice(at, len(texts))
                prior = column(some, "_prior").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                said = np.array([row[x] for x in column(some, "_declared").to_pylist()], np.int64)
                none = np.isnan(scores[:, 0])
                p = _posterior(np.where(none[:, None], 0.0, scores) + prior + trust[said])
                best = p.argmax(1)
                best[none] = width - 1
                tags = np.array([*languages, UNDETERMINED], object)[best]
                sure = np.where(none, 0.0, p[np.arange(len(p)), best])
                yield pa.RecordBatch.from_arrays([*[column(some, f"c_{c}") for c in carry], pa.array(tags, pa.string()), pa.array(sure)], names=[*carry, *names_out])

    kinds = ", ".join(f"`{c}` {table.schema[f'c_{c}'].dataType.simpleString()}" for c in carry)
    return joined.mapInArrow(second, f"{kinds}, `{names_out[0]}` string, `{names_out[1]}` double")


def of_documents(docs: DataFrame, carry: list[str], names_out: tuple[str, str] = ("language", "confidence")) -> DataFrame:
    """identify() for documents: source is the host, lang the declaration; there is no address.

    Languages are all that lang names (languages_of): upper case and regions do not matter, and a language of a few documents is one too.
    """
    languages = languages_of(docs, "lang")
    return identify(docs, fit(docs, "lang", languages), languages, carry, "text", F.col("source"), F.lit(None).cast("string"), F.col("lang"), names_out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: language, confidence and kept (a language was found with at least even odds) of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return of_documents(docs, ["doc_id"]).withColumn("kept", (F.col("language") != UNDETERMINED) & (F.col("confidence") >= 0.5))


def pages_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for web pages: markup language, address suffix and host from the page itself; text models from documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    languages = languages_of(docs, "lang")
    model = fit(docs, "lang", languages)
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    text = F.regexp_replace(F.regexp_replace("html", "(?is)<(script|style|nav)\\b.*?</\\1>|<!--.*?-->", " "), "<[^>]*>", " ")
    host = F.regexp_extract("url", "^[a-zA-Z]+://([^/:?#]+)", 1)
    suffix = F.regexp_extract(host, "([^.]+)$", 1)
    declared = F.regexp_extract("html", "(?i)<html[^>]*\\blang=[\"']?([A-Za-z-]+)", 1)
    return identify(pages.withColumn("_plain", text), model, languages, ["page_id"], "_plain", host, suffix, declared)
