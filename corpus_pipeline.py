"""Corpus preparation in five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its output is written
as Parquet and read again as the next one's input.  All but the last return the columns of ``documents``.

What holds for every stage: an empty table gives an empty one.  Further columns, whatever their names, are carried along (packing
ignores them).  Repeated rows are all treated alike, and all stay or all go.  Rows that share a doc_id but not the text are one
document to the labels, the noise and the near-duplicates, so there they stay or go together, and each gets the other's cuts.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.llm import chunks, language, minhash, packing, quality
from netlens.llm.common import fresh, staged


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language was found with at least even odds.

    Documents without letters (null or empty text, numbers) have no language and go; null ids, sources and declarations are values like others.
    """
    tag, sure = fresh("language", docs.columns), fresh("confidence", docs.columns)
    found = language.of_documents(docs, docs.columns, (tag, sure))
    return found.where((F.col(tag) != language.UNDETERMINED) & (F.col(sure) >= 0.5)).drop(tag, sure)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the Gumbel top-k by importance weight below the toxic cut, both as in op6.

    A text without words weighs 0.0 and is judged by its noise; documents with null id share their noise.  Without labels all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ratio, toxic_model = quality.fit(docs, quality.clean(labels, 0)), quality.fit_toxic(docs, labels)
    weighed = staged(quality.weigh(docs, ratio, ["doc_id"], toxic_model=toxic_model), "weights")
    limit, toxic_limit = quality.cut_off(weighed, labels), quality.toxic_cut(weighed, labels)
    weight, key, score = fresh("log_weight", docs.columns), fresh("gumbel_key", docs.columns), fresh("toxic_score", docs.columns)
    scored = quality.weigh(docs, ratio, docs.columns, (weight, key, score), toxic_model=toxic_model)
    return scored.where((F.col(key) >= F.lit(limit)) & (F.col(score) < F.lit(toxic_limit))).drop(weight, key, score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: five-word shingles, similarity 0.8 or more.

    It is the one with the smallest doc_id.  Texts without words and documents with null id are like no other and stay.
    """
    found = minhash.near_duplicates(docs, k=5, similarity=0.8)
    rest = found.where("NOT kept").select("doc_id").distinct()
    return docs.join(rest, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut repeated passages out of the texts, all but their first occurrence; n_chars follows.

    Every row stays, even with nothing left; null texts and documents with null id stay as they are.
    """
    return chunks.remove_spans(docs, chunks.repeated_spans(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack into sequences of at most 2048 tokens, end id 1: a row per piece, with its ids.

    A null or empty text is its end id alone; null and repeated ids are packed as any row.
    """
    # workers outlive a stage, so the memo stays small beside what the other stages hold
    return packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), memo=100_000)


STAGES = [
    ("language", identify_language),
    ("quality", classify_quality),
    ("near-duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("packing", pack_sequences),
]

#: The stages' models, hashes and chunk cuts are not expressible in SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
