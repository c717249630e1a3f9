"""The pipeline's stages on small tables; labels are too few at sf0.001 to set the quality cut."""

import collections
import os
import random

import pytest

import corpus_pipeline
from netlens.llm.common import staged

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, n = docs.columns, docs.count()
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language", "quality", "near-duplicates", "repeats", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = staged(stage(spark, docs, SF), "test")
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    assert docs.where("n_chars <> length(text)").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() == n
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert docs.join(labels.where("quality = 0"), "doc_id").count() * 5 < labels.where("quality = 0").count()


def odd_rows():
    rng = random.Random(4)
    words = {"en": ["the", "and", "with", "thing", "other", "river"], "de": ["der", "und", "nicht", "schön", "über", "stein"]}
    text = lambda l, n: " ".join(rng.choice(words[l]) + rng.choice(["", "", str(rng.randrange(99))]) for _ in range(n))
    rows = [(i, text(l, 80), l, f"s{i % 2}") for i, l in enumerate(["en", "de"] * 30)]
    rows += [(100, rows[0][1], "en", "s0"), (101, None, "en", "s0"), (102, "", None, None), (103, "12 99 %%", "de", None), (104, "x" * 200_000, "en", "s1"), (None, text("en", 60), "en", "s0"), (None, None, None, None), rows[2], rows[2], (4, text("en", 70), "en", "s1")]
    return [(*r, len(r[1] or ""), "l", 1, b"i", 2.0) for r in rows]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, language string, _cuts int, ids binary, log_weight double"


@pytest.mark.parametrize("n", [None, 0])
def test_odd_tables(spark, tmp_path, n):
    rows = odd_rows()[:n]
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)] + [(None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, str(tmp_path)), "odd")
        if name != "packing":
            assert docs.columns == [x.split()[0] for x in SCHEMA.split(", ")]
        kept[name] = collections.Counter(r.doc_id for r in docs.select("doc_id").collect())
    if n == 0:
        assert not any(kept.values())
        return
    first, quality = kept["language"], kept["quality"]
    assert not {101, 102, 103} & set(first) and first[2] == 3 and first[4] == 2 and first[None] == 1
    assert all(quality[i] in (0, first[i]) for i in first)  # rows of one id together
    near = kept["near-duplicates"]
    assert near[100] == 0 and near[0] == quality[0] and near[2] == quality[2] and kept["repeats"] == near
    assert set(kept["packing"]) == set(near)


def test_single_stages_on_odd_texts(spark, tmp_path):
    """What each stage does with texts that an earlier one would have dropped."""
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(2)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert stages["quality"](spark, docs, str(tmp_path)).count() == len(rows)
    near = collections.Counter(r.doc_id for r in stages["near-duplicates"](spark, docs, "").collect())
    assert near == collections.Counter(r[0] for r in rows if r[0] != 100)
    cut = stages["repeats"](spark, docs, "").collect()
    assert len(cut) == len(rows) and all(r.n_chars == len(r.text or "") for r in cut)  # null texts keep theirs
    assert {r.text for r in cut if r.doc_id == 101} == {None} and next(r.text for r in cut if r.doc_id == 104) == "x" * 200_000
    packed = stages["packing"](spark, docs, "").collect()
    assert sum(r.length for r in packed if r.doc_id in (101, 102)) == 2 and len({r.doc_id for r in packed}) == len({r[0] for r in rows})
