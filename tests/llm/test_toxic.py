"""Toxic documents are found by few words in long texts."""

import random

from netlens.llm import quality

WORDS = [f"word{i}" for i in range(300)]
TOXIC = ["idiot", "scum", "clown", "moron"]


def test_toxic_recall(spark, tmp_path):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(600):
        words = [rng.choice(WORDS) for _ in range(rng.choice([30, 200, 1500]))]
        bad = int(i % 4 == 0)
        for _ in range(2 * bad):
            words[rng.randrange(len(words))] = rng.choice(TOXIC)
        docs.append((i, " ".join(words)))
        labels.append((i, 1, bad))
    docs += [(600, ""), (601, None), (None, "idiot")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = quality.query(spark, str(tmp_path)).collect()
    kept = {r.doc_id: r.kept for r in rows}
    assert len(rows) == len(docs)
    bad = [kept[i] for i, _, t in labels if t]
    good = [kept[i] for i, _, t in labels if not t]
    assert sum(bad) <= 0.05 * len(bad)
    assert sum(good) >= 0.97 * len(good)


def test_without_toxic_labels(spark):
    docs = spark.createDataFrame([(i, "one two idiot") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    model = quality.fit_toxic(docs, labels)
    assert not len(model[0])
    weighed = quality.weigh(docs, quality.fit(docs, quality.clean(labels, 0)), ["doc_id"], toxic_model=model)
    assert quality.toxic_cut(weighed, labels) == float("inf")
