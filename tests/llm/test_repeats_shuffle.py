"""Sequences that occur once are not shuffled as rows."""

import random

from netlens.llm import chunks


def test_lone_sequences_stay_in_their_tasks(spark, monkeypatch):
    rng = random.Random(3)
    words = lambda n: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(n))
    passage = words(80)
    docs = spark.createDataFrame([(i, f"{words(2000)} {passage} {words(30)}" if i % 50 == 0 else words(2000)) for i in range(200)], "doc_id long, text string")
    seen, keep = [], chunks.join_spread
    monkeypatch.setattr(chunks, "join_spread", lambda rows, *a, **k: seen.append(rows.count()) or keep(rows, *a, **k))
    found = chunks.repeated_spans(docs).collect()
    assert sorted(r.doc_id for r in found) == [50, 100, 150] and all(r.first_doc_id in (0, 50, 100) and r.first_doc_id < r.doc_id for r in found)
    every = chunks.sequence_rows(docs, chunks.MIN_WORDS).count()
    assert every > 20_000 and seen[0] < 200
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(texts[r.doc_id].index(passage) - 8 <= r.start and r.stop - r.start >= 300 for r in found)
