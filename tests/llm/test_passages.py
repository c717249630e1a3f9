"""Spans are passages that stand together elsewhere, not chunks from here and there."""

import random

import pyarrow as pa

from netlens.llm import chunks
from netlens.llm.hashing import text_bytes


def chunk_texts(text):
    data, offsets = text_bytes(pa.array([text]))
    first, after, _, starts, ends = chunks.cut(data, offsets)
    return [bytes(data[starts[a] : ends[b - 1]]).decode() for a, b in zip(first, after)]


def test_chunks_from_different_places_are_no_passage(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(5000)]
    unique = " ".join(rng.choice(words) for _ in range(400))
    parts, w, docs, at = chunk_texts(unique), unique.split(), [], 0
    # every chunk of the last document stands in one of its own, with neighbours up to 19 words, among other words
    for i, part in enumerate(parts):
        n = len(part.split())
        low = max(0, at - (19 - n + 1) // 2)
        around = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(2)]
        docs.append((i, f"{around[0]} {' '.join(w[low : low + 19])} {around[1]}"))
        at += n
    known = {c for _, t in docs for c in chunk_texts(t)}
    run, longest = 0, 0
    for part in parts:
        run = run + len(part.split()) if part in known else 0
        longest = max(longest, run)
    assert longest >= 20  # copied chunks in a row
    docs.append((10_000, unique))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    texts = {i: t.split() for i, t in docs}
    windows = {}
    for i, w in texts.items():
        for k in range(len(w) - 19):
            windows.setdefault(" ".join(w[k : k + 20]), set()).add(i)
    for r in chunks.repeated_spans(df).collect():
        span = dict(docs)[r.doc_id].encode()[r.start : r.stop].decode().split()
        assert len(span) == r.n_words >= 20
        assert all(any(len(windows.get(" ".join(span[j : j + 20]), ())) > 1 for j in range(max(0, k - 19), min(k, len(span) - 20) + 1)) for k in range(len(span)))


def test_first_occurrence_stays_whole_in_periodic_text(spark):
    text = "one two three four five six seven eight " * 40
    df = spark.createDataFrame([(1, text), (2, "alpha " * 5 + text)], "doc_id long, text string")
    left = {r.doc_id: r.text for r in chunks.remove_spans(df, chunks.repeated_spans(df)).collect()}
    assert 20 <= len(left[1].split()) < 80
    assert len(left[2].split()) < 40
