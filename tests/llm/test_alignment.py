"""Operator 11 against plain loops over the libraries' whole-text ids."""

import collections
import hashlib
import json
import random

import pyarrow as pa
import pytest

from netlens.llm import alignment
from netlens.llm.common import staged

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SIGNS = ["the", " of", " stone", "river", "s", "'s", " ", "  ", "\n", "\t", "é", " über", "二", "\x00", "▁", "<|endoftext|>", "<s>", "<0x0A>", ".", ", ", "1234", ";\r", " ", "👍🏽", "Straße", "____", "--"]


def brute(rows):
    """The columns of op11 by definition."""
    a_lib = tokenizers.Tokenizer.from_file(A)
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=B)
    vocab = {i: t for t, i in json.load(open(A, encoding="utf-8"))["model"]["vocab"].items()}
    decode = tokenizers.decoders.ByteLevel()
    raw = alignment.byte_level(A)
    for i in random.Random(0).sample(sorted(vocab), 500):
        assert i == 50256 or decode.decode([vocab[i]]) == raw[i].decode("utf-8", "replace")
    out, links_of, count = [], [], collections.Counter()
    for doc_id, text in rows:
        whole = (" " + text).encode() if text else b""
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        spell = lambda i: bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode()
        x, y = [raw[i] for i in a], [spell(i) for i in b]
        if b"".join(x) != whole or b"".join(y) != whole:
            a, b, x, y = [], [], [], []
        spans = lambda parts: [(sum(map(len, parts[:k])), sum(map(len, parts[: k + 1]))) for k in range(len(parts))]
        sa, sb = spans(x), spans(y)
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, low = [], 0
        for e in ends:
            groups.append(",".join(str(i) for i, (s, t) in zip(a, sa) if low <= s and t <= e) + "|" + ",".join(str(i) for i, (s, t) in zip(b, sb) if low <= s and t <= e))
            low = e
        links = [(i, j) for i, (s, t) in zip(a, sa) for j, (u, v) in zip(b, sb) if s < v and u < t]
        count.update(links)
        links_of.append(links)
        out.append([doc_id, len(a), len(b), len(groups), len(links), ";".join(groups)])
    best = collections.defaultdict(int)
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    return [(*row[:5], sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(row[5].encode()).hexdigest() if row[5] else "") for row, links in zip(out, links_of)]


def corpus():
    rng = random.Random(11)
    rows = [(i, "".join(rng.choice(SIGNS) for _ in range(rng.randrange(1, 40)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, " "), (403, "x" * 3000), (404, "a▁b"), (None, "the stone"), (None, None), rows[3], rows[3]]
    rows += [(410 + i, " ".join(rng.choice(["the", "stone", "river's", "Überraschung", "antidisestablish"]) for _ in range(60))) for i in range(5)]
    return rows


def test_a_small_memo_changes_nothing():
    texts = pa.array([t for _, t in corpus()], pa.string())
    out = []
    for windows in (5, 100_000):
        own = alignment.Aligner(A, B, windows)
        for _ in range(2):
            out.append([[x.tolist() if hasattr(x, "tolist") else x for x in row] for row in own.align(texts)])
    assert out[0] == out[1] == out[2] == out[3]


@pytest.mark.parametrize("held", [4_000_000, 0])
def test_alignment(spark, held):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "k", 2) for i, t in rows], "doc_id long, text string, row int, groups string, a int").repartition(3)
    aligned = staged(alignment.align(df, A, B, digest=True), "aligned")
    found = alignment.with_counts(aligned, staged(alignment.pair_counts(aligned), "pairs"), held=held)
    got = collections.Counter(tuple(r) for r in found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect())
    assert got == collections.Counter(brute(rows))
    assert sum(r[1] == 0 for r in got.elements()) > 3


def test_general_outputs_and_empty_tables(spark):
    df = spark.createDataFrame([(7, "the stone")], "doc_id long, text string")
    r = alignment.align(df, A, B).first()
    assert r.groups.count(";") == r.n_groups - 1 and r.n_links == 2 and len(r.a) == len(r.b) == len(r.often) == 8
    pairs = staged(alignment.pair_counts(alignment.align(df, A, B)), "pairs")
    assert {(p.n, p.best) for p in pairs.collect()} == {(1, True)}
    none = staged(alignment.align(df.limit(0), A, B), "none")
    for held in (0, 10):
        assert alignment.with_counts(none, staged(alignment.pair_counts(none), "pairs"), held=held).count() == 0
