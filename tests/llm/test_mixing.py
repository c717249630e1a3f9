"""Operator 12: base scores by plain counting, the model by a bit-by-bit walk, and that it is a probability."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netlens.llm import mixing

WORDS = ["stone", "River", "the", "of", "and", "über", "x-ray", "it's", "日本", "\x1c", "light."]


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def corpus(seed=1):
    rng = random.Random(seed)
    spell = lambda: "".join(rng.choice(["th", "in", "er", "a", "ou"]) for _ in range(rng.randrange(1, 5)))
    prose = lambda n: "".join((rng.choice(WORDS) if rng.random() < 0.8 else spell()) + rng.choice([" ", " ", "\n", "  \t"]) for _ in range(n))
    passage = prose(80)
    rows = [(i, prose(rng.randrange(1, 120))) for i in range(200)] + [(300 + i, passage) for i in range(20)]
    return rows + [(400, None), (401, ""), (402, " \n "), (403, "x" * 3000), (404, prose(3000)), (405, "neverseen words here"), (None, "the stone"), (None, None), rows[3], rows[3]]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "k", 0.5) for i, t in rows], "doc_id long, text string, row int, symbols string, score double").repartition(3)


def out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2


@pytest.mark.parametrize("most", [1 << 17, 6])
def test_counts_and_base(spark, most):
    rows = corpus()
    got = mixing.score_texts(frame(spark, rows), out(), most=most).collect()
    c = collections.Counter()
    for i, t in rows:
        if not held(i):
            c.update([*words_of(t), None])
    n, v = sum(c.values()), len(c)
    want = collections.Counter()
    for i, t in rows:
        tokens = [*words_of(t), None]
        want[i, held(i), len(tokens), sum(c[w] > 0 for w in tokens), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens), 6)] += 1
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got) and any(r.held_out for r in got)
    by_text = collections.defaultdict(set)
    texts = collections.defaultdict(set)
    for i, t in rows:
        texts[i].add(t or "")
    for r in got:
        if len(texts[r.doc_id]) == 1:
            by_text[next(iter(texts[r.doc_id]))].add(round(r.score, 3))
            assert (r.bits_per_byte is None) == (next(iter(texts[r.doc_id])) == "")
    assert all(len(x) == 1 for x in by_text.values())  # a function of the text
    copies = [r for r in got if r.held_out and r.doc_id and 300 <= r.doc_id < 320]
    assert copies and all(r.score > (0.7 if most > 6 else 1) * r.base_score for r in copies)  # passages that training texts hold
    apart = [r for r in got if r.held_out and not (r.doc_id and 300 <= r.doc_id < 320)]
    assert sum(r.score for r in apart) > (1.1 if most > 6 else 1.3) * sum(r.base_score for r in apart)  # random words: the base is hard to beat


def test_held_out_rows_teach_nothing(spark):
    rows = [(i, t) for i, t in corpus(2) if i is not None and i < 320]
    one = {r.doc_id: r.score for r in mixing.score_texts(frame(spark, rows), out()).collect()}
    other = {r.doc_id: r.score for r in mixing.score_texts(frame(spark, [(i, "something else " * 50 if held(i) else t) for i, t in rows]), out()).collect()}
    assert all(abs(one[i] - other[i]) < 1e-6 * abs(one[i]) for i, _ in rows if not held(i))


def test_no_training_rows_and_empty_tables(spark):
    df = frame(spark, [(1, "the stone"), (2, None)])
    got = {r.doc_id: r for r in mixing.score_texts(df, F.lit(True)).collect()}
    assert got[1].n_known == got[2].n_known == got[1].train_tokens == 0 and got[1].base_score == 0 and got[1].score < got[2].score < 0
    assert mixing.score_texts(df.limit(0), out()).count() == 0


def model(seed=5):
    rng = random.Random(seed)
    texts = [" ".join(rng.choice(["a", "b", "cc", "the", "of"]) + rng.choice(["", "", "x"]) for _ in range(60)) for _ in range(40)]
    count = collections.Counter(w for t in texts for w in words_of(t))
    top = [w for w, n in count.most_common(6)]
    hashes = lambda table: np.array([mixing.span_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w)]), table)[0] for w in top])
    rest = [w for w in count.elements() if w not in top]
    bytes_ = np.bincount(np.frombuffer("".join(rest).encode(), np.uint8), minlength=257).astype(float)
    bytes_[256] = len(rest)
    codes = mixing.Codes(hashes(mixing.LOWER), hashes(mixing.CHECK), np.array([count[w] for w in top]), len(texts), len(rest), bytes_, sum(count.values()) + len(texts), len(count) + 1)
    symbols, bounds, *_ = codes.symbols(pa.array(texts))
    counts = np.zeros((2, codes.slots + codes.spelt, 2), np.uint32)
    one, two = codes.contexts(symbols, bounds)
    _, bit, _, s1, s2, _ = codes.expand(symbols, one, two)
    np.add.at(counts[0], (s1, bit), 1)
    np.add.at(counts[1], (s2, bit), 1)
    weights = np.random.default_rng(seed).normal(0.3, 0.1, (mixing.GATES, mixing.INPUTS + 1))
    return codes, counts, mixing.Mixer(codes, counts, weights), texts


def test_codes_are_complete():
    codes, *_ = model()
    for own in (codes.length[: codes.words + 2], codes.length[codes.words + 2 :]):
        assert sum(2.0 ** -float(n) for n in own) == pytest.approx(1)
    seen = {tuple(zip(codes.nodes[a : a + n], codes.bits[a : a + n])) for a, n in zip(codes.start, codes.length)}
    assert len(seen) == len(codes.length)


def test_score_by_a_plain_walk(monkeypatch):
    codes, counts, mixer, texts = model()
    monkeypatch.setattr(mixing, "EVENTS", 700)
    for rate in (0.0, 0.05):
        some = [texts[0], "", " ".join(texts[1:12]), "the of unseen", texts[3]]
        symbols, bounds, *_ = codes.symbols(pa.array(some))
        got = mixer.score(symbols, bounds, rate)
        for k, text in enumerate(some):
            own = symbols[bounds[k] : bounds[k + 1]]
            one, two = codes.contexts(own, np.array([0, len(own)]))
            total, more = 0.0, np.zeros(3)
            for t, s in enumerate(own):
                if t % mixing.STRETCH == 0:
                    more = np.zeros(3)
                change = np.zeros(3)
                for node, bit in zip(codes.nodes[codes.start[s] :][: codes.length[s]], codes.bits[codes.start[s] :][: codes.length[s]]):
                    _, _, _, s1, s2, spelt = codes.expand(own[t : t + 1], one[t : t + 1], two[t : t + 1])
                    at = list(codes.nodes[codes.start[s] :][: codes.length[s]]).index(node)
                    n1, n2 = counts[0][s1[at]].astype(float), counts[1][s2[at]].astype(float)
                    x = np.array([codes.logit[node], *(np.log((n[1] + mixing.PRIOR) / (n[0] + mixing.PRIOR)) for n in (n1, n2))])
                    w = mixer.weights.T[spelt[at] * 16 + mixing.seen(n2.sum()) * 4 + mixing.seen(n1.sum())]
                    z = x @ (w[:3] + more) + w[3]
                    total -= np.logaddexp(0, z if not bit else -z)
                    change += rate * x * (bit - 1 / (1 + np.exp(-z)))
                more = more + change
            assert got[k] == pytest.approx(total, rel=2e-3, abs=2e-2), text[:20]


def test_next_symbols_add_up_to_one():
    codes, _, mixer, texts = model()
    start, _, *_ = codes.symbols(pa.array([texts[0]]))
    for own, range_ in ((start[:40], range(codes.words + 2)), (np.append(start[:9], np.uint32(codes.escape)), range(codes.byte, codes.byte + 257))):
        before = mixer.score(own, np.array([0, len(own)]), 0.05)[0]
        after = [mixer.score(np.append(own, np.uint32(s)), np.array([0, len(own) + 1]), 0.05)[0] for s in range_]
        assert sum(math.exp(x - before) for x in after) == pytest.approx(1, abs=1e-3)


def test_regression_finds_weights():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=(400, 3)), np.ones((400, 1))], 1)
    true = np.array([0.9, -0.3, 0.5, 0.1])
    p = 1 / (1 + np.exp(-x @ true))
    assert np.abs(mixing._regression(x, np.stack([1 - p, p], 1) * 1e4, mixing.DEFAULT) - true).max() < 0.01


def test_weights_are_fitted_on_every_bit(spark, monkeypatch):
    """The counts behind the weights hold each bit of each training symbol once, predicted without itself; they held one bit of every eighth symbol."""
    rng = random.Random(12)
    texts = [" ".join(f"w{min(int(rng.expovariate(0.2)), 30)}" for _ in range(rng.randrange(60))) for _ in range(40)] + ["rareword once"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    place = mixing.new_place(spark, "mixing")
    codes = mixing.fit_codes(mixing.vocabulary(docs), place)
    rows = mixing.coded(docs, F.lit(False), place)
    tables = mixing.count_contexts(rows, place)
    met, fit = [], mixing._regression
    monkeypatch.setattr(mixing, "_regression", lambda x, counts, start: met.append((x, counts)) or fit(x, counts, start))
    mixing.fit_weights(rows, place, tables)
    symbols, bounds, *_ = codes.symbols(pa.array(texts))
    node, bit, _, *slots, spelt = codes.expand(symbols, *codes.contexts(symbols, bounds))
    want, half = collections.Counter(), mixing.LEVELS // 2
    seen = [collections.Counter(zip(s.tolist(), bit.tolist())) for s in slots]
    for i in range(len(bit)):
        cell, logits = [int(spelt[i]) * 16], [codes.logit[node[i]]]
        for k, s in enumerate(slots):
            n = [seen[k][int(s[i]), b] - (b == bit[i]) for b in (0, 1)]
            cell[0] += int(mixing.seen(np.array(sum(n)))) * (1, 4)[k]
            logits.append(np.log(n[1] + mixing.PRIOR) - np.log(n[0] + mixing.PRIOR))
        cell += [int(np.clip(np.rint(x / wide), -half, half)) for x, wide in zip(logits, mixing.STEPS)]
        want[(*cell, int(bit[i]))] += 1
    gates = sorted({k[0] for k in want})
    got = collections.Counter()
    for g, (x, counts) in zip(gates, met, strict=True):
        for row, pair in zip(x, counts):
            for b in (0, 1):
                if pair[b]:
                    got[(g, *np.rint(row[:3] / mixing.STEPS).astype(int).tolist(), b)] += int(pair[b])
    assert sum(got.values()) == len(bit)
    assert got == want
