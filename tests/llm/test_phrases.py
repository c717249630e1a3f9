"""Operator 13 against plain counting."""

import collections
import random
import re

import pyarrow as pa
import pytest

from netlens.llm import phrases


def brute(rows, least, cover, most):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text or "")):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = []
        for p, a in c.items():
            if len(p) < 2 or a < least:
                continue
            score, _, l, r = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            if len(p) == 3 or not any(len(q) == 3 and m >= least and p in (q[:2], q[1:]) and 100 * m >= cover * a for q, m in c.items()):
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for i, (s, a, p, l, r) in enumerate(sorted(found)[:most]):
            out.append((lang, i + 1, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["stone", "River", "the", "of", "New", "york", "über", "Éa", "x-ray", "it's", "\x1c", "+", "-a", "日本", "hot\x00dog"]
    join = lambda n: "".join(rng.choice(words[: rng.choice([4, 15])]) + rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r\n", "!?", " ; "]) for _ in range(n))
    passage = join(60)
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice([join(rng.randrange(1, 60)), passage, join(10) + passage + join(20)])) for _ in range(150)]
    return rows + [("en", None), ("fr", ""), ("de", " "), ("de", "..."), ("en", "one"), ("en", "new york " * 400), ("en", "new york new york"), (None, "a b" * 300), ("zz", "only here")]


@pytest.mark.parametrize("seed,period,longest,most", [(1, 16, 256, 2000), (2, 1, 256, 2000), (3, 2, 3, 2000), (4, 10**6, 1, 7), (5, 10**6, 50, 20)])
def test_phrases(spark, seed, period, longest, most):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "k", 1, 2) for r in rows], "lang string, text string, chunk string, n int, k int").repartition(3)
    got = phrases.collocations(df, most=most, period=period, longest=longest).collect()
    want = brute(rows, 10, 50, most)
    assert sorted(map(tuple, got)) == want and len(want) > 15
    assert {r.lang for r in got} >= {"en", "de", "und", ""}


def test_other_limits_and_empty_tables(spark):
    rows = corpus(9)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert sorted(map(tuple, phrases.collocations(df, least=3, cover=80).collect())) == brute(rows, 3, 80, 2000)
    assert phrases.collocations(df.limit(0)).count() == 0
    assert phrases.collocations(df.where("text IS NULL OR text IN ('', ' ', '...')")).count() == 0


def test_chunks_overlap_by_two_words_and_copies_share_them():
    rng = random.Random(3)
    text = " ".join(rng.choice(["stone", "river", "the", "of", "light"]) + str(rng.randrange(30)) for _ in range(400))
    found, own = phrases.chunks_of(pa.array([text, "front matter " + text]))
    chunks = [x.decode() for x in found.to_pylist()]
    for k in (0, 1):
        mine = [c[1:].split(" ") for c, o in zip(chunks, own) if o == k]
        assert all(a[-2:] == b[:2] for a, b in zip(mine, mine[1:]))
        whole = mine[0] + [w for c in mine[1:] for w in c[2:]]
        assert " ".join(whole) == (text if k == 0 else "front matter " + text)
    assert len(set(chunks)) <= len(chunks) / 2 + 2


def test_scores_are_exact_beyond_64_bits(spark):
    a = 3_000_000_000
    got = spark.range(1).selectExpr(f"CAST(1000000 AS decimal(7,0)) * (CAST({a} AS decimal(15,0)) * CAST({a} AS decimal(15,0))) div (CAST({a + 1} AS decimal(15,0)) * CAST({a + 7} AS decimal(15,0))) x").first().x
    assert got == 10**6 * a * a // ((a + 1) * (a + 7))
