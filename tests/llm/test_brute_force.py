"""Models and estimates recomputed from plain counts."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from netlens.llm import chunks, fingerprints, language, packing, quality, warc

public_tokenizers = pytest.importorskip("public_tokenizers")
BPE = public_tokenizers.path("byte_bpe_50k.json")


def bucket(words):
    """The bucket of a word, or of a pair of neighbours."""
    code, _ = quality.features(pa.array([" ".join(words)]))
    return int(code[-1])


def test_log_weights(spark):
    rng = random.Random(9)
    words = ["stone", "river", "light", "moves", "Über", "buy!!", "win", "%%"]
    rows = [(i, " ".join(rng.choice(words[:5] if i % 3 else words[3:]) for _ in range(rng.randrange(1, 60)))) for i in range(60)]
    rows += [(100, None), (101, ""), (None, "stone river"), rows[3], rows[3]]
    clean = [i for i in range(30) if i % 3]

    def grams(text):
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in (text or "").split()]
        return [(x,) for x in w] + list(zip(w, w[1:]))

    raw, target = collections.Counter(), collections.Counter()
    for i, t in rows:
        raw.update(grams(t))
        if i in clean:
            target.update(grams(t))
    place = {g: bucket(g) for g in raw}
    assert len(set(place.values())) == len(place)  # no two n-grams of this test share a bucket
    total = sum(raw.values()) + 0.5 * quality.BUCKETS
    mass = sum(target.values())

    def ratio(g):
        p = (raw[g] + 0.5) / total
        return math.log((target[g] + 0.01 * mass * p) / (1.01 * mass) / p)

    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, hit int").repartition(3)
    good = spark.createDataFrame([(i,) for i in clean], "doc_id long")
    got = quality.weigh(df, quality.fit(df, good), ["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        own = [ratio(g) for g in grams(r.text)]
        assert r.log_weight == pytest.approx(quality.LENGTH * sum(own) / len(own) if own else 0.0, abs=1e-6)
    noise = collections.defaultdict(set)
    for r in got:
        noise[r.doc_id].add(round(r.gumbel_key - r.log_weight, 9))
    assert all(len(x) == 1 for x in noise.values())  # equal ids, equal noise


def posteriors(labelled, rows, languages):
    """(language, confidence) of rows (text, host, suffix, declared) from plain counts; labelled are (text, language)."""

    def trigrams(text):
        b = (text or "").encode()
        fold = bytes(x + 32 if 65 <= x < 91 else x for x in b)
        letter = lambda x: 97 <= x < 123 or x >= 128
        return [((int.from_bytes(fold[i : i + 3], "big") * 2654435761) % 2**32) >> 16 for i in range(len(fold) - 2) if letter(fold[i + 1])]

    counts = [collections.Counter(g for t, l in labelled if l == x for g in trigrams(t)) for x in languages]
    sizes = [sum(c.values()) + 0.5 * language.BUCKETS for c in counts]

    def scores(text):
        g = trigrams(text)
        if not g:
            return None
        k = min(1, language.EVIDENCE / len(g))
        return [k * sum(math.log((c[x] + 0.5) / n) for x in g) for c, n in zip(counts, sizes)] + [-k * math.log(language.BUCKETS) * len(g)]

    def normal(logs):
        e = [math.exp(x - max(logs)) for x in logs]
        return [x / sum(e) for x in e]

    width = len(languages) + 1
    start = [math.log(0.999 / len(languages))] * len(languages) + [math.log(1e-3)]
    by = {k: collections.defaultdict(lambda: [0.0] * width) for k in ("host", "suffix", "declared", "all")}
    for t, h, s, d in rows:
        logs = scores(t)
        if logs:
            p = normal([a + b for a, b in zip(logs, start)])
            for k, v in (("host", (h, s)), ("suffix", s), ("declared", d), ("all", 0)):
                by[k][v] = [a + b for a, b in zip(by[k][v], p)]
    overall = [x + 1 for x in by["all"][0]]
    overall = [x / sum(overall) for x in overall]
    options = ["", "?", *languages]
    column = [sum(by["declared"][d][i] + 0.5 for d in options) for i in range(width)]
    out = []
    for t, h, s, d in rows:
        logs = scores(t)
        if not logs:
            out.append(("und", 0.0))
            continue
        suffix = [(x + language.SUFFIX_WEIGHT * o) / (sum(by["suffix"][s]) + language.SUFFIX_WEIGHT) for x, o in zip(by["suffix"][s], overall)]
        host = [(x + language.HOST_WEIGHT * o) / (sum(by["host"][h, s]) + language.HOST_WEIGHT) for x, o in zip(by["host"][h, s], suffix)]
        p = normal([a + math.log(b) + math.log((by["declared"][d][i] + 0.5) / column[i]) for i, (a, b) in enumerate(zip(logs, host))])
        k = p.index(max(p))
        out.append(([*languages, "und"][k], p[k]))
    return out


VOCABULARY = {"en": ["the", "and", "with", "thing", "other"], "de": ["der", "und", "nicht", "schön", "über"], "fr": ["le", "être", "nous", "chaque", "où"], "es": ["el", "niño", "señor", "mañana", "pero"]}


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_language_of_documents_and_pages(spark, tmp_path, monkeypatch, broadcast):
    monkeypatch.setattr(language, "BROADCAST_HOSTS", broadcast)
    rng = random.Random(2)
    text = lambda l, n: " ".join(rng.choice(VOCABULARY[l]) for _ in range(n))
    tags = sorted(VOCABULARY)
    docs = [(i, text(l, rng.choice([1, 3, 40])), l if i % 5 else None, f"host{i % 3}") for i, l in enumerate(tags * 20)]
    docs += [(900, None, "en", "host1"), (901, "", None, None), (902, "12 %% 9", "de", "q"), docs[0], docs[0]]
    spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, lang string, source string, h int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    labelled = [(t, l) for _, t, l, _ in docs if l]
    want = collections.Counter((i, l, round(p, 6)) for (i, *_), (l, p) in zip(docs, posteriors(labelled, [(t, h or "", "", l or "") for _, t, l, h in docs], tags)))
    assert collections.Counter((r.doc_id, r.language, round(r.confidence, 6)) for r in language.of_documents(df, ["doc_id"]).collect()) == want

    pages, plain = [], []
    for i in range(80):
        l = tags[i % 4]
        declared = [l, "", "zz-ZZ", tags[(i + 1) % 4]][rng.choice([0, 0, 0, 1, 2, 3])]
        host, suffix = f"www.site{l}.{'com' if i % 7 else l}", "com" if i % 7 else l
        body = text(l, rng.choice([0, 2, 30]))
        pages.append((i, f"http://{host}/x{i}", f"<html{' lang=' + chr(34) + declared + chr(34) if declared else ''}><script>the and</script><p>{body}</p></html>"))
        plain.append((re.sub("<[^>]*>", " ", re.sub("(?s)<script.*?</script>", " ", pages[-1][2])), host, suffix, declared if declared in ("", *tags) else "?"))
    pages.append((500, None, None))
    plain.append((None, "", "", ""))
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2).write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r for r in language.pages_query(spark, str(tmp_path)).collect()}
    for (i, *_), (l, p) in zip(pages, posteriors(labelled, plain, tags)):
        assert got[i].language == l and got[i].confidence == pytest.approx(p, abs=1e-6)
    worded = [i for i in range(80) if plain[i][0].split()]
    assert sum(got[i].language == tags[i % 4] for i in worded) >= 0.9 * len(worded)


def test_likeness_of_fingerprints():
    rng = random.Random(5)
    texts = ["\n".join(" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(1, 6))) for _ in range(30)] + ["", "a b c"]
    strong, narrow = fingerprints.vectors([x.encode() for x in texts])

    def lanes(text):
        total = [0] * fingerprints.LANES
        for p in text.split("\n"):  # a fingerprint is the sum of its paragraphs'
            for i, x in enumerate(fingerprints.vectors([p.encode()])[1][0].astype(np.int16).tolist()):
                total[i] += x
        return total

    own = [lanes(x) for x in texts]
    for i in range(len(texts)):
        j = (i * 7 + 3) % len(texts)
        got = fingerprints.likeness(strong[[i]], narrow[[i]], strong[[j]], narrow[[j]])[0]
        far, whole = sum((x - y) ** 2 for x, y in zip(own[i], own[j])), sum(x * x for x in own[i]) + sum(y * y for y in own[j])
        if sorted(texts[i].split("\n")) == sorted(texts[j].split("\n")):
            assert got == 1.0
        else:
            assert got == pytest.approx(max(0.0, min(1 - far / whole, 1 - 1e-9)) if whole else 0.0)


def test_little_padding(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["stone", "river", "and"]) for _ in range(rng.choice([1, 50, 900, 5000])))) for i in range(400)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), BPE).collect()
    tokens, sequences = sum(r.length for r in got), len({r.sequence_id for r in got})
    assert sequences * 2048 - tokens <= 2 * 2048  # one open sequence a partition


def test_revisits_by_shuffle(spark, monkeypatch):
    rows = [(i, f"http://a.b/{i}", ["", None, "x", "y"][i % 4] if i % 9 else f"own {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    read = lambda: sorted(tuple(r) for r in warc.read_archives(warc.write_index(*reversed(warc.write_archives(df)))).collect())
    want = read()
    monkeypatch.setattr(warc, "BROADCAST_PAYLOADS", 0)
    assert read() == want and sum(r[3] == "revisit" for r in want) > 20


def test_spans_cover_repeats_and_nothing_else(spark):
    rng = random.Random(12)
    fresh = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    passage = fresh(80)
    docs = [(i, f"{fresh(60)} {passage} {fresh(60)}") for i in range(5)] + [(10 + i, fresh(300)) for i in range(5)]
    spans = chunks.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string").repartition(2)).collect()
    assert {r.doc_id for r in spans} == {1, 2, 3, 4}
    for r in spans:
        text = dict(docs)[r.doc_id]
        assert text[r.start : r.stop].strip() in passage and r.n_words >= 60 and r.first_doc_id == 0
