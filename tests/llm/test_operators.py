"""Each operator against brute force on a small table with nulls, empty and long texts, repeats and clashing columns."""

import base64
import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from netlens.llm import chunks, embeddings, fingerprints, language, minhash, packing, pieces, quality, token_files, warc
from netlens.llm.bpe import Encoder
from netlens.llm.common import components, fresh

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
BPE, SP = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORDS = ["stone", "river", "Über", "naïve", "the", "of", "and", "it's", "x-ray", "42", "été", "señor", "light", "moves", "under", "old"]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", str(rng.randrange(99))]) for _ in range(n))


def table(spark):
    """doc_id, text and columns whose names the operators use inside."""
    rng = random.Random(5)
    base = prose(rng, 120)
    texts = [base, base, base.replace("stone", "stone", 1) + " tail", base.upper(), prose(rng, 90), "", None, " ", "one", "two words", "a\n\nb", "  lead and  double ", "tab\tnew\nline \n end", "é" * 300, prose(rng, 20000), "x" * 5000]
    words = base.split(" ")
    for i in range(12):
        w = list(words)
        for _ in range(i):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(1000)}"
        texts.append(" ".join(w))
    passage = prose(rng, 60)
    texts += [prose(rng, 70) + " " + passage + " " + prose(rng, 40), prose(rng, 33) + "\n" + passage, "ﬁ ① " + prose(rng, 30) + "  <|endoftext|>\n<|endoftext|><|endoftext|> end"]
    rows = [(i * 3 + 1, t, "en", "h1", 1, 2, 3, "k") for i, t in enumerate(texts)]
    rows += [(None, prose(rng, 30), None, None, 0, 0, 0, "k"), (None, None, None, None, 0, 0, 0, "k"), rows[4], rows[0]]
    schema = "doc_id long, text string, lang string, source string, start long, component long, group long, digest string"
    return spark.createDataFrame(rows, schema).repartition(3), [(r[0], r[1]) for r in rows]


EMPTY = "doc_id long, text string, lang string, source string"


def library():
    return tokenizers.Tokenizer.from_file(BPE)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def key(doc_id):
    return (doc_id is not None, doc_id or 0)


def test_encoder_is_the_library():
    e, t, rng = Encoder(BPE), library(), random.Random(1)
    samples = ["it's a test  x", "q,'s r,'t", "x\n\ny", "a.\nB c,", " a\n b", "tab\tx y.", "", "<|endoftext|> a", "é́ x²y", "　 z"]
    samples += ["".join(rng.choice("ab'st.,!\n \t12é二²_ 　") for _ in range(rng.randrange(30))) for _ in range(4000)]
    for limit in (2_000_000, 300):  # the small memo forgets
        e.memo.limit = limit
        for texts in (samples, samples[::-1], samples[:1], []):
            found = [(at + i, ids[bounds[i] : bounds[i + 1]].tolist()) for at, ids, bounds in e.encode(pa.array(texts, pa.string())) for i in range(len(bounds) - 1)]
            assert found == [(i, t.encode(x, add_special_tokens=False).ids) for i, x in enumerate(texts)]


@pytest.mark.parametrize("plain", [False, True])
def test_added_tokens(plain):
    """As the untouched library has them; with ``plain``, as text."""
    e, t, rng = Encoder(BPE, plain), library(), random.Random(7)
    t.encode_special_tokens = plain
    signs = ["<|endoftext|>", "<|endoftext|", "|endoftext|>", "a", "b", "'s", " ", "  ", "\n", "é", "二", ".", "1"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(14))) for _ in range(20_000)]
    texts += ["<|endof", "text|>", "", "<|endoftext|>"]  # none across two texts
    found = [ids[bounds[i] : bounds[i + 1]].tolist() for _, ids, bounds in e.encode(pa.array(texts)) for i in range(len(bounds) - 1)]
    assert found == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    assert plain or sum(x.count(50256) for x in found) > 5000


def test_memo_forgets_what_is_not_used():
    from netlens.llm.words import Memo

    memo = Memo(lambda x: (np.array([int(y) for y in x]), np.ones(len(x), np.int64)), 50_000)
    for i in range(30):
        some = ["7", "11", *map(str, range(1000 + 5000 * i, 6000 + 5000 * i))]
        ids, start, length = memo.look_up(pa.array([x.encode() for x in some], pa.large_binary()))
        assert ids[start].tolist() == [int(x) for x in some] and (length == 1).all()
        assert len(memo.base.key) <= 50_000 + (1 << 15)


def test_token_files(spark):
    df, rows = table(spark)
    t = library()
    place, manifest = token_files.write_tokens(df, BPE)
    got = token_files.read_tokens(manifest).collect()
    want = collections.Counter((i, *(lambda ids: (len(ids), crc(ids)))(t.encode(x or "", add_special_tokens=False).ids + [0])) for i, x in rows)
    assert collections.Counter((r.doc_id, r.n_tokens, zlib.crc32(r.ids)) for r in got) == want
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == list(itertools.accumulate([0] + [r.n_tokens for r in ordered]))[:-1]
    assert [key(r.doc_id) for r in ordered] == sorted(key(r.doc_id) for r in ordered)
    m = manifest.orderBy("shard").first()
    assert token_files.read_document(m.path, 0).tobytes() == bytes(next(r.ids for r in ordered if r.start == m.start))
    _, none = token_files.write_tokens(spark.createDataFrame([], EMPTY), BPE)
    assert token_files.read_tokens(none).count() == 0


def test_pieces(spark):
    df, rows = table(spark)
    enc = pieces.encode(df, SP)
    back = pieces.decode(enc, SP).collect()
    assert collections.Counter((r.doc_id, r.text) for r in back) == collections.Counter((i, x or "") for i, x in rows)
    p = pieces.Encoder(SP)
    names = pieces.Vocabulary(SP).pieces

    def ids_of(text):
        return next(ids.tolist() for _, ids, _ in p.encode(pa.array([text])))

    def brute(text):
        """Best score by trying every piece at every end."""
        best = [0.0] + [-np.inf] * len(text)
        for end in range(1, len(text) + 1):
            for n in range(1, 17):
                if n <= end and text[end - n : end] in score:
                    best[end] = max(best[end], best[end - n] + score[text[end - n : end]])
            best[end] = max(best[end], best[end - 1] + pieces.UNKNOWN)
        return best[-1]

    score = {k: v[1] for k, v in p.machine.items()}
    byte_ids = set(p.bytes.values())
    for text in ["stone river", "naïve été", "a  b", "moves under, old.", "日本 ① x"]:
        ids = ids_of(text)
        marked = pieces.MARK + text.replace(" ", pieces.MARK)
        unknown = sum(1 for c in marked if c not in score and len(c.encode()) > 1)
        total = sum(score[names[i]] for i in ids if i not in byte_ids) + pieces.UNKNOWN * unknown
        assert total == pytest.approx(brute(marked))
        assert ids == p.best(marked)
    rng = random.Random(6)
    for _ in range(2000):
        text = "".join(rng.choice("ab'sthe.,!\n \t12é二_▁") for _ in range(rng.randrange(1, 30))).replace(pieces.MARK, " ")
        assert ids_of(text) == p.best(pieces.MARK + text.replace(" ", pieces.MARK))
    bad = pieces.decoder(SP).decode(np.array([p.bytes[0xC3], 300]), np.array([0, 1, 1, 2]))
    assert bad.to_pylist()[:2] == ["\ufffd", ""]
    assert pieces.encode(spark.createDataFrame([], EMPTY), SP).count() == 0


def test_packing(spark):
    df, rows = table(spark)
    t = library()
    got = packing.pack(df, BPE).collect()
    pieces_of = collections.defaultdict(list)
    for r in got:
        pieces_of[r.doc_id].append(r)
    for i, own in pieces_of.items():
        whole = collections.Counter(tuple(t.encode(x or "", add_special_tokens=False).ids + [1]) for j, x in rows if j == i)
        if sum(whole.values()) == 1:
            ids = next(iter(whole))
            own.sort(key=lambda r: r.start)
            assert b"".join(r.ids for r in own) == np.array(ids, "<u4").tobytes()
            assert [r.start for r in own] == list(itertools.accumulate([0] + [r.length for r in own]))[:-1]
            assert all(r.doc_tokens == len(ids) for r in own)
    assert sum(r.length for r in got) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in rows)
    for _, own in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        own = list(own)
        assert [r.offset for r in own] == list(itertools.accumulate([0] + [r.length for r in own]))[:-1]
        assert sum(r.length for r in own) <= 2048
    assert packing.pack(spark.createDataFrame([], EMPTY), BPE).count() == 0


@pytest.mark.parametrize("cut", [True, False])
def test_packing_limits(cut):
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 400, 300)
    losses = (sizes * rng.random(300)).astype(int)
    limits = packing.Limits(256, 5, 100, cut=cut)
    bins = packing.place(sizes, losses, limits)
    seen = collections.Counter()
    for own in bins:
        assert sum(n for _, _, n in own) <= 256 and len(own) <= 5
        lossy = sum(max(0, s + n - max(s, sizes[i] - losses[i])) for i, s, n in own)
        assert lossy <= 100
        for i, s, n in own:
            seen.update((i, k) for k in range(s, s + n))
    assert set(seen.values()) == {1} and len(seen) == sizes.sum()


def shingle_set(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def classes(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("block", [2048, 3])
def test_minhash(spark, block, monkeypatch):
    df, rows = table(spark)
    monkeypatch.setattr(minhash, "BLOCK", block)
    got = minhash.near_duplicates(df, 3, 0.85).collect()
    assert len(got) == len(rows)
    sets = {i: shingle_set(x, 3) for i, x in rows if i is not None}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = classes(sets, links)
    assert len(links) > 10
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
        else:
            assert r.component_id is None and r.kept
    assert minhash.near_duplicates(spark.createDataFrame([], EMPTY)).count() == 0


def near_copies(seed):
    rng, rows = random.Random(seed), []
    for _ in range(4):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([6, 12, 40, 100]))]
        for _ in range(30):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 12))):
                w[rng.randrange(len(w))] = f"w{rng.randrange(400)}"
            rows.append((len(rows) + 1, " ".join(w)))
    return rows


@pytest.mark.parametrize("rounds,centres", [(3, 16), (1, 2), (0, 16)])
def test_minhash_near_the_threshold(spark, monkeypatch, rounds, centres):
    """Similarities on both sides of the threshold; with few rounds, most pairs are settled between blocks."""
    monkeypatch.setattr(minhash, "ROUNDS", rounds)
    monkeypatch.setattr(minhash, "CENTRES", centres)
    monkeypatch.setattr(minhash, "BLOCK", 5)
    rows = near_copies(rounds)
    sets = {i: shingle_set(x, 3) for i, x in rows}
    want = classes(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])])
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 0.85).collect()}
    assert got == want and 10 < len(set(want.values())) < len(rows)


@pytest.mark.parametrize("words,n", [(5, 60_000), (12, 20_000)])
def test_minhash_of_many_short_texts_that_differ_in_a_word(spark, words, n):
    same = " ".join(f"word{i}" for i in range(words - 1))
    df = spark.range(n).selectExpr("id doc_id", f"concat('{same} ', id) text").repartition(4)
    got = minhash.near_duplicates(df, 3, 0.85)
    assert got.where("kept").count() == n


def test_registers_estimate_similarity():
    rng = np.random.default_rng(0)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = pool[:2000], pool[400:2400]
    regs = minhash.registers(np.concatenate([a, b, a[:1000], a[1000:]]), np.array([0, 2000, 4000, 5000, 6000]))
    same = (regs[0] == regs[1]).mean()
    assert abs(same - 1600 / 2400) < 0.15
    assert (np.maximum(regs[2], regs[3]) == regs[0]).all()  # mergeable
    one = np.array([1000.0])
    assert minhash.plausible(np.array([1]), np.array([1]), np.array([125]), one, one, 0.85).all()
    assert not minhash.plausible(np.array([50]), np.array([50]), np.array([27]), one, one, 0.85).any()


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(chain, "src long, dst long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


@pytest.mark.parametrize("block,rounds", [(1024, 3), (8, 1), (4, 0)])
def test_embeddings(spark, block, rounds):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 48)))]
    for i in range(120):  # clusters of copies, scaled copies and near copies
        v = np.array(rows[i % 7][1]) * (1 + i % 3)
        rows.append((1000 + i, (v + rng.normal(size=48) * 0.15 * (i % 4)).tolist()))
    odd = [(2000, None), (2001, []), (2002, [0.0] * 48), (2003, [float("nan")] + [1.0] * 47), (2004, [float("inf")] * 48), (2005, [None] + [1.0] * 47), (2006, [1.0] * 7), (2007, [1.0] * 7), (None, rows[0][1]), rows[3]]
    df = spark.createDataFrame([(a, b, 1, b"k") for a, b in rows + odd], "vec_id long, embedding array<double>, label int, key binary")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, block=block, rounds=rounds).collect()}
    good = {a: np.array(b) / np.linalg.norm(b) for a, b in rows + odd[6:8]}
    links = [(a, b) for a, b in itertools.combinations(good, 2) if len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.95]
    assert len(links) > 500
    n = collections.Counter(x for p in links for x in p)
    want = classes(good, links)
    for i in good:
        assert (got[i].n_links, got[i].component_id) == (n[i], want[i])
    for i, _ in odd[:6]:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[None].n_links == 0 and got[None].kept
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_coarse_vectors_lose_no_pair():
    rng = np.random.default_rng(2)
    for dim in (3, 48):
        u = rng.normal(size=(2000, dim))
        w = u + rng.normal(size=u.shape) * rng.random((2000, 1)) * 0.5
        u, w = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (u, w))
        exact = (u * w).sum(1)
        may = embeddings.may_reach(*(pa.array([embeddings.coarse(x) for x in m], pa.binary()) for m in (u, w)), 0.95)
        assert may[exact >= 0.95].all() and not may[exact < 0.85].any()


def test_fingerprints(spark):
    df, rows = table(spark)
    unique = list(dict.fromkeys(rows))
    small = spark.createDataFrame([(i, t, 0, True) for i, t in unique if i is not None], "doc_id long, text string, part int, first_text boolean")
    for parts in ("1", "7", "300"):  # more partitions than rows: some are empty
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r.doc_id: r for r in fingerprints.compare_edited(small).collect()}
        order = sorted([(i, t or "") for i, t in unique if i is not None], reverse=True)
        assert len(got) == len(order)
        prints = collections.defaultdict(set)
        for k, (i, t) in enumerate(order):
            nxt = order[(k + 1) % len(order)][1]
            edited = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
            r = got[i]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            assert (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1.0) and 0 <= r.near_next <= 1
            prints[t].add(r.fingerprint)
        assert all(len(x) == 1 for x in prints.values()) and len({next(iter(x)) for x in prints.values()}) == len(prints)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert fingerprints.compare_edited(df).count() == len(rows)
    assert fingerprints.compare_edited(small.limit(0)).count() == 0
    lone = fingerprints.compare_edited(small.where("doc_id = 1")).collect()
    assert len(lone) == 1 and lone[0].near_next == 1.0


def test_fingerprints_are_homomorphic():
    prints = lambda *t: fingerprints.fingerprint_bytes(*fingerprints.vectors([x.encode() for x in t]))
    a, b, ab, ba = prints("one two three", "four five", "one two three\nfour five", "four five\none two three")
    assert ab == ba == fingerprints.combine(a, b) and fingerprints.combine(ab, b, -1) == a


def test_warc(spark):
    html = ["<p>a</p>", "<p>ä\r\n\r\nb</p>", "", None, "<p>a</p>", "x" * 100000, "", "<p>a</p>"]
    urls = ["http://www.Example.com:80/a?q#f", "https://b.org", None, "", "http://www.example.com/a?q", "http://c.net/\tx", "no-scheme", "http://www.example.com/a?q"]
    rows = [(10 - i, u, h, "d", 0) for i, (u, h) in enumerate(zip(urls, html))] + [(None, "u", "<p>a</p>", "d", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, first int")
    place, captures = warc.write_archives(df)
    directory = warc.write_index(captures, place, lines=2)
    got = sorted(warc.read_archives(directory).collect(), key=lambda r: key(r.page_id))
    first = {}
    for i, _, h, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(h or "", i)
    want = []
    for i, _, h, *_ in sorted(rows, key=lambda r: key(r[0])):
        data, f = (h or "").encode(), first[h or ""]
        want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if f == i else "revisit", None if f == i else f))
    assert [tuple(r) for r in got] == want
    found = warc.look_up(directory, "com,example,www)/a?q")
    assert sorted(x[0]["warc-record-id"] for x in found) == ["<urn:page:10>", "<urn:page:3>", "<urn:page:6>"]
    assert not warc.look_up(directory, "com,nowhere)/")
    place, none = warc.write_archives(df.limit(0))
    assert warc.read_archives(warc.write_index(none, place)).count() == 0


def test_language(spark):
    rng = random.Random(2)
    vocab = {"en": ["the", "and", "with", "thing", "other"], "de": ["der", "und", "nicht", "schön", "über"], "fr": ["le", "être", "nous", "chaque", "où"], "es": ["el", "niño", "señor", "mañana", "pero"]}
    rows = [(i, " ".join(rng.choice(vocab[l]) for _ in range(40)), l, f"host{l}", "x", 0.5) for i, l in enumerate(sorted(vocab) * 30)]
    odd = [(900, None, "en", "hosten", "x", 0.1), (901, "", None, None, "x", 0.1), (902, "1234 %% 99", "de", "q", "x", 0.1), (None, "the and with thing other", None, "hosten", "x", 0.1)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, host string, confidence double")
    names = (fresh("language", df.columns), fresh("confidence", df.columns))
    got = {r.doc_id: r for r in language.of_documents(df, df.columns, names).collect()}
    assert all(got[i].language == l for i, _, l, *_ in rows) and got[5].host == "x" and got[5].confidence == 0.5
    assert got[None].language == "en"
    for i in (900, 901, 902):
        assert got[i].language == "und" and got[i].confidence_ == 0.0
    assert language.of_documents(df.limit(0), ["doc_id"]).count() == 0


def test_quality(spark):
    rng = random.Random(4)
    good, bad = ["river", "stone", "walks", "under", "quiet", "light"], ["%%%", "$$$buy", "click!!", "WIN", "###"]
    rows = [(i, " ".join(rng.choice(good if i % 4 else bad) for _ in range(50)), "a", 1.0) for i in range(400)]
    odd = [(900, None, "a", 1.0), (901, "", "a", 1.0), (None, "river stone", "a", 1.0)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, b string, log_weight double")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, 200)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    weighed = quality.weigh(df, quality.fit(df, quality.clean(labels, 0)), ["doc_id"])
    limit = quality.cut_off(weighed, labels)
    kept = {r.doc_id for r in weighed.where(weighed.gumbel_key >= limit).collect()}
    held_out = [i for i in range(200, 400)]
    assert sum((i in kept) == (i % 4 > 0) for i in held_out) / len(held_out) > 0.9
    values = sorted((r.gumbel_key for r in weighed.collect()), reverse=True)
    for k in (1, 2, 57, len(values)):
        assert quality.kth_largest(weighed, "gumbel_key", k) == values[k - 1]
    assert quality.weigh(df.limit(0), np.zeros(quality.BUCKETS), ["doc_id"]).count() == 0
    assert quality.cut_off(weighed, labels.limit(0)) == float("-inf")


def test_chunks(spark):
    df, rows = table(spark)
    single = [(i, t) for i, t in dict.fromkeys(rows) if i is not None]
    df = spark.createDataFrame([(i, t, 9, 9) for i, t in single], "doc_id long, text string, n_chars long, _cuts long")
    spans = chunks.repeated_spans(df)
    found = collections.defaultdict(list)
    for r in spans.collect():
        found[r.doc_id].append((r.start, r.stop))
    first, n = {}, 0
    for i, t in sorted(single):
        w = [m.span() for m in re.finditer("[^\x20\x09-\x0d]+", t or "")]
        for k in range(len(w) - 50):
            a, b = w[k][0], w[k + 50][1]
            if first.setdefault(t[a:b], (i, k)) != (i, k):
                a, b, n = len(t[:a].encode()), len(t[:b].encode()), n + 1
                assert any(x < b and y > a for x, y in found[i]), (i, a)
    assert n > 100
    clean = [i for i, t in single if t and "edit" not in t and len(t) < 3000 and i > 60]
    assert not found[13] and len(clean) > 0
    cut = {r.doc_id: r for r in chunks.remove_spans(df, spans).collect()}
    assert len(cut) == len(single) and cut[13].text == dict(single)[13] and cut[13]._cuts == 9
    assert not chunks.repeated_spans(chunks.remove_spans(df, spans)).where("n_words > 50").count()
    assert chunks.repeated_spans(df.limit(0)).count() == 0


def test_cuts_do_not_depend_on_neighbours():
    rng = random.Random(8)
    a, b = prose(rng, 200), prose(rng, 300)

    def ends(texts):
        arr = pa.array(texts)
        from netlens.llm.hashing import text_bytes

        data, offsets = text_bytes(arr)
        first, _, own, starts, _ = chunks.cut(data, offsets)
        return {i: (starts[first[own == i]] - offsets[i]).tolist() for i in range(len(texts))}

    assert ends([a, b])[1] == ends([b])[0]
    gap = np.diff(ends([b])[0])
    assert len(gap) > 20
