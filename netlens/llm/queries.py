"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import alignment, chunks, embeddings, fingerprints, language, minhash, mixing, packing, phrases, pieces, quality, token_files, warc

QUERIES = {
    "op1_token_files": token_files.query,
    "op2_embeddings": embeddings.query,
    "op3_sentencepiece": pieces.query,
    "op4_packing": packing.query,
    "op5_minhash": minhash.query,
    "op6_quality": quality.query,
    "op7_fingerprints": fingerprints.query,
    "op8_warc": warc.query,
    "op9_language": language.query,
    "op10_chunks": chunks.query,
    "op11_alignment": alignment.query,
    "op12_mixing": mixing.query,
    "op13_phrases": phrases.query,
    "page_language": language.pages_query,
    "packed_conversations": packing.conversations_query,
}


def _components(rounds: int = 12) -> str:
    """CTEs from nodes(id) and both(src, dst) to comp(id, component): the smallest label among neighbours, again and again."""
    out = ", l0 AS MATERIALIZED (SELECT id, id AS c FROM nodes)"
    for i in range(rounds):
        out += f", l{i + 1} AS MATERIALIZED (SELECT id, least(l.c, coalesce(x.c, l.c)) AS c FROM l{i} l LEFT JOIN (SELECT src AS id, min(k.c) AS c FROM both_ways JOIN l{i} k ON k.id = dst GROUP BY 1) x USING (id))"
    return out + f", comp AS (SELECT id, c AS component FROM l{rounds})"


_VECTORS = (
    "WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT id, list_transform(v, lambda y: y / sqrt(list_dot_product(v, v))) AS v FROM e), nodes AS (SELECT id FROM e),"
    " both_ways AS MATERIALIZED (SELECT a.id AS src, b.id AS dst FROM u a JOIN u b ON a.id <> b.id AND list_dot_product(a.v, b.v) >= 0.95)"
    + _components()
    + " SELECT id AS vec_id, (SELECT count(*) FROM both_ways WHERE src = id) AS n_links, component AS component_id, id = component AS kept FROM comp"
)

_TEXTS = (
    "WITH w AS (SELECT doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents), nodes AS (SELECT id FROM w),"
    " s AS MATERIALIZED (SELECT DISTINCT id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS x FROM w),"
    " n AS (SELECT id, count(*) AS n FROM s GROUP BY 1), i AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.id < b.id GROUP BY 1, 2),"
    " p AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE 100 * k >= 85 * (x.n + y.n - k)), both_ways AS (SELECT a AS src, b AS dst FROM p UNION ALL SELECT b, a FROM p)"
    + _components()
    + " SELECT c.id AS doc_id, coalesce(n.n, 0) AS n_shingles, component AS component_id, c.id = component AS kept FROM comp c LEFT JOIN n ON n.id = c.id"
)

_PAGES = """WITH h AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT h, min(page_id) AS f FROM h GROUP BY 1)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h.h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), '') AS payload_digest,
 CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM h JOIN f ON f.h = h.h"""

_PHRASES = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p), g AS (SELECT lang, 1 AS k, unnest(w) AS phrase FROM w
 UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS n FROM g GROUP BY ALL), t AS (SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS MATERIALIZED (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND n >= 10),
x AS (SELECT lang, k, phrase, a, 1 AS cut, w[1] AS lp, array_to_string(w[2:], ' ') AS rp FROM c UNION ALL SELECT lang, k, phrase, a, 2, w[1] || ' ' || w[2], w[3] FROM c WHERE k = 3),
s AS (SELECT x.*, l.n AS l, r.n AS r, CAST(1000000::HUGEINT * a * a // (l.n::HUGEINT * r.n) AS BIGINT) AS score FROM x JOIN f l ON l.lang = x.lang AND l.phrase = lp JOIN f r ON r.lang = x.lang AND r.phrase = rp),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
d AS (SELECT lang, part, max(a) AS longer FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS part FROM c WHERE k = 3) GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n, score FROM b JOIN t ON t.lang = b.lang LEFT JOIN d ON d.lang = b.lang AND d.part = phrase WHERE longer IS NULL OR 100 * longer < 50 * a QUALIFY rank <= 2000"""

#: Of the other operators SQL cannot express the vocabularies, models, sketches or chunk cuts; tests/llm holds them against brute force.
SQL: dict[str, str] = {"op2_embeddings": _VECTORS, "op5_minhash": _TEXTS, "op8_warc": _PAGES, "op13_phrases": _PHRASES}
