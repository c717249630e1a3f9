"""Language labels in any spelling, of any length and number; no language is too rare."""

import random

import pytest

from netlens.llm import language

VOCAB = {"en": ["the", "and", "with", "thing", "other"], "de": ["der", "und", "nicht", "schön", "über"], "pt": ["não", "coração", "você", "muito", "então"], "fr": ["le", "être", "nous", "chaque", "où"]}
SPELT = {"en": ["EN", "en-US", " en_GB", "en"], "de": ["DE", "de-AT", "de"], "pt": ["pt-BR", "PT"], "fr": ["fr"]}


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_spelling_and_rare_languages(spark):
    rng, rows, true = random.Random(3), [], {}
    for i in range(600):
        code = ["en", "de", "pt"][i % 3]
        true[i] = code
        rows.append((i, " ".join(rng.choice(VOCAB[code]) for _ in range(30)), rng.choice(SPELT[code]), f"h{i % 5}"))
    for i in range(600, 603):
        true[i] = "fr"
        rows.append((i, " ".join(rng.choice(VOCAB["fr"]) for _ in range(30)), "fr", "h0"))
    rows += [(700, "the and with thing other the and", None, "h1"), (701, "der und nicht schön über der", "und", "h1"), (702, "le être nous chaque où le être nous", "", "h1"), (703, "1 2 3", "EN", "h1")]
    true |= {700: "en", 701: "de", 702: "fr", 703: "und"}
    df = table(spark, rows)
    assert language.languages_of(df, "lang") == ["de", "en", "fr", "pt"]
    assert {r.doc_id: r.language for r in language.of_documents(df, ["doc_id"]).collect()} == true
    assert language.languages_of(table(spark, []), "lang") == []


def test_one_document_of_a_language(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(VOCAB["en"]) for _ in range(30)), "en", "h") for i in range(1500)]
    rows.append((9999, " ".join(rng.choice(VOCAB["fr"]) for _ in range(30)), "fr", "h"))
    got = {r.doc_id: r for r in language.of_documents(table(spark, rows), ["doc_id"]).collect()}
    assert got[9999].language == "fr" and got[9999].confidence > 0.5
    assert sum(r.language == "en" for r in got.values()) == 1500


def test_many_languages_and_long_names(spark):
    rng, rows, true = random.Random(5), [], {}
    letters = "abcdefghijklmnopqrstuvwxyz"
    for k in range(65):
        words = ["".join(rng.choice(letters) for _ in range(6)) for _ in range(8)]
        name = "".join(rng.choice(letters) for _ in range(2 + k % 7)) + letters[k % 26]
        for i in range(4):
            true[k * 10 + i] = name
            rows.append((k * 10 + i, " ".join(rng.choice(words) for _ in range(30)), name.upper(), "h"))
    df = table(spark, rows)
    assert len(set(true.values())) == 65
    assert {r.doc_id: r.language for r in language.of_documents(df, ["doc_id"]).collect()} == true
    with pytest.raises(ValueError, match="64 languages"):
        language.languages_of(df, "lang", most=64)
