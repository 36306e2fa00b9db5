import random

from pyspark.sql import functions as F

from gridspark.llm import langid
from gridspark.llm.queries import QUERIES


def longest_match_phrases(text, known):
    """Greedy parse into longest substrings of ``known``; a character that it lacks is a phrase."""
    n, i = 0, 0
    while i < len(text):
        j = i
        while j < len(text) and text[i : j + 1] in known:
            j += 1
        i = max(j, i + 1)
        n += 1
    return n


def test_phrases_against_substring_search():
    rng = random.Random(3)
    known = {"x": "".join(rng.choices("abc ", k=300)), "y": "".join(rng.choices("bcd ", k=200))}
    model = langid.Model(known)
    texts = ["".join(rng.choices("abcde ", k=rng.randrange(1, 400))) for _ in range(30)]
    got = model.phrases(texts)
    for t, row in zip(texts, got, strict=True):
        for j, name in enumerate(model.languages):
            assert row[j] == longest_match_phrases(t, known[name])


def test_phrases_go_on_across_segments():
    rng = random.Random(9)
    known = {"x": "".join(rng.choices("ab", k=400)) + "a" * 9 + "b", "y": "".join(rng.choices("abc ", k=600)), "z": "the cat sat on the mat " * 20}
    model = langid.Model(known)
    cut = langid.SEGMENT
    texts = ["".join(rng.choices("abcd ", k=n)) for n in (cut - 1, cut, cut + 1, 2 * cut, 5 * cut + 7, 9_000)]
    texts += ["a" * 6_000, "ab" * 2_500, known["z"] * 6, known["x"] * 9, "", "q" * 3 * cut, "a" * (cut - 1) + "q" + "b" * cut]
    got = model.phrases(texts)
    for t, row in zip(texts, got, strict=True):
        assert [longest_match_phrases(t, known[name]) for name in model.languages] == row.tolist()


def test_a_repeated_id_does_not_widen_the_sample(spark):
    docs = spark.createDataFrame([(1, f"words of one language number {i}", "en") for i in range(500)] + [(2, "mots d'une autre langue", "fr")], "doc_id long, text string, lang string")
    found = langid.samples(docs, id_col="doc_id", text_col="text", lang_col="lang", where=F.lit(True))
    assert set(found) == {"en", "fr"} and found["en"].count("number") == langid.SAMPLE_DOCS


def test_held_out_accuracy(spark, tiny):
    rows = QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.95 * len(rows)


def test_awkward_and_empty_tables(awkward, no_documents):
    got = langid.identify(awkward, train=F.lit(True)).collect()
    assert len(got) == awkward.count()
    by = {r["doc_id"]: r for r in got}
    for i in (1, 2, 3, 10):
        assert (by[i]["lang_pred"], by[i]["score"]) == ("und", 0.0)
    assert by[6]["lang_pred"] == "en" and all(0 <= r["score"] <= 1 for r in got)
    assert langid.identify(no_documents, train=F.lit(True)).count() == 0
    assert {r["lang_pred"] for r in langid.identify(awkward, train=F.lit(False)).collect()} == {"und"}
