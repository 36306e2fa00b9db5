import random
import re
from collections import Counter

import pytest

from gridspark.llm import phrases as p

SCHEMA = "doc_id long, text string, lang string, block long, seq string, no int, n long, id long, word string, rank int, f long"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(docs, least=30, top=2000, contained=80):
    counts, total = {}, Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                counts.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        cands = {g: a for g, a in f.items() if len(g) > 1 and a >= least}
        longer = {}
        for g, a in cands.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    longer[g[i : i + k]] = max(longer.get(g[i : i + k], 0), a)
        rows = []
        for g, a in cands.items():
            if 100 * longer.get(g, -1) >= contained * a:
                continue
            score, _, left, right = min((2_000_000 * a // (f[g[:c]] + f[g[c:]]), c, f[g[:c]], f[g[c:]]) for c in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), left, right))
        for rank, (s, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


def got(df, **how):
    found = p.collocations(df, **how)
    assert found.columns == COLUMNS
    return sorted(tuple(r) for r in found.collect())


def made(rng, n):
    words = ["a", "B", "of", "the", "ça", "日本", "x#", "\U0001f600", "Q"]
    return "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", " ;"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    out = [(made(rng, rng.randrange(0, 120)), rng.choice(["en", "de", None])) for _ in range(60)]
    return out + [(None, "en"), ("", None), (" \t\n", "xx"), ("no match here", "fr"), ("a a a a a a a", "en"), *[("the hot line of all", "en")] * 40, (made(rng, 4000), "en"), ("one piece " * 500, "de")]


def test_equals_brute_force(spark, rows, monkeypatch):
    df = spark.createDataFrame([(i, t, lang, 1, "s", 2, 3, 4, "w", 5, 6) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    assert got(df) == brute(rows)
    assert got(df, least=5, top=7, block=300) == brute(rows, least=5, top=7)
    monkeypatch.setattr(p, "SENT", 0)  # names meet blocks by a shuffle
    assert got(df, block=2000) == brute(rows)


def test_long_texts_are_cut_at_marks_only():
    text = b"aa bb. cc dd, " * 50 + b"e " * 200 + b"; f g"
    parts = list(p._cut(text, 64))
    assert b"".join(parts) == text
    assert all(part[-1] in p._MARKS for part in parts[:-1])
    assert list(p._cut(b"", 10)) == [b""]
    assert list(p._cut(b"x" * 30, 10)) == [b"x" * 30]


def test_awkward_and_empty_tables(spark, awkward, no_documents):
    known = [(r["text"], r["lang"]) for r in awkward.collect()]
    assert got(awkward, least=2) == brute(known, least=2)
    assert got(no_documents) == []
    assert got(awkward.where("text is null")) == []


def test_scores_past_64_bits(spark):
    level = spark.createDataFrame([(0, "en", "x y", 2**61, [2**61, 2**61], [2**62, 2**61])], "id long, lang string, phrase string, f long, heads array<long>, tails array<long>")
    r = p._scored(level, 2, None, 80).first()
    assert r["score"] == 2_000_000 * 2**61 // (2**61 + 2**62)
    longer = spark.createDataFrame([(0, 9, 2**61 * 8 // 10 + 1)], "left long, right long, f long")
    assert p._scored(level, 2, longer, 80).count() == 0
    assert p._scored(level, 2, longer.selectExpr("left", "right", "f - 2 as f"), 80).count() == 1


def test_whole_table(spark, documents):
    assert got(documents) == brute([(r["text"], r["lang"]) for r in documents.collect()])
