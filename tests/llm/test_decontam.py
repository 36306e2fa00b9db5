import hashlib
import random
import re

import numpy as np

from gridspark.llm import decontam
from gridspark.llm._text import ALNUM_WORDS, Words
from gridspark.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        own = words(t)
        size = min(10, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(w) - size + 1 if own else 0):
            if tuple(w[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_whole_table_against_brute_force(spark, documents, texts, tiny):
    bench = spark.read.parquet(f"{tiny}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    got = decontam.contamination(documents, bench).collect()
    assert len(got) == len(texts) and any(r["n_hit"] for r in got)
    for r in got:
        assert (r["n_words"], r["n_hit"], r["items"]) == brute(texts[r["doc_id"]], items)


def test_random_short_alphabet(spark):
    rng = random.Random(2)
    make = lambda n: " ".join(rng.choice("abC") for _ in range(n))
    items = [(i, make(rng.randrange(0, 14))) for i in range(12)] + [(98, None), (99, "a b")]
    docs = [(i, make(rng.randrange(0, 120))) for i in range(40)] + [(50, None)]
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS)).collect()
    known = dict(docs)
    for r in got:
        assert (r["n_words"], r["n_hit"], r["items"]) == brute(known[r["doc_id"]], items)


def test_wavelet_ranks_and_located_places():
    rng = np.random.default_rng(1)
    sequence = rng.integers(0, 5, 400)
    tree = decontam.WaveletTree(sequence, 3)
    at = np.arange(401)
    for c in range(5):
        assert (tree.rank(np.full(401, c), at) == np.concatenate(([0], np.cumsum(sequence == c)))).all()
    index = decontam.FMIndex(sequence, 5)
    pattern = sequence[100:104]
    low, high = index.search(pattern[None])
    found = sorted(index.locate(np.arange(low[0], high[0])).tolist())
    assert found == [i for i in range(397) if (sequence[i : i + 4] == pattern).all()]


def test_cut_texts_hold_no_window(spark, documents, tiny):
    bench = spark.read.parquet(f"{tiny}/benchmark.parquet")
    clean = decontam.decontaminated(documents, bench)
    assert clean.columns == documents.columns
    assert decontam.contamination(clean, bench).where("n_hit > 0").count() == 0
    untouched = {r["doc_id"] for r in decontam.contamination(documents, bench).where("n_hit = 0").collect()}
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (documents, clean))
    assert all(after[i] == before[i] for i in untouched)


def test_awkward_and_empty_tables(spark, awkward, no_documents):
    bench = spark.createDataFrame([(1, "same line here again"), (2, None), (None, "one"), (3, "")], ITEMS)
    none = spark.createDataFrame([], ITEMS)
    got = decontam.contamination(awkward, bench).collect()
    assert len(got) == awkward.count()
    assert {r["doc_id"] for r in got if r["n_hit"]} == {8}
    assert decontam.contamination(awkward, none).where("n_hit > 0").count() == 0
    assert decontam.contamination(no_documents, bench).count() == 0
    left = decontam.decontaminated(awkward, bench)
    assert left.count() == awkward.count() - 1 and decontam.decontaminated(awkward, none).count() == awkward.count()


def test_parts_in_turns_equal_one_part(spark, awkward, monkeypatch):
    rng = random.Random(5)
    make = lambda n: " ".join(rng.choice(["a", "bé", "C"]) for _ in range(n))
    items = [(i, make(rng.randrange(0, 14))) for i in range(30)] + [(31, "same line here again"), (31, "one"), (32, None), (0, "a bé")] * 2
    docs = [(i, make(rng.randrange(0, 120)) + "." * (i % 3), i, "x") for i in range(40)] + [(50, None, None, None), (51, "", 0, ""), (52, "tail. " + make(20) + " 日本", 1, None)]
    bench = spark.createDataFrame(items, ITEMS)
    tables = [spark.createDataFrame(docs, "doc_id long, text string, n_chars int, _found string"), awkward]

    def both():
        return [[sorted(map(str, f(t, bench).collect())) for f in (decontam.contamination, decontam.decontaminated)] for t in tables]

    one = both()
    monkeypatch.setattr(decontam, "PART_CHARS", 100)
    assert len(list(decontam._parts(bench, "item_id", "text"))) > 3
    assert both() == one
    known = {r[0]: r[1] for r in docs}
    for r in decontam.contamination(tables[0], bench).collect():
        assert (r["n_words"], r["n_hit"], r["items"]) == brute(known[r["doc_id"]], [(i, t) for i, t in items if t])


def test_query_digests_against_brute_force(spark, tiny):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    got = QUERIES["op4_decontamination"](spark, tiny).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        n_words, n_hit, found = brute(docs[r["doc_id"]], items)
        want = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n_words, n_hit, len(found), want, n_hit > 0)


def test_words_follow_the_contract():
    for t in ("Ab9,c-d\xa0É x", "", "_a_`b`{c}", "日本 語"):
        w = Words([t.encode()], ALNUM_WORDS, True)
        assert len(w) == len(words(t))
