import random
import re

import numpy as np

from gridspark.llm import dartminhash as dm


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(texts):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            common = len(sets[i] & sets[j])
            if common and common >= 0.8 * (len(sets[i]) + len(sets[j]) - common):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_agreement_is_the_weighted_similarity():
    rng = np.random.default_rng(0)
    gaps = []
    for _ in range(20):
        h = rng.integers(1, 2**63, 200).astype(np.uint64)
        a = rng.uniform(0.2, 3, 200)
        b = np.concatenate((a[:120], a[120:] * 0.4))
        s = dm.dart_signatures(np.repeat([0, 1], 200), np.concatenate((h, h)), np.concatenate((a, b)), 2, 192)
        assert (s > 0).all()
        gaps.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(gaps)) < 0.03


def test_classes_of_the_table_against_brute_force(documents, texts):
    got = {r["doc_id"]: r["class_id"] for r in dm.near_duplicates(documents).collect()}
    assert got == brute_classes(texts)


def test_a_large_group_of_edited_copies(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = {}
    for g in range(2):
        source = rng.choices(words, k=200)
        for _ in range(150):
            rate = rng.uniform(0, 0.06)
            texts[len(texts)] = " ".join(rng.choice(words) if rng.random() < rate else w for w in source)
    for _ in range(60):
        texts[len(texts)] = " ".join(rng.choices(words, k=rng.randrange(40)))
    got = {r["doc_id"]: r["class_id"] for r in dm.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == brute_classes(texts)


def form_letters(rng, pairs, body=100, own=14, shared=3):
    """Letters with one common body, too different to be linked but for each one and its neighbour."""
    common = [f"c{i}" for i in range(body)]
    texts = {}
    for _ in range(pairs):
        both = [rng.choice("xyz") + str(rng.random()) for _ in range(shared)]
        for _ in range(2):
            texts[len(texts)] = " ".join([*common, *both, *(str(rng.random()) for _ in range(own - shared))])
    return texts


def test_pairs_of_form_letters_meet_in_large_buckets(spark):
    texts = form_letters(random.Random(3), 150)
    want = brute_classes(texts)
    assert len(set(want.values())) == 150
    got = {r["doc_id"]: r["class_id"] for r in dm.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == want


def test_texts_and_their_loops(spark):
    rng = random.Random(4)
    texts = {}
    for _ in range(40):
        once = " ".join(str(rng.random()) for _ in range(100))
        texts |= {len(texts): once, len(texts) + 1: " ".join([once] * 200)}
    got = {r["doc_id"]: r["class_id"] for r in dm.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in texts}


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(0, 40)]
    star = [(100, i) for i in range(101, 130)]
    got = {r["node"]: r["root"] for r in dm.components(spark.createDataFrame(path + star + path[:3], "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 130)}}


def test_awkward_and_empty_tables(awkward, no_documents):
    rows = dm.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    by = {r["doc_id"]: r["class_id"] for r in rows}
    assert by[11] == 5 and by[5] == 5 and by[None] is None
    assert all(by[i] == i for i in (1, 2, 3, 4, 6, 7, 8, 9, 10))
    assert dm.near_duplicates(no_documents).count() == 0
    kept = dm.first_of_class(awkward)
    assert set(kept.columns) == set(awkward.columns)
    ids = [r["doc_id"] for r in kept.collect()]
    assert 11 not in ids and ids.count(5) == 1 and kept.count() == awkward.count() - 2  # a copy and a repeated row go


def test_equal_ids_with_different_texts_share_a_class(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = spark.createDataFrame([(1, a), (2, b), (3, a), (3, b), (4, c)], "doc_id long, text string")
    assert {(r["doc_id"], r["class_id"]) for r in dm.near_duplicates(docs).collect()} == {(1, 1), (2, 1), (3, 1), (4, 4)}


def test_repeated_rows_are_compared_once(spark, documents, monkeypatch):
    """A table that is there three times over, ids and all: a pair of ids is one pair of texts, not nine."""
    met, plain = [], dm.verified

    def counted(pairs, texts):
        met.append((pairs.count(), pairs.join(texts.toDF("u", "tu"), "u").join(texts.toDF("v", "tv"), "v").count()))
        return plain(pairs, texts)

    monkeypatch.setattr(dm, "verified", counted)
    want = {(r["id"], r["class_id"]) for r in dm.classes(documents).collect()}
    once, met[:] = list(met), []
    assert {(r["id"], r["class_id"]) for r in dm.classes(documents.union(documents).union(documents)).collect()} == want
    assert once and met == once


def test_one_of_repeated_rows_is_kept(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    docs = spark.createDataFrame([(1, a, "x"), (1, a, "y"), (1, a, "x"), (2, a, "z"), (3, b, "z"), (3, b, "z"), (4, None, "n"), (4, None, "n"), (None, b, "q"), (None, b, "q")], "doc_id long, text string, source string")
    got = sorted((r["doc_id"] or 0, r["kept"]) for r in dm.near_duplicates(docs).collect())
    assert got == [(0, True), (0, True), (1, False), (1, False), (1, True), (2, False), (3, False), (3, True), (4, False), (4, True)]
    left = dm.first_of_class(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["source"]) for r in left.collect()) == [(0, "q"), (0, "q"), (1, "x"), (3, "z"), (4, "n")]


def test_former_texts_link_what_was_cut(spark):
    rng = random.Random(7)
    source = [str(rng.random()) for _ in range(100)]
    near = [*source[:50], "other", *source[51:]]
    came = {1: " ".join(source), 2: " ".join(near), 3: " ".join(str(rng.random()) for _ in range(60)), 4: " ".join(source), 5: "left over"}
    now = came | {1: "left over", 2: " ".join(near), 4: " ".join(source[:9])}
    frame = lambda t: spark.createDataFrame(list(t.items()), "doc_id long, text string")
    # 1, 2 and 4 came as near copies, 1 and 5 are copies now; the longest of them stays.
    assert sorted(r["doc_id"] for r in dm.first_of_class(frame(now), more=frame(came)).collect()) == [2, 3]
    assert sorted(r["doc_id"] for r in dm.first_of_class(frame(now)).collect()) == [1, 2, 3, 4]
