import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.llm import subwords as s
from gridspark.llm._text import SPACE_WORDS, Words, mix

LABELS = "doc_id long, quality int, toxic int"


def features(text):
    """The buckets of a text, one for each feature, in plain loops."""
    out, before = [], None
    for w in re.findall(r"[^\x20\x09-\x0D]+", text):
        own = [int(mix(Words([w.encode()], SPACE_WORDS, False).hash)[0] % np.uint64(s.BUCKETS))]
        marked = f"<{w}>"
        for n in s.GRAMS:
            for i in range(len(marked) - n + 1):
                h = n
                for c in marked[i : i + n]:
                    h = (h * int(s._P) + ord(c) + 1) % 2**64
                own.append(int(mix(np.array([h], np.uint64))[0] % np.uint64(s.BUCKETS)))
        out += [s._TWICE] * len(own) if w == before else own
        before = w
    return out


@pytest.fixture(scope="module")
def model():
    rng = np.random.default_rng(1)
    return s.Model(rng.normal(size=(s.BUCKETS, s.SIZE)), rng.normal(size=(s.SIZE, 2)), rng.normal(size=2))


TEXTS = ["one two two two one", "ça 日本語 \U0001f600 é", "", " \t\n", "x", "x" * 4000, "a\tb\nc a a", "!!! $$$ $$$"]


def test_scores_equal_brute_force(model):
    got = model.scores([t.encode() for t in TEXTS])
    for text, score in zip(TEXTS, got, strict=True):
        own = features(text)
        mean = model.vectors[own].mean(0) if own else np.zeros(s.SIZE)
        logits = mean @ model.weights + model.bias
        assert abs(score - np.exp(logits[1]) / np.exp(logits).sum()) < 2e-6


def test_bags_equal_brute_force():
    for text, (held, share) in zip(TEXTS, s.bags([t.encode() for t in TEXTS]), strict=True):
        own = features(text)
        assert dict(zip(held.tolist(), share, strict=True)) == pytest.approx({b: own.count(b) / len(own) for b in own})


def test_scores_do_not_depend_on_neighbours(model):
    texts = [t.encode() for t in TEXTS]
    assert [model.scores([t])[0] for t in texts] == model.scores(texts).tolist() == model.scores(texts[::-1])[::-1].tolist()


def test_gradient_step_lowers_the_loss():
    texts, classes = [b"good words here", b"bad junk there"] * 20, np.array([1, 0] * 20)
    got = s.trained(texts, classes).scores([b"good words here", b"bad junk there"])
    assert got[0] > 0.9 and got[1] < 0.1
    again = s.trained(texts, classes).scores([b"good words here", b"bad junk there"])
    assert got.tolist() == again.tolist()


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    rows = s.scored(docs, s.fitted(docs, labels, learn=fold != 1)).join(labels, "doc_id").where(fold == 1).collect()
    for c in (0, 1):
        own = [r["predicted"] == c for r in rows if r["quality"] == c]
        assert sum(own) >= 0.9 * len(own)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows)


def test_held_out_labels_teach_nothing(spark, documents, tiny):
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    turned = labels.withColumn("quality", F.when(fold == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (s.sample(documents, x, learn=fold != 1) for x in (labels, turned))
    assert a[0] == b[0] and a[1].tolist() == b[1].tolist() and len(a[0])


def test_the_sample_is_bounded(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i % 50, "w " * rng.randrange(1, 40)) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(3, 0, 0), (None, 1, 0), (4, None, 0), (5, 7, 0)], LABELS)
    texts, classes = s.sample(docs, labels, most=7, longest=60)
    assert len(texts) <= 14 and max(map(len, texts)) <= 60 and set(classes) == {0, 1}


def test_awkward_and_empty_tables(spark, awkward, no_documents):
    some = spark.createDataFrame([(5, 1, 0), (8, 0, 0), (8, 1, 0), (None, 1, 0), (5, None, None), (77, 1, 1)], LABELS)
    for labels in (spark.createDataFrame([], LABELS), some, some.where("quality = 1")):
        found = s.scored(awkward, s.fitted(awkward, labels))
        assert found.columns == ["doc_id", "score", "predicted"]
        rows = found.collect()
        assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in awkward.collect())
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
        assert s.scored(no_documents, s.fitted(no_documents, labels)).count() == 0


def test_words_are_looked_up_in_parts(model, monkeypatch):
    texts = [t.encode() for t in TEXTS] + [" ".join(f"w{i} é{i * 7}" for i in range(300)).encode()]
    want = model.scores(texts).tolist()
    monkeypatch.setattr(s, "_CHARS", 20)
    assert model.scores(texts).tolist() == want
