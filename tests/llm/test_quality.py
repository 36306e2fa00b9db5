import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from gridspark.llm import quality as q

LABELS = "doc_id long, quality int, toxic int"


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    hit = {j for i, w in enumerate(windows) if w in twice for j in range(i, i + 8)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def figures(r):
    return r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]


def test_base_figures_of_every_document(spark, documents, texts, tiny):
    got = q.quality(documents, spark.read.parquet(f"{tiny}/labels.parquet")).collect()
    assert len(got) == len(texts)
    for r in got:
        want = base(texts[r["doc_id"]])
        assert figures(r) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_score_is_the_mean_log_ratio_of_hashed_grams():
    texts = [b"good words come here", b"bad bad bad", b""]
    raw, target = np.zeros(q.BUCKETS), np.zeros(q.BUCKETS)
    per = []
    for k, t in enumerate(texts):
        words = q.Words([t], q.SPACE_WORDS, False)
        _, bucket = q._buckets(words)
        per.append(bucket)
        np.add.at(raw, bucket, 1)
        if k == 0:
            np.add.at(target, bucket, 1)
    llr = q.weights(raw, target)
    got = q.scores(texts, llr)
    for k, bucket in enumerate(per):
        want = sum(math.log((target[b] + 1) / (target.sum() + q.BUCKETS)) - math.log((raw[b] + 1) / (raw.sum() + q.BUCKETS)) for b in bucket) / max(len(bucket), 1)
        assert abs(got[k] - want) < 1e-9
    assert got[0] > got[1]


def test_labels_are_told_apart(spark, documents, tiny):
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    rows = q.quality(documents, labels).join(labels, "doc_id").where("quality in (0, 1)").collect()
    right = sum((r["kept"]) == (r["quality"] == 1) for r in rows)
    assert right >= 0.75 * len(rows)


def test_awkward_and_empty_tables(spark, awkward, no_documents):
    none = spark.createDataFrame([], LABELS)
    some = spark.createDataFrame([(5, 1, 0), (8, 0, 0), (8, 1, 0), (None, 1, 0), (5, None, None), (77, 1, 1)], LABELS)
    for labels in (none, some):
        got = q.quality(awkward, labels).collect()
        assert len(got) == awkward.count()
        known = {r["doc_id"]: r["text"] for r in awkward.collect() if r["doc_id"] is not None}
        assert all(figures(r) == base(known[r["doc_id"]]) for r in got if r["doc_id"] is not None)
        assert q.quality(no_documents, labels).count() == 0
        kept = q.filter_quality(awkward, labels)
        assert kept.columns == awkward.columns
        assert kept.count() == sum(r["kept"] for r in got)


def test_filter_agrees_with_the_report(spark, documents, tiny):
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    want = {r["doc_id"] for r in q.quality(documents, labels).where("kept").collect()}
    assert {r["doc_id"] for r in q.filter_quality(documents, labels).select(F.col("doc_id")).collect()} == want


def test_other_names_of_columns(spark, documents, tiny):
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    want = {(r["doc_id"], r["score"], r["kept"]) for r in q.quality(documents, labels).collect()}
    renamed = documents.withColumnRenamed("doc_id", "k").withColumnRenamed("text", "t")
    got = q.quality(renamed, labels.withColumnRenamed("doc_id", "k"), id_col="k", text_col="t").collect()
    assert {(r["doc_id"], r["score"], r["kept"]) for r in got} == want


def test_all_labels_count_however_many(spark, documents, tiny, monkeypatch):
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    # Labels of unknown documents are no part of any share of the known ones.
    many = labels.select("doc_id", "quality").union(spark.range(10**9, 10**9 + 250_000).selectExpr("id", "1"))
    want = sorted(q.quality(documents, labels).collect())
    assert sorted(q.quality(documents, many).collect()) == want
    monkeypatch.setattr(q, "BROADCAST_LABELS", 0)
    assert sorted(q.quality(documents, labels).collect()) == want
    joined = q.labelled(documents, labels)
    assert joined.count() == documents.join(labels.where("quality in (0, 1)").select("doc_id").distinct(), "doc_id").count()
