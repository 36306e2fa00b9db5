"""Each stage takes effect on what the one before it kept."""

import corpus_pipeline as cp
from gridspark.llm import dartminhash, decontam, linedup


def test_stages(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in cp.STAGES:
        docs = cp.saved(stage(spark, docs, tiny), name)
        seen.append(docs)
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "line_dedup", "minhash_dedup", "benchmark_decontamination", "sentencepiece"]
    assert all(d.columns == columns for d in seen[:-1])
    counts = [d.count() for d in seen]
    assert counts[0] > counts[1] >= counts[2] >= counts[3] >= counts[4] == counts[5] > 0.4 * counts[0]
    assert dartminhash.near_duplicates(seen[3]).where("not kept").count() == 0
    assert decontam.contamination(seen[4], spark.read.parquet(f"{tiny}/benchmark.parquet")).where("n_hit > 0").count() == 0
    want = {r["doc_id"]: tuple(r) for r in seen[-1].collect()}
    assert {r["doc_id"]: tuple(r) for r in cp.run(spark, tiny).collect()} == want


def test_empty_documents(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        docs = cp.saved(stage(spark, docs, tiny), name)
    assert docs.count() == 0


def test_copies_go_with_their_lines(spark):
    """No recurring line is left; of nearly all classes of near copies that the quality rules keep, one document is left, and none is a scrap of a copy."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = cp.saved(cp.keep_quality(spark, docs, sf), "good")
    classes = dartminhash.classes(good).toDF("doc_id", "class_id")
    lines = cp.saved(cp.drop_lines(spark, good, sf), "lines")
    assert linedup.line_report(lines).where("n_dropped > 0").count() == 0
    left = cp.keep_first(spark, lines, sf)
    found = left.join(classes, "doc_id").groupBy("class_id").count()
    several = classes.groupBy("class_id").count().where("count > 1").count()
    assert several > 20 and found.where("count > 1").count() <= 0.05 * several
    assert found.count() > 0.95 * classes.select("class_id").distinct().count()
    # What lost over half of its text and stays has no near copy that stays: it held passages of several documents.
    cut = left.join(good.select("doc_id", good["text"].alias("came")), "doc_id").where("length(text) < length(came) / 2")
    assert cut.join(classes, "doc_id").join(found.where("count > 1"), "class_id").count() == 0


def test_awkward_rows_through_all_stages(spark, tiny, awkward, tmp_path):
    """Nulls in every column, repeated rows, very long texts and clashing column names, as the whole table of documents."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tiny}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    awkward.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    for name, stage in cp.STAGES[:-1]:
        docs = cp.saved(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == columns
    ids = [r["doc_id"] for r in docs.collect()]
    assert ids.count(5) <= 1 and 11 not in ids and not {1, 2, 3, 4} & set(ids)
    assert cp.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(ids)
