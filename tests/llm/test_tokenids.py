import zlib

import numpy as np
import pyarrow as pa
import pyarrow.orc as orc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gridspark.llm import tokenids
from gridspark.llm.queries import QUERIES, tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8"), max_size=40) | st.text(st.sampled_from("aZé., '\n sΣİ<|endoftext>1"), max_size=40), min_size=1, max_size=3))
def test_any_texts_as_the_library(texts):
    lib = Tokenizer.from_file(PATH) if not hasattr(test_any_texts_as_the_library, "lib") else test_any_texts_as_the_library.lib
    test_any_texts_as_the_library.lib = lib
    ids, bounds = tokenids.encoder(PATH).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [lib.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_whole_table_as_the_library(spark, tiny, texts, library):
    got = {r["doc_id"]: r for r in QUERIES["op9_token_orc"](spark, tiny).collect()}
    start = 0
    assert len(got) == len(texts)
    for i in sorted(texts):
        ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 1]
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def stream_kinds(spark, file):
    """The kinds of the streams of ``doc_id`` in each stripe, from the stripes' footers."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(file)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    column = list(reader.getSchema().getFieldNames()).index("doc_id") + 1
    rows = reader.rows()
    try:
        return [{s.getKind().toString() for s in rows.readStripeFooter(stripe).getStreamsList() if s.getColumn() == column} for stripe in reader.getStripes()]
    finally:
        rows.close()


def test_files_have_stripes_bloom_filters_and_prune(spark, documents, tmp_path):
    out = f"{tmp_path}/ids"
    many = documents.unionByName(documents.selectExpr("doc_id + 100000 as doc_id", "text", "lang", "source", "n_chars"))
    tokenids.write_ids(many, PATH, out, stripe_bytes=200_000, index_stride=1000)
    files = sorted(tmp_path.glob("ids/*.orc"))
    assert sum(orc.ORCFile(f).nrows for f in files) == many.count()
    assert all("BLOOM_FILTER_UTF8" in kinds or "BLOOM_FILTER" in kinds for f in files for kinds in stream_kinds(spark, f))
    found = tokenids.read_ids(spark, out, [5, 100_007])
    assert sorted(r["doc_id"] for r in found.collect()) == [5, 100_007]
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().executedPlan().toString()


def test_a_small_cache_gives_the_same(library, monkeypatch):
    monkeypatch.setattr(tokenids, "CACHE", 3)
    e = tokenids.ChunkEncoder(PATH)
    for t in ("one two three four five", "six seven one two", "one, two. <|endoftext|> Three"):
        assert e.encode(pa.array([t]), None)[0].tolist() == library.encode(t, add_special_tokens=False).ids


def test_awkward_and_empty_tables(awkward, no_documents, library):
    got = sorted(tokenids.stored_documents(awkward, PATH).collect(), key=lambda r: r["start"])
    assert len(got) == awkward.count() and got[0]["doc_id"] is None
    known = {r["doc_id"]: r["text"] for r in awkward.collect() if r["doc_id"] is not None}
    assert all(r["n_tokens"] == len(library.encode(known[r["doc_id"]] or "", add_special_tokens=False).ids) + 1 for r in got if r["doc_id"] is not None)
    assert [r["start"] for r in got] == np.cumsum([0, *[r["n_tokens"] for r in got]])[:-1].tolist()
    assert tokenids.stored_documents(no_documents, PATH).count() == 0
