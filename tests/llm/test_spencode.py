import hashlib
import tracemalloc

import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from gridspark.llm import spencode
from gridspark.llm._text import slices
from gridspark.llm.queries import QUERIES, tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def own():
    return spencode.Encoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8"), max_size=60) | st.text(st.sampled_from("ab ▁\n\tçé日<s>/0"), max_size=60))
def test_any_text_as_the_library(text):
    sp, e = sentencepiece.SentencePieceProcessor(model_file=PATH), spencode.encoder(PATH)
    ids = list(e.encode([text]))[0].tolist()
    assert ids == sp.encode(text) + [sp.eos_id()]
    assert e.vocabulary.decode(ids) == sp.decode(ids)


def test_whole_table_as_the_library(spark, tiny, texts, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = QUERIES["op7_sentencepiece"](spark, tiny).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r["doc_id"]] or "") + [library.eos_id()]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))


def test_heap_and_rows_merge_alike(own):
    v = own.vocabulary
    chunks = [" hello", "ababababab", " " * 12 + "x", "ﬁnal", "z" * 63, "don't"]
    assert v.merge_all(chunks) == [v.merge(c) for c in chunks]


def test_a_difference_from_the_library_is_an_error(own):
    with pytest.raises(ValueError):
        own.vocabulary.checked({" hello": [5]})


def test_awkward_and_empty_tables(awkward, no_documents, library):
    rows = spencode.encode_documents(awkward, PATH)
    known = {r["doc_id"]: r["text"] for r in awkward.collect() if r["doc_id"] is not None}
    got = rows.collect()
    assert len(got) == awkward.count()
    assert all(list(r["ids"]) == library.encode(known[r["doc_id"]] or "") + [library.eos_id()] for r in got if r["doc_id"] is not None)
    back = {r["doc_id"]: r["text"] for r in spencode.decode_documents(rows, PATH).collect() if r["doc_id"] is not None}
    assert back[5] == known[5] and back[1] == ""
    assert spencode.digest_documents(no_documents, PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab ▁\n\t\0ç,."), max_size=40))
def test_texts_fall_apart_as_by_the_pattern(text):
    v = spencode.encoder(PATH).vocabulary
    assert v.split(text) == (v.chunks.findall(" " + text.replace("▁", " ")) if text else [])


def test_chunks_are_checked_together(monkeypatch):
    e, asked = spencode.Encoder(PATH), []

    class Asked:
        def encode(self, x, **more):
            asked.extend(x if isinstance(x, list) else [x])
            return library.encode(x, **more)

        def decode(self, x, **more):
            return library.decode(x, **more)

    library = e.vocabulary.library
    monkeypatch.setattr(e.vocabulary, "library", Asked())
    list(e.digests([" ".join(f"w{i}" for i in range(1_000)) + "\n  \t x"]))
    assert all(any(f" w{i}" in a for a in asked) for i in range(1_000)) and len(asked) < 100


def test_chunks_that_decode_to_something_else_and_long_ones(own):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    e = spencode.Encoder(PATH)
    e.learn([[" hello"]])
    e.odd[" hello"] = b" odd"
    assert [g[2] for g in e.digests(["hello you", "z" * 99 + " you"])] == [sha("odd you"), sha("z" * 99 + " you")]


def test_memory_does_not_grow_with_new_chunks():
    """Texts of nothing but new chunks, several caches full: what is held at once stays below a bound."""
    e = spencode.Encoder(PATH, check=False)
    texts = [[" ".join(f"{k:x}q{i:x}" for i in range(j, j + 1_000)) for j in range(0, 100_000, 1_000)] for k in range(4)]
    batch = [pa.RecordBatch.from_arrays([pa.array(t)], ["t"]) for t in texts]
    tracemalloc.start()
    try:
        for b in batch:
            for part in slices(b, 0, spencode.GROUP):
                list(e.digests(part.column(0).to_pylist()))
        assert tracemalloc.get_traced_memory()[1] < 80 << 20
    finally:
        tracemalloc.stop()
