import numpy as np
import public_tokenizers
import pytest

from gridspark.llm import tokencount
from gridspark.llm.queries import QUERIES, tokenizer_path

PATH, PATTERN = tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def test_whole_table_against_the_tokenizer(spark, tiny, texts):
    e = tokencount.encoding(PATH, PATTERN)
    got = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op8_token_counts"](spark, tiny).collect()}
    assert got == {i: len(e.encode_ordinary(t or "")) + 1 for i, t in texts.items()}


@pytest.mark.parametrize("block", [2, 6, 10, 64, 1 << 20])
def test_documents_across_blocks_and_files(spark, tmp_path, block):
    end = tokencount.END_ID
    files = [[1, 2, end, 3], [4, 5, 6, 7, 8, 9], [end, end, 1], [2, end], [7]]
    for k, ids in enumerate(files):
        np.array(ids, tokencount.ID).tofile(tmp_path / f"part-{k:06d}.ids")
    rows = tokencount.count_tokens(tokencount.flat_blocks(spark, f"file://{tmp_path}", block)).orderBy("start").collect()
    flat = [i for ids in files for i in ids]
    ends = [k + 1 for k, i in enumerate(flat) if i == end]
    assert [(r["start"], r["n_tokens"]) for r in rows] == [(a, b - a) for a, b in zip([0, *ends], ends, strict=False)]
    assert [(r["file_no"], r["nth"]) for r in rows] == [(0, 0), (2, 0), (2, 1), (3, 0)]


def test_no_files(spark, tmp_path):
    assert tokencount.count_tokens(tokencount.flat_blocks(spark, f"file://{tmp_path}")).count() == 0


def test_awkward_and_empty_tables(awkward, no_documents):
    e = tokencount.encoding(PATH, PATTERN)
    want = sorted((r["doc_id"] or -1, len(e.encode_ordinary(r["text"] or "")) + 1) for r in awkward.collect())
    assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in tokencount.document_tokens(awkward, PATH, PATTERN, block_bytes=1000).collect()) == want
    assert tokencount.document_tokens(no_documents, PATH, PATTERN).count() == 0


def test_ranks_that_do_not_fit_are_refused(tmp_path):
    for name, rank in (("end", tokencount.END_ID), ("large", 1 << 16)):
        (tmp_path / name).write_text(f"YQ== 0\nYg== {rank}\n")
        with pytest.raises(ValueError, match="end id" if name == "end" else "fit"):
            tokencount.encoding(str(tmp_path / name), PATTERN)
    with pytest.raises(ValueError, match="fit"):
        tokencount.encoding(PATH, PATTERN, end_id=-1)


def test_a_failed_attempt_leaves_no_file(spark, tmp_path):
    bad = spark.range(4000, numPartitions=2).selectExpr("id as doc_id", "if(id = 3999, raise_error('lost'), 'a text') as text")
    with pytest.raises(Exception, match="lost"):
        tokencount.write_flat(bad, f"file://{tmp_path}/flat", PATH, PATTERN)
    assert not [f for f in (tmp_path / "flat").iterdir() if f.name.startswith("_")]
