import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridspark.llm import chat
from gridspark.llm.queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string"
tricky = st.text(st.sampled_from(list("<|im_start>end\\\nn ax")) | st.characters(codec="utf-8"), max_size=40) | st.lists(st.sampled_from([chat.START, chat.END, "<\\|im_end|>", "<", "|", "\\", "\n", "<n>", "assistant"]), max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(tricky, tricky), max_size=4))
def test_round_trip(turns):
    written = "".join(chat.render(r, t)[0] for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat.parse(written)] == turns


@pytest.mark.parametrize("bad", ["x", "<|im_start|>user", "<|im_start|>user\nhi", "<|im_start|>user\nhi<|im_end|>x", "<|im_start|>u\n<|im_start|>a\n<|im_end|>\n"])
def test_malformed_text_is_refused(bad):
    with pytest.raises(chat.Malformed):
        chat.parse(bad)


def digests(turns):
    turns = [(r or "", t or "") for r, t in turns]
    loss = "".join(t for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def test_whole_table_against_its_rows(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/conversations.parquet").orderBy("conv_id", "turn").collect()
    want: dict = {-1: [("user", "<|im_end|><|im_start|>assistant ok"), ("assistant", "<|im_end|><|im_start|>assistant ok")]}
    for r in rows:
        want.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    got = QUERIES["op5_chat_format"](spark, tiny).collect()
    assert len(got) == len(want)
    for r in got:
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == digests(want[r["conv_id"]])


def test_awkward_and_empty_tables(spark):
    rows = [(1, 2, "assistant", None), (1, 1, None, "a"), (None, 1, "user", "x"), (2, 1, "us\ner", ""), (2, 1, "us\ner", ""), (3, None, "assistant", "y" * 200_000)]
    got = {r["conv_id"]: r for r in chat.digests(chat.format_turns(spark.createDataFrame(rows, TURNS))).collect()}
    assert (got[1]["n_turns"], got[2]["n_turns"], got[3]["loss_chars"], got[None]["n_turns"]) == (2, 2, 200_000, 1)
    assert got[1]["turns_sha256"] == digests([(None, "a"), ("assistant", None)])[1]
    assert chat.digests(chat.format_turns(spark.createDataFrame([], TURNS))).count() == 0
