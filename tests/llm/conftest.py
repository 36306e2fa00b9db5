"""Documents of every awkward kind, and the tables' small sizes."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _text string, ids string, score double, row int"


def _words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Null and empty texts, blanks only, odd characters, repeated rows, a null id, a very long text, and columns with clashing names."""
    rng = random.Random(1)
    long = _words(rng, 40_000)
    texts = {
        1: None, 2: "", 3: " \t\n ", 4: "one", 5: _words(rng, 300), 6: long, 7: "ça 日本語 \U0001f600 é ▁x <|im_end|> <|endoftext|>.", 8: "\n".join(["same line here again"] * 30), 9: "x" * 5_000, 10: "123 456 %%% $$$",
    }
    rows = [(i, t, "en", "s", None if t is None else len(t), "clash", "clash", 1.0, 1) for i, t in texts.items()]
    rows += [rows[4], (11, texts[5], None, None, None, None, None, None, None), (None, texts[5], "en", "s", 1, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, tiny):
    return spark.read.parquet(f"{tiny}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] for r in documents.collect()}
