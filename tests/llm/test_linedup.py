import duckdb
from pyspark.sql import functions as F

from gridspark.llm import linedup
from gridspark.llm.queries import ORACLES, QUERIES


def test_whole_table_against_sql(spark, tiny):
    own = QUERIES["op6_line_dedup"](spark, tiny).toPandas()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tiny}/documents.parquet'")
    want = con.sql(ORACLES["op6_line_dedup"]).df()[list(own.columns)]
    key = lambda df: sorted(map(str, df.itertuples(index=False, name=None)))
    assert key(own) == key(want) and own["n_dropped"].sum() > 0


def test_templates_generalise_variable_fields(spark):
    line = "login at the office by user {} on a quiet night"
    docs = [(i, f"{line.format(name)}\n{name} begins this line with a word of its own") for i, name in enumerate(["anna", "bert", "carl"], 1)]
    docs += [(4, "page 1 of 20 follows here"), (5, "page 2 of 21 follows here"), (6, "page 3 of 9 follows here")]
    got = {r["doc_id"]: r["text"] for r in linedup.line_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == docs[0][1] and got[4] == docs[3][1]  # the first document keeps the line
    assert got[5] == got[6] == ""
    assert got[2] == "bert begins this line with a word of its own"  # leading tokens are the tree's path


def test_lead_tokens_and_long_passages(spark):
    passage = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))
    short = "this short line is in two documents"
    docs = [(1, f"{passage}\n{short}"), (2, f"{short}\n{passage}"), (3, "a b c")]
    got = {r["doc_id"]: r["text"] for r in linedup.line_report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: docs[0][1], 2: short, 3: "a b c"}


def test_repeated_lines_in_one_document_stay(spark):
    docs = spark.createDataFrame([(1, "again and again\n" * 5), (2, "other text of its own")], "doc_id long, text string")
    assert linedup.line_report(docs).agg(F.sum("n_dropped")).first()[0] == 0


def test_awkward_and_empty_tables(awkward, no_documents):
    got = linedup.line_report(awkward).collect()
    assert len(got) == awkward.count()
    by = {r["doc_id"]: r for r in got}
    assert (by[1]["n_lines"], by[1]["text"]) == (0, None) and (by[2]["n_lines"], by[2]["text"]) == (1, "")
    assert linedup.line_report(no_documents).count() == 0
    kept = linedup.dedupe_lines(awkward)
    assert kept.columns == awkward.columns and linedup.dedupe_lines(no_documents).count() == 0


def test_columns_may_have_any_names(spark):
    """Names of all helper columns of the operator, and some with odd characters, come back with their own values."""
    import re
    from pathlib import Path

    names = sorted(set(re.findall(r'"(_[a-z]+)"', Path(linedup.__file__).read_text())) | {"a.b", "no", "id", "text_", "_di", "_dh"})
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    own = [f"own {n}" for n in names]
    shared = "one line that three documents hold"
    docs = spark.createDataFrame([(i, f"{shared}\n{chr(97 + i) * 3} has words of its own", 1, *own) for i in range(3)] + [(9, None, None, *own)], schema)
    rows = {r["doc_id"]: r for r in linedup.dedupe_lines(docs).collect()}
    assert sorted(rows) == [0, 1, 2, 9] and shared not in rows[1]["text"] and rows[1]["n_chars"] == len(rows[1]["text"]) and rows[9]["text"] is None
    assert all(list(r)[3:] == own for r in rows.values())
    assert linedup.line_report(docs).where("n_dropped = 1").count() == 2
