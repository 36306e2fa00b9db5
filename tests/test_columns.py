"""Columns found by what they speak of, against a plain walk over all aliases; deadlines; listings with their counts."""

import random

import pytest
from pyspark.sql import functions as F

from gridspark.functions import concepts
from gridspark.operators import columns
from gridspark.operators.table import Filter
from gridspark.plans import workflows

SCHEMA = "wb string, sheet string, block int, col int, name string, type string"
WORDS = sorted({w for f in concepts.FORMS for w in f.split()}) + ["x", "foo", "и"]


def walk(name):
    """The aliases in a name of lower-case words."""
    latin = concepts.latin(name)
    return [f for f in concepts.FORMS if f" {f} " in f" {name} " or f" {f} " in f" {latin} "]


def test_concepts_equal_a_walk_over_all_aliases(spark):
    r = random.Random(3)
    names = [" ".join(r.choices(WORDS, k=r.randint(0, 7))) for _ in range(400)] + list(concepts.FORMS)
    got = spark.createDataFrame([(n,) for n in names], "name string").select("name", concepts.of_name(F.col("name")).alias("c"), concepts.of_text(F.col("name")).alias("t")).collect()
    for g in got:
        found = walk(g["name"])
        assert g["c"] == sorted({concepts.FORMS[f] for f in found}), g["name"]
        kept = [f for f in sorted(found, key=len, reverse=True) if not any(f != o and f" {f} " in f" {o} " for o in found)]
        assert g["t"] == list(dict.fromkeys(concepts.FORMS[f] for f in kept)), g["name"]


def test_odd_names(spark):
    long = "foo " * 200_000 + "Due-Date!"
    rows = [(None,), ("",), (" ?! ",), (long,), ("НЕТЕН\tоборот",), ("unit_price",)]
    got = spark.createDataFrame(rows, "n string").select(concepts.of_name(F.col("n")).alias("c"), concepts.of_text(F.col("n")).alias("t"), concepts.wanted(F.col("n")).alias("w")).collect()
    assert [g["c"] for g in got] == [[], [], [], ["date", "due_date"], ["net_revenue", "revenue"], []]
    assert [g["t"] for g in got] == [[], [], [], ["due_date"], ["net_revenue"], []]
    assert got[0]["w"] == [] and got[3]["w"] == ["due_date"]


@pytest.fixture(scope="module")
def heads(spark):
    rows = [("a", "S", 1, 1, "Оборот", "currency"), ("a", "S", 1, 2, "Net revenue", "number"), ("a", "S", 1, 3, "Sales notes", "text"), ("a", "S", 1, 4, "Клиент", "text"), ("a", "S", 1, 4, "Клиент", "text"), ("b", "S", 1, 1, None, "number"), ("b", "S", 2, 1, "client", "text")]
    return spark.createDataFrame(rows, SCHEMA).withColumns({"ask": F.lit(9), "text": F.lit("clash"), "form": F.lit("f"), "concept": F.lit("c")})


def test_names_go_before_concepts_and_nothing_is_picked_silently(spark, heads):
    asked = spark.createDataFrame([(1, "a", "oborot"), (2, "a", "revenue"), (3, "a", "net sales"), (4, "a", "customers"), (5, "a", None), (6, "b", "customer"), (7, "none", "customer"), (8, "a", "")], "ask int, wb string, text string")
    got = {r["ask"]: (r["status"], r["how"], [m["col"] for m in r["matches"]]) for r in columns.resolved(asked, heads).collect()}
    lost = ("not_found", None, [])
    assert got == {1: ("resolved", "exact", [1]), 2: ("ambiguous", "alias", [1, 2]), 3: ("resolved", "alias", [2]), 4: ("resolved", "alias", [4]), 5: lost, 6: ("resolved", "alias", [1]), 7: lost, 8: lost}
    free = {r["ask"]: (r["status"], r["how"]) for r in columns.resolved(asked, heads, names_first=False).collect()}
    assert free[1] == ("ambiguous", "alias")
    assert columns.resolved(asked, heads.limit(0)).where("status <> 'not_found'").isEmpty() and columns.resolved(asked.limit(0), heads).isEmpty()


def test_deadlines_take_the_only_due_date(spark):
    rows = [("one", "S", 1, 2, "Signed", "date"), ("due", "S", 1, 1, "Invoice date", "date"), ("due", "S", 1, 3, "Падеж", "date"), ("two", "S", 1, 1, "Due date", "date"), ("two", "S", 1, 2, "Deadline", "date"), ("no", "S", 1, 1, "Due date", "text"), ("null", "S", 1, 1, None, "date")]
    got = {r["wb"]: (r["status"], r["col"]) for r in columns.deadlines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {"one": ("resolved", 2), "due": ("resolved", 3), "two": ("ambiguous", None), "null": ("resolved", 1)}


def test_a_table_is_asked_by_concepts(spark):
    df = spark.createDataFrame([("x", 1.0, 2.0)], "klient string, `нетен оборот` double, margin double").selectExpr("*", "date'2024-01-01' as signed", "date'2024-02-01' as `краен срок`")
    assert (workflows.resolve(df, "net sales"), workflows.resolve(df, "customer")) == ("нетен оборот", "klient")
    assert workflows.resolve_date(df, deadline=True) == "краен срок" == workflows.resolve_date(df, "due date")
    with pytest.raises(workflows.NeedsConfirmation):
        workflows.resolve_date(df)
    with pytest.raises(workflows.CannotAnswer):
        workflows.resolve(df, "nonsense")
    with pytest.raises(workflows.CannotAnswer):
        workflows.resolve(spark.createDataFrame([("x",)], "sales string"), "revenue")  # amounts are no texts


def test_listings_have_their_counts(spark):
    df = spark.range(200).selectExpr("id", "if(id < 100, '2024-01-0' || (id % 9 + 1), 'soon') as day", "id as `a.b`")
    got = workflows.listed(df, ["id"], filters=[Filter("day", "year_equals", 2024)], limit=3)
    assert [r["id"] for r in got.rows.collect()] == [0, 1, 2] and (got.value, got.rows_total, got.rows_included) == (100, 200, 100)
    assert got.warnings == ["only the first 3 of 100 rows are listed", "100 values are no dates"] and got.status == "review_recommended"
    few = workflows.listed(df, ["a.b"], filters=[Filter("id", "less_than", 2)])
    assert few.value == 2 and few.status == "verified" and few.rows.count() == 2
    for nothing in (df.limit(0), spark.createDataFrame([], df.schema), df.where("false")):
        got = workflows.listed(nothing, ["id"])
        assert (got.value, got.rows_total, got.warnings) == (0, 0, [])
    assert workflows.listed(df, ["id"], filters=[Filter("id", "less_than", 0)]).rows_total == 200
    with pytest.raises(ValueError):
        workflows.listed(df, [])
