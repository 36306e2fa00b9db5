"""Queries over one table, on a sales sheet and a list of contracts."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from gridspark.operators import table
from gridspark.operators.table import Filter
from gridspark.plans import workflows

ROWS = [
    ("2024-03-15", "Alfa", "София", 150000.0, True), ("2024-06-20", "Beta", "Пловдив", 130000.0, True), ("2024-09-10", "Gama", " Пловдив ", 120000.0, False), ("2025-01-10", "Alfa", "София", 100000.0, True),
    ("2025-01-20", "Beta", "София", None, True), ("2025-02-15", "Gama", "София", 150000.0, False), ("2025-03-01", "Delta", "София", 120000.0, True), ("2025-04-01", "Epsilon", "София", 130000.0, None),
    ("2025-05-05", "Alfa", "София", 128400.0, True), ("2025-07-01", "Beta", None, None, False),
]


@pytest.fixture(scope="module")
def sales(spark):
    raw = spark.createDataFrame(ROWS, "`Дата` string, `Клиент` string, `Регион` string, `Оборот` double, `Платено` boolean")
    return raw.withColumn("Дата", F.col("Дата").cast("timestamp_ntz")).persist()


def one(df):
    return df.first()["value"]


YEAR = [Filter("Дата", "year_equals", 2025)]


@pytest.mark.parametrize(("function", "want"), [("sum", 628400), ("average", 125680), ("minimum", 100000), ("maximum", 150000), ("median", 128400), ("count", 5), ("distinct_count", 5)])
def test_aggregates_of_a_year(sales, function, want):
    assert one(table.aggregate(sales, function, "Оборот", filters=YEAR)) == want


def test_aggregates_of_nothing(sales):
    none = [Filter("Клиент", "equals", "nobody")]
    assert one(table.aggregate(sales, "sum", "Оборот", filters=none)) is None
    assert one(table.aggregate(sales, "count", filters=none)) == 0
    assert one(table.aggregate(sales, "count")) == 10
    assert one(table.aggregate(sales, "distinct_count", "Клиент")) == 5


def test_blanks_are_counted_along(sales):
    r = table.aggregate(sales, "sum", "Оборот", filters=YEAR).first()
    assert (r["n_rows"], r["n_blank"]) == (7, 2)


def test_groups_keep_null_and_strip_text(sales):
    got = {r["Регион"]: (r["value"], r["n_rows"]) for r in table.aggregate(sales, "sum", "Оборот", group_by=["Регион"]).collect()}
    assert got == {"София": (778400.0, 7), "Пловдив": (250000.0, 2), None: (None, 1)}
    months = {r["Дата"]: r["value"] for r in table.aggregate(sales, "sum", "Оборот", filters=YEAR, group_by=["Дата"]).collect()}
    assert months["2025-01"] == 100000 and months["2025-05"] == 128400


@pytest.mark.parametrize(
    ("flt", "n"),
    [
        (Filter("Клиент", "equals", " ALFA "), 3), (Filter("Клиент", "not_equals", "alfa"), 7), (Filter("Клиент", "contains", "ET"), 3), (Filter("Оборот", "contains", "1"), 0), (Filter("Оборот", "greater_than", 125000), 5),
        (Filter("Оборот", "greater_than", "125000"), 5), (Filter("Оборот", "less_or_equal", 100000), 1), (Filter("Оборот", "not_equals", 150000), 8), (Filter("Оборот", "is_blank"), 2), (Filter("Регион", "not_blank"), 9),
        (Filter("Дата", "before", "2024-06-20"), 1), (Filter("Дата", "after", date(2025, 5, 5)), 1), (Filter("Платено", "equals", False), 3), (Filter("Оборот", "equals", "many"), 0), (Filter("Оборот", "less_than", 120000), 1), (Filter("Оборот", "greater_or_equal", 150000), 2),
    ],
)
def test_filters(sales, flt, n):
    assert table.where(sales, [flt]).count() == n


def test_filters_are_checked():
    with pytest.raises(ValueError, match="missing a value"):
        Filter("x", "equals")
    with pytest.raises(ValueError, match="unknown operator"):
        Filter("x", "like", 1)
    assert str(Filter("Amount", "greater_than", 500.0)) == "Amount greater than 500.0" and str(Filter("D", "year_equals", 2025)) == "year(D) = 2025"


def test_filters_reach_the_scan(spark, tiny):
    plan = table.aggregate(spark.read.parquet(f"{tiny}/orders.parquet"), "sum", "o_totalprice", filters=[Filter("o_orderdate", "year_equals", 1997), Filter("o_custkey", "greater_than", 10)])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in text and "ReadSchema: struct<o_custkey:bigint,o_totalprice:double,o_orderdate:timestamp_ntz>" in text


def test_periods(sales):
    r = table.compare_periods(sales, "Дата", 2024, 2025, "sum", "Оборот").first()
    assert (r["first"], r["second"], r["change"], r["percent"], r["n_rows"]) == (400000, 628400, 228400, 57.1, 10)
    assert table.compare_periods(sales, "Дата", 2020, 2025, "sum", "Оборот").first()["percent"] is None


def test_deadlines(spark):
    rows = [("А", "2026-07-30", 12000), ("Б", "2026-08-10", 8000), ("В", "2026-09-15", 20000), ("Г", "2025-12-01", 5000), ("Д", None, 1)]
    df = spark.createDataFrame(rows, "`Договор` string, d string, v long").withColumn("d", F.to_date("d"))
    today = date(2026, 7, 24)
    assert table.next_deadline(df, "d", today, ["Договор"]).first()["Договор"] == "А"
    assert table.due_within(df, "d", today).count() == table.due_within(df, "d", today, 0).count() == 2
    assert [r["Договор"] for r in table.overdue(df, "d", today).collect()] == ["Г"]


def test_listing_is_capped(spark):
    df = spark.range(200)
    assert table.list_rows(df, ["id"]).count() == 50
    assert [r["id"] for r in table.list_rows(df, ["id"], filters=[Filter("id", "greater_than", 100)], limit=2).collect()] == [101, 102]


def test_text_columns_are_coerced(spark):
    df = spark.createDataFrame([(" 12.5 ",), ("1e3",), ("1,000",), ("nan",), ("x",), (None,), ("\xa07\t",)], "v string")
    r = table.aggregate(df, "sum", "v").first()
    assert (r["value"], r["n_blank"]) == (1019.5, 4)


def test_answer_has_its_provenance(sales):
    a = workflows.answer(sales, "sum", "oborot", filters=[Filter("data", "year_equals", 2025)])
    assert (a.value, a.column, a.rows_total, a.rows_included, a.rows_blank, a.status, a.filters) == (628400, "Оборот", 10, 7, 2, "review_recommended", ["year(Дата) = 2025"])
    assert workflows.answer(sales, "count").status == "verified"
    with pytest.raises(workflows.CannotAnswer):
        workflows.answer(sales, "sum", "profit")


def test_ambiguity_asks_and_takes_choices(spark):
    df = spark.createDataFrame([("a", 10, 1000), ("b", 20, 2000), ("c", 30, 3000)], "Category string, `Amount.` long, `amount` long")
    with pytest.raises(workflows.NeedsConfirmation) as e:
        workflows.answer(df, "sum", "AMOUNT")
    assert e.value.candidates == ["Amount.", "amount"]
    assert [workflows.answer(df, "sum", "AMOUNT", choices=[c]).value for c in (1, 2)] == [60, 6000]
    with pytest.raises(workflows.CannotAnswer):
        workflows.answer(df, "sum", "AMOUNT", choices=[3])


def test_profile(spark):
    df = spark.createDataFrame([(1, "yes", "a"), (2, "no", "b"), (None, "yes", "a"), (4, "no", "a")], "n long, b string, c string")
    got = {r["column"]: (r["n_present"], r["n_missing"], r["n_distinct"], r["type"]) for r in table.profile(df).collect()}
    assert got == {"n": (3, 1, 3, "number"), "b": (4, 0, 2, "boolean"), "c": (4, 0, 2, "categorical")}
