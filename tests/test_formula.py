import pytest

from gridspark.functions.formula import column_letters, column_number, coordinate, matching_shift, parse, sheets_renamed, translated


@pytest.mark.parametrize(
    ("formula", "row", "col", "norm"),
    [
        ("=B2*C2", 2, 4, "RC[-2]*RC[-1]"), ("=B3*C3", 3, 4, "RC[-2]*RC[-1]"), ("=SUM(D2:D13)", 14, 4, "SUM(R[-12]C:R[-1]C)"), ("=Assumptions!$B$2", 9, 9, "ASSUMPTIONS!R2C2"), ("= sum( a1 ; B$2 ) ", 1, 1, "SUM(RC;R2C[1])"),
        ("='[Benchmarks.xlsx]Data'!B2", 1, 1, "[EXT:BENCHMARKS.XLSX]DATA!R[1]C[1]"), ("=[1]Sheet1!A1", 1, 1, "[EXT:1]SHEET1!RC"), ("=A:C+1:3", 1, 1, "C:C[2]+R:R[2]"), ("='It''s'!A1%", 1, 1, "IT'S!RC%"),
        ('=IF(A1="B2","x","")', 1, 1, 'IF(RC="B2","x","")'), ("=SUM(SalesTbl[Amount])", 1, 1, "SUM(SALESTBL[AMOUNT])"), ("=#REF!+1", 1, 1, "#REF!+1"), ("=LOG10(A1)", 1, 1, "LOG10(RC)"), ("={1,2;3,4}", 1, 1, "{1,2;3,4}"),
    ],
)
def test_relative_form(formula, row, col, norm):
    assert parse(formula, row, col)["norm"] == norm


@pytest.mark.parametrize("formula", [None, "", "text", "=§", '="open', "=A1~~"])
def test_opaque(formula):
    assert parse(formula, 1, 1) is None


def test_parts():
    p = parse("=SUM(A1:B2)*1.5+Rate/12+'My Sheet'!$C$3-TODAY()", 5, 5)
    assert p["functions"] == ["SUM", "TODAY"] and p["numbers"] == [1.5, 12.0] and p["names"] == ["Rate"]
    assert [(r["sheet"], r["row1"], r["col1"], r["row2"], r["col2"], r["is_range"]) for r in p["refs"]] == [(None, 1, 1, 2, 2, True), ("My Sheet", 3, 3, 3, 3, False)]


def test_letters():
    assert all(column_number(column_letters(n)) == n for n in (1, 26, 27, 52, 702, 703, 16_384))


def test_coordinate_column(spark):
    df = spark.createDataFrame([(r, c) for r, c in ((1, 1), (9, 26), (2, 27), (3, 702), (4, 703), (5, 16_384))], "row int, col int")
    assert [x[0] for x in df.select(coordinate(df["row"], df["col"])).collect()] == [f"{column_letters(c)}{r}" for r, c in ((1, 1), (9, 26), (2, 27), (3, 702), (4, 703), (5, 16_384))]


def test_copies_move_relative_references():
    assert translated("=A1+$B$2+C$3+Sheet1!D:D+SUM(1:2)", 2, 1) == "=B3+$B$2+D$3+Sheet1!E:E+SUM(3:4)"


def test_shift(spark):
    df = spark.createDataFrame([("=A4*2", 5, 2, "RC[-1]*2", True), ("=A5*3", 5, 2, "RC[-1]*2", True)], "f string, r int, c int, e string, v boolean")
    assert [x[0] for x in df.select(matching_shift(df["f"], df["r"], df["c"], df["e"], df["v"])).collect()] == [-1, None]


def test_spans_of_sheets_are_one_reference():
    refs = lambda f: [(r["sheet"], r["external"], r["row1"], r["col2"]) for r in parse(f, 1, 1)["refs"]]
    assert refs("=SUM(S1:S3!A1:B2)") == [("S1:S3", None, 1, 2)] == refs("=SUM('S1:S3'!A1:B2)")
    assert refs("=SUM(A1:B2,Jan:Dec!$C$4)") == [(None, None, 1, 2), ("Jan:Dec", None, 4, 3)]
    assert refs("=A1:B2+[x.xlsx]S!C3") == [(None, None, 1, 2), ("S", "x.xlsx", 3, 3)]
    assert sheets_renamed("=SUM(Jan:Dec!A1)+'Jan:Mid'!B2", {"Jan": "Feb", "Mid": "My Mid"}) == "=SUM(Feb:Dec!A1)+'Feb:My Mid'!B2"
    assert sheets_renamed("=Jan:Dec!A1", {"Dec": "Year End"}) == "='Jan:Year End'!A1"
