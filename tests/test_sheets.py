"""Sheets written as {address: value}: schema detection, patterns, the graph, rules and comparison."""

import re
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridspark.functions import formula as formula_functions
from gridspark.functions import text
from gridspark.functions.formula import PARSED, column_number
from gridspark.operators import cells as grid
from gridspark.operators import diff, graph, rules
from gridspark.operators.cells import CELLS
from gridspark.plans import workflows
from gridspark.session import saved


def sheet(spark, *sheets, wb="w", number_format="General"):
    """Cells of sheets given as (name, {address: value}); a value may be (formula, saved value) or end with a format."""
    rows = []
    for n, (name, values) in enumerate(sheets):
        for at, v in values.items():
            letters, digits = re.match(r"([A-Z]+)(\d+)", at).groups()
            formula, fmt = None, number_format
            if isinstance(v, tuple):
                formula, v, *rest = v
                fmt = rest[0] if rest else fmt
            elif isinstance(v, str) and v.startswith("="):
                formula, v = v, None
            kind = None if v is None else "b" if isinstance(v, bool) else "n" if isinstance(v, int | float) else "d" if isinstance(v, datetime) else "e" if v.startswith("#") else "s"
            rows.append((wb, name, n, int(digits), column_number(letters), kind, float(v) if kind in ("n", "b") else None, v if kind in ("s", "e") else None, v if kind == "d" else None, formula, fmt, fmt))
    return spark.createDataFrame(rows, CELLS)


def found(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


TABLE = {"A1": "Item", "B1": "Units", "C1": "Total"} | {f"A{r}": f"item {r}" for r in range(2, 12)} | {f"B{r}": r * 10 for r in range(2, 12)} | {f"C{r}": (f"=B{r}*2", r * 20.0) for r in range(2, 12)} | {"A12": "Total:", "C12": ("=SUM(C2:C11)", 1300.0)}


def test_tables(spark):
    two = {"A1": "x", "B1": "y", "A2": "a", "B2": 1, "A3": "b", "B3": 2, "A4": "c", "B4": 3} | {"A6": "x", "B6": "y", "A7": "a", "B7": 1, "A8": "b", "B8": 2}
    titled = {"A1": "Report", "A2": "Name", "B2": "Amount", "A3": "a", "B3": 1, "A4": "b", "B4": 2}
    numbers = {f"{c}{r}": 1 for c in "AB" for r in range(1, 6)}
    cells = sheet(spark, ("t", TABLE), ("two", two), ("titled", titled), ("numbers", numbers))
    assert found(grid.tables(cells), "sheet", "header_row", "first_data", "last_data") == [("t", 1, 2, 12), ("titled", 2, 3, 4), ("two", 1, 2, 4), ("two", 6, 7, 8)]
    columns = {(r["sheet"], r["name"]): r for r in grid.table_columns(cells, grid.tables(cells)).collect()}
    assert (columns["t", "Units"]["type"], columns["t", "Units"]["n_present"], columns["t", "Units"]["n_missing"]) == ("number", 10, 0)
    assert columns["t", "Item"]["type"] == "text"


def test_frame_of_a_table(spark):
    cells = sheet(spark, ("t", {"A1": "Category", "B1": "Amount", "C1": "Amount", "A2": "a", "B2": 10, "C2": 1000, "A3": "b", "B3": 20, "C3": 2000, "A4": "Grand total", "B4": 30, "C4": 3000}))
    frame = workflows.frame(cells, grid.tables(cells).first().asDict())
    assert frame.columns == ["row", "Category", "Amount (B)", "Amount (C)"]
    assert found(frame, "Amount (B)", "Amount (C)") == [(10.0, 1000.0), (20.0, 2000.0)]


def test_pattern_gaps(spark):
    over = {f"D{r}": f"=B{r}*C{r}" for r in range(10, 15)} | {"D13": 1250}
    other = {f"B{r}": f"=A{r}*2" for r in range(2, 8)} | {"B5": "=A4*2"}
    blank = {f"B{r}": f"=A{r}*2" for r in (1, 2, 4, 5)} | {"A3": 1}
    layout = {f"B{r}": f"=A{r}*2" for r in (1, 2, 4, 5)}
    got = grid.pattern_gaps(grid.with_formulas(sheet(spark, ("over", over), ("other", other), ("blank", blank), ("layout", layout))))
    assert found(got, "sheet", "row", "col", "anomaly") == [("blank", 3, 2, "missing_formula"), ("other", 5, 2, "inconsistent_formula"), ("over", 13, 4, "overwritten_constant")]
    assert got.where("sheet = 'other'").first()["shift"] == -1


def edges_of(spark, *sheets):
    cells = sheet(spark, *sheets)
    p = grid.with_formulas(cells)
    spans = graph.areas(p)
    return cells, p, spans, graph.edges(spans, cells)


def test_graph(spark):
    values = {"A1": "=B1+1", "B1": "=A1+1", "C1": "=A1", "D1": 1, "D2": 2, "D11": "=SUM(D1:D11)", "E1": "=SUM(D:D)", "F1": "=Other!A1", "G1": "=Nowhere!A1"}
    cells, p, spans, e = edges_of(spark, ("S", values), ("Other", {"A1": 5}))
    assert found(graph.cycles(e), "cycle", "row", "col") == [(0, 1, 1), (0, 1, 2)]
    assert found(graph.self_loops(spans), "row", "col") == [(11, 4)]
    assert found(e.where("to_col = 5"), "row", "col") == [(1, 4), (2, 4), (11, 4)]
    got = {(r["sheet"], r["row"], r["col"]): r for r in graph.impact(e, cells, graph.output_like(cells, e)).collect()}
    assert (got["S", 1, 1]["transitive"], got["S", 1, 1]["circular"]) == (3, True)
    assert (got["Other", 1, 1]["direct"], got["Other", 1, 1]["sheets"]) == (1, ["S"]) and got["S", 1, 7]["transitive"] == 0


def test_large_ranges_become_strips(spark):
    _, _, spans, _ = edges_of(spark, ("S", {"A1": "=SUM(B1:Z9999)", "Z9999": 1}))
    r = spans.first()
    assert (r["row2"] - r["row1"] + 1, r["col2"], r["truncated"]) == (9999, 2, True)


def test_names_and_table_columns(spark):
    values = {"A1": "Amount", "A2": 1, "A3": 2, "A4": 3, "B1": "=SUM(Sales[Amount])", "B2": "=Multi", "B3": "=Rate*2", "B4": "=Ghost", "B5": "=Lost", "B6": "=Sales[Nope]"}
    p = grid.with_formulas(sheet(spark, ("S", values)))
    names = spark.createDataFrame([("w", "Multi", None, "S!$A$1:$A$3,S!$C$1"), ("w", "multi", "Other", "S!$A$4"), ("w", "Rate", None, "0.2"), ("w", "Lost", None, "#REF!")], graph.NAMES)
    declared = spark.createDataFrame([("w", "S", "Sales", 1, 1, 4, 1, 1, 0)], graph.DECLARED)
    spans = graph.areas(p, names, declared)
    assert found(spans, "row", "row1", "col1", "row2", "col2") == [(1, 2, 1, 4, 1), (2, 1, 1, 3, 1), (2, 1, 3, 1, 3)]
    assert found(graph.unresolved(p, names, declared), "row") == [(4,), (5,), (6,)]


def audit(spark, *sheets, **more):
    return rules.run(rules.Audit(sheet(spark, *sheets, **more)))


def test_rules_on_a_faulty_model(spark):
    values = TABLE | {"D1": "=#REF!+1", "D2": "=TODAY()", "D3": "#DIV/0!", "D4": "=[Book.xlsx]X!A1", "D5": "=B2*1.17", "D6": "=B2+" + "B2+" * 90 + "B2", "D7": "=B2+Z1+E9", "E20": 1}
    values = values | {"C6": 999, "C12": ("=SUM(C2:C10)", 1.0)}
    got = {(r["rule"], r["row"], r["col"]) for r in audit(spark, ("P&L", values)).collect()}
    assert got == {("EA-REF-001", 1, 4), ("EA-VOL-001", 2, 4), ("EA-ERR-001", 3, 4), ("EA-EXT-001", None, None), ("EA-HRD-001", None, None), ("EA-CPX-001", 6, 4), ("EA-RNG-002", None, None), ("EA-PAT-001", 6, 3), ("EA-RNG-001", 12, 3)}
    assert audit(spark, ("clean", TABLE)).count() == 0


def test_rounding_drift(spark):
    parts = {f"A{i}": (None, v, "0.00") for i, v in enumerate([12.344, 10.333, 8.328], 1)}
    r = audit(spark, ("S", parts | {"A4": ("=SUM(A1:A3)", 31.005, "0.00")})).where("rule = 'EA-RND-001'").collect()
    assert [(x["row"], x["col"]) for x in r] == [(4, 1)] and '"drift":-0.01' in r[0]["evidence"]
    typed = audit(spark, ("S", {f"A{i}": (None, v, "#,##0.00") for i, v in enumerate([1234.564, 2345.333, 876.108, 4456.01], 1)})).where("rule = 'EA-RND-001'")
    assert found(typed, "row") == [(4,)]
    general = audit(spark, ("S", {f"A{i}": v for i, v in enumerate([12.344, 10.333, 8.328, 31.005], 1)})).where("rule = 'EA-RND-001'")
    assert general.count() == 0


def test_grouping_and_risk(spark):
    f = audit(spark, ("S", {f"A{r}": "=TODAY()" for r in range(1, 7)} | {"C1": "=#REF!"}))
    one = rules.grouped(f)
    assert found(one, "rule", "count") == [("EA-REF-001", 1), ("EA-VOL-001", 6)]
    assert rules.risk(f).first()["risk"] == "high"


LEDGER = {"A1": "Item", "B1": "Units", "C1": "Sum"} | {f"A{r}": f"i{r}" for r in range(2, 12)} | {f"B{r}": 100 + r for r in range(2, 12)} | {f"C{r}": f"=B{r}*2" for r in range(2, 12)} | {"A12": "Total", "C12": "=SUM(C2:C11)"}


def moved(values, at, by):
    """The sheet with rows from ``at`` on moved, and relative references in its formulas with them."""
    shift = lambda m: f"{m[1]}{int(m[2]) + by if int(m[2]) >= at else m[2]}"
    return {re.sub(r"([A-Z]+)(\d+)", shift, k): re.sub(r"([A-Z]+)(\d+)", shift, v) if isinstance(v, str) and v.startswith("=") else v for k, v in values.items()}


def compared(spark, old, new):
    c = workflows.compare(rules.Audit(sheet(spark, *old)), rules.Audit(sheet(spark, *new)))
    return found(c.row_runs, "change", "sheet", "start_row", "count"), found(c.changes, "cell", "change", "severity"), c


def test_inserted_row(spark):
    new = moved(LEDGER, 6, 1) | {"A6": "new", "B6": 7, "C6": "=B6*2"}
    runs, changes, _ = compared(spark, [("L", LEDGER)], [("L", new)])
    assert runs == [("rows_inserted", "L", 6, 1)]
    assert [c[:2] for c in changes] == [("C13", "formula_changed")]


def test_removed_row_and_an_edit(spark):
    new = moved({k: v for k, v in LEDGER.items() if not re.fullmatch(r"[ABC]6", k)}, 7, -1) | {"B8": 4242}
    runs, changes, _ = compared(spark, [("L", LEDGER)], [("L", new)])
    assert runs == [("rows_removed", "L", 6, 1)]
    assert ("B8", "value_changed") in [c[:2] for c in changes]


def test_swapped_rows_compare_by_place(spark):
    new = LEDGER | {"A4": "i5", "B4": 105, "A5": "i4", "B5": 104}
    runs, changes, _ = compared(spark, [("L", LEDGER)], [("L", new)])
    assert runs == [] and {c[0] for c in changes} == {"A4", "B4", "A5", "B5"}


def test_kinds_of_change(spark):
    old = {"A1": 1, "A2": "x", "A3": "=B1", "A4": "=B1", "A5": 5, "A6": (None, 6, "0"), "A7": True, "A8": 8, "B1": 1}
    new = {"A1": 1.0 + 1e-13, "A2": "y", "A3": "=B1+1", "A4": 4, "A5": "=B1", "A6": (None, 6, "0.0"), "A7": 1, "A9": 9, "B1": 1}
    changes = {c[0]: c[1:] for c in compared(spark, [("S", old)], [("S", new)])[1]}
    assert changes == {
        "A2": ("value_changed", "low"), "A3": ("formula_changed", "medium"), "A4": ("formula_to_constant", "high"), "A5": ("constant_to_formula", "low"), "A6": ("formatting_only", "info"),
        "A7": ("value_changed", "low"), "A8": ("value_removed", "low"), "A9": ("value_added", "info"),
    }


def test_far_changes_are_raised_and_items_merged(spark):
    fan = {"A1": 1} | {f"B{r}": "=A1*2" for r in range(1, 13)} | {"D1": 5}
    _, changes, c = compared(spark, [("S", fan)], [("S", fan | {"A1": 2, "D1": "=#REF!"})])
    assert changes == [("A1", "value_changed", "medium"), ("D1", "constant_to_formula", "low")]
    items = {(r["row"], r["col"]): (r["change"], r["rules"], r["severity"]) for r in c.items.collect()}
    assert items[1, 4] == ("constant_to_formula", ["EA-REF-001"], "high") and items[1, 1][0] == "value_changed"


def test_removed_cells_reach_what_still_refers_to_them(spark):
    old = {f"A{r}": r for r in range(1, 13)} | {"A14": "Total", "B14": "=SUM(A1:A12)+D1", "D1": "=A1*2", "F1": 3}
    _, changes, _ = compared(spark, [("S", old)], [("S", {k: v for k, v in old.items() if k not in ("A5", "D1", "F1")})])
    assert changes == [("A5", "value_removed", "medium"), ("D1", "formula_removed", "high"), ("F1", "value_removed", "low")]


def test_broken_names_are_found(spark):
    names = spark.createDataFrame([("w", "Lost", None, "=S!#REF!"), ("w", "Good", None, "=S!$A$1"), ("full", "Lost", None, "#REF!")], graph.NAMES)
    cells = sheet(spark, ("S", {"A1": 1, "A2": "=#REF!+1"})).union(sheet(spark, ("S", {f"A{r}": "=#REF!" for r in range(1, 61)}), wb="full"))
    got = rules.broken_references(rules.Audit(cells, names=names)).groupBy("wb").agg(F.count("*").alias("n"), F.count_if(F.col("evidence").contains("Lost")).alias("names"))
    assert found(got, "wb", "n", "names") == [("full", 50, 0), ("w", 2, 1)]


def test_compare_returns_structural_changes(spark):
    from gridspark.sources.workbook import SHEETS, WORKBOOKS

    def side(visibility, macros):
        sheets = spark.createDataFrame([("w", "S", 0, visibility, [], [], [], False)], SHEETS)
        return rules.Audit(sheet(spark, ("S", {"A1": 1})), sheets, spark.createDataFrame([("w", "p", 1, macros, False, False, None)], WORKBOOKS))

    c = workflows.compare(side("visible", False), side("hidden", True))
    assert found(c.structure.fillna("-"), "change", "sheet") == [("macros_added", "-"), ("visibility_changed", "S")]


def test_sheet_matching(spark):
    data = {f"A{r}": r for r in range(1, 5)} | {f"B{r}": f"=A{r}*2" for r in range(1, 7)}
    old = sheet(spark, ("Keep", {"A1": 1}), ("Data", data), ("Exact", {"A1": 7}), ("Gone", {"A1": 9}))
    new = sheet(spark, ("Keep", {"A1": 2}), ("Data24", data | {"C1": 3}), ("Exact2", {"A1": 7}), ("New", {"A1": 10}))
    assert found(diff.match_sheets(old, new).fillna("-"), "old_sheet", "new_sheet", "how") == [("-", "New", "added"), ("Data", "Data24", "inferred"), ("Exact", "Exact2", "renamed"), ("Gone", "-", "removed"), ("Keep", "Keep", "same")]


def test_a_rename_is_no_formula_change(spark):
    data = {f"A{r}": r for r in range(1, 5)}
    use = lambda name: {"A1": f"={name}!A1+'{name}'!A2", "B1": f"={name}X!A1"}
    _, changes, _ = compared(spark, [("Data", data), ("Use", use("Data"))], [("Data2024", data), ("Use", {"A1": "=Data2024!A1+'Data2024'!A2", "B1": "=DataX!A1"})])
    assert changes == []


@pytest.mark.parametrize(("fmt", "decimals"), [("0.00", 2), ("#,##0", 0), ("€#,##0.00", 2), ('#,##0.0 "kg";[Red]-0.000', 1), ("General", None), ("0%", None), ("@", None), ("yyyy-mm-dd", None), ("0.00E+00", None), ("0.##", None), ("", None)])
def test_display_decimals(spark, fmt, decimals):
    assert spark.createDataFrame([(fmt,)], "f string").select(text.display_decimals(F.col("f"))).first()[0] == decimals


def test_display_rounding_and_currencies(spark):
    df = spark.createDataFrame([(31.005, 2), (-2.5, 0), (2.675, 2), (1.0, 3)], "x double, d int")
    assert [float(r[0]) for r in df.select(text.display_rounded(df["x"], df["d"])).collect()] == [31.01, -3.0, 2.68, 1.0]
    codes = spark.createDataFrame([("€0.00",), ('0.00 "лв"',), ("[$$-409]0",), ("0",)], "f string")
    assert [r[0] for r in codes.select(text.currency(codes["f"])).collect()] == ["EUR", "BGN", "USD", None]
    words = spark.createDataFrame([("  Краен  Срок! ",), ("ЩастиЕ",)], "s string")
    assert [r[0] for r in words.select(text.transliterated(text.normalized(words["s"]))).collect()] == ["kraen srok", "shtastie"]


def test_empty_relations(spark):
    none = spark.createDataFrame([], CELLS)
    assert rules.run(rules.Audit(none)).count() == 0 and grid.tables(none).count() == 0
    c = workflows.compare(rules.Audit(none), rules.Audit(none))
    assert (c.matches.count(), c.changes.count(), c.items.count(), c.row_runs.count()) == (0, 0, 0, 0)


def test_structural_changes(spark):
    from gridspark.sources.workbook import SHEETS, WORKBOOKS

    def side(sheets, names, macros):
        return {
            "sheets": spark.createDataFrame([("w", s, n, v, r, [], m, False) for n, (s, v, r, m) in enumerate(sheets)], SHEETS),
            "names": spark.createDataFrame([("w", *n) for n in names], graph.NAMES), "workbooks": spark.createDataFrame([("w", "p", 1, macros, False, False, None)], WORKBOOKS),
        }

    old = side([("A", "visible", [3], ["A1:B2"]), ("B", "visible", [], []), ("C", "visible", [], [])], [("Rate", None, "A!$A$1"), ("Gone", None, "1")], False)
    new = side([("B", "hidden", [], []), ("A", "visible", [3, 4], ["A1:B2"]), ("D", "visible", [], [])], [("RATE", None, "A!$A$2"), ("Rate", "A", "A!$A$1")], True)
    pairs = spark.createDataFrame([("w", "A", "A", "same"), ("w", "B", "B", "same"), ("w", "C", None, "removed"), ("w", None, "D", "added")], "wb string, old_sheet string, new_sheet string, how string")
    assert found(diff.structural_changes(old, new, pairs).fillna("-"), "change", "sheet") == [
        ("hidden_rows_changed", "A"), ("macros_added", "-"), ("name_added", "-"), ("name_changed", "-"), ("name_removed", "-"), ("sheet_added", "D"), ("sheet_removed", "C"), ("sheet_reordered", "A"), ("sheet_reordered", "B"), ("visibility_changed", "B"),
    ]


def test_a_failing_rule_sinks_no_other(spark, monkeypatch):
    def planned(a):
        raise KeyError("no such column")

    monkeypatch.setitem(rules.RULES, "EA-CPX-001", planned)
    monkeypatch.setitem(rules.RULES, "EA-ERR-001", lambda a: rules._finding(a.cells.where(F.raise_error(F.lit("boom")).isNull()), "EA-ERR-001", "low", "low", {}))
    report = workflows.audited(rules.Audit(sheet(spark, ("S", {"A1": "=TODAY()", "A2": 1e30, "A3": (None, 1e30, "0.00"), "A4": (None, 2.0, "0.00"), "A5": (None, 3.0, "0.0000000")}))))
    assert found(report.failed, "rule") == [("EA-CPX-001",), ("EA-ERR-001",)]
    assert found(report.findings, "rule") == [("EA-VOL-001",)]


def test_a_failing_rule_looks_like_no_result(spark, monkeypatch):
    book = rules.Audit(sheet(spark, ("S", {"A1": "=TODAY()"})))
    whole = workflows.audited(book)
    assert found(whole.risk, "wb", "risk") == [("w", "low")] and whole.whole() is whole and found(workflows.audit(book), "rule") == [("EA-VOL-001",)]
    monkeypatch.setitem(rules.RULES, "EA-ERR-001", lambda a: rules._finding(a.cells.where(F.raise_error(F.lit("boom")).isNull()), "EA-ERR-001", "low", "low", {}))
    report = workflows.audited(book)
    assert found(report.risk, "wb", "risk", "n_low") == [("w", workflows.INCOMPLETE, 1)]
    for read in (report.whole, lambda: workflows.audit(book), lambda: workflows.compare(book, book).summary):
        with pytest.raises(workflows.RulesFailed, match="EA-ERR-001") as e:
            read()
        assert [rule for rule, _ in e.value.failed] == ["EA-ERR-001"]


def test_seven_decimals_and_huge_figures(spark):
    parts = {f"A{i}": (None, v, "0.0000000") for i, v in enumerate([0.12345674, 0.22345674, 0.32345674], 1)} | {f"C{i}": (None, 1e30, "0.00") for i in range(1, 5)}
    r = audit(spark, ("S", parts | {"A4": ("=SUM(A1:A3)", 0.67037022, "0.0000000")})).where("rule = 'EA-RND-001'").collect()
    assert [(x["row"], x["col"]) for x in r] == [(4, 1)]


def test_swapped_sheets_are_renamed_at_once():
    from gridspark.functions.formula import sheets_renamed

    swap = {"A": "B", "B": "A", "C": "Cost $", "It's": "D"}
    assert sheets_renamed("=A!B1+B!B1+C!$A$1+'It''s'!A1+[x]A!A1", swap) == "=B!B1+A!B1+'Cost $'!$A$1+'D'!A1+[x]A!A1"
    assert sheets_renamed("=A!B1+B!B1", {"A": "B", "B": "C"}) == "=B!B1+C!B1" and sheets_renamed("=A!A1~~", swap) == "=A!A1~~"


def test_text_that_is_no_decimal_number(spark):
    from pyspark.sql.types import StringType

    df = spark.createDataFrame([("12d",), ("1f",), ("0x1p3",), (" 1e3 ",), ("-.5",)], "s string")
    assert [r[0] for r in df.select(text.numeric(df["s"], StringType())).collect()] == [None, None, None, 1000.0, -0.5]
    f = spark.createDataFrame([("0 eur",), ("0 USD",), ("0 Bgn",), ("0 gbp",)], "f string")
    assert [r[0] for r in f.select(text.currency(f["f"])).collect()] == ["EUR", "USD", "BGN", "GBP"]


def test_totals_of_areas_equal_plain_sums(spark):
    import random
    from decimal import Decimal

    rng = random.Random(8)
    cells = {(r, c): (None, round(rng.uniform(-50, 50), 3), rng.choice(["0.0", "0.00", "General"])) for r in range(1, 25) for c in range(1, 7) if rng.random() < 0.8}
    areas = {}
    for k in range(60):
        (r1, r2), (c1, c2) = sorted(rng.sample(range(1, 25), 2)), sorted(rng.choices(range(1, 7), k=2))
        at = (rng.randrange(1, 30), rng.randrange(1, 8))
        areas[at] = (r1, c1, r2, c2)
        cells[at] = (f"=SUM({grid_name(r2, c1)}:{grid_name(r1, c2)})", float(k), "0.0")
    a = rules.Audit(sheet(spark, ("S", {grid_name(*at): v for at, v in cells.items()})))
    shown = rules.figures(a.cells)
    figure = {(r["row"], r["col"]): r for r in shown.collect()}
    got = {(r["row"], r["col"]): r for r in rules.formula_totals(a, shown).collect()}
    assert set(got) == set(areas)
    for at, (r1, c1, r2, c2) in areas.items():
        inside = [f for p, f in figure.items() if p != at and r1 <= p[0] <= r2 and c1 <= p[1] <= c2]
        r = got[at]
        assert (r["n"], r["n_bad"]) == (len(inside), sum(f["stored"] is None for f in inside))
        assert r["sum_stored"] == sum((f["stored"] or Decimal(0) for f in inside), Decimal(0)) and r["sum_displayed"] == sum((f["displayed"] or Decimal(0) for f in inside), Decimal(0))


def test_runs_before_typed_totals_equal_plain_sums(spark, monkeypatch):
    import random
    from decimal import Decimal

    monkeypatch.setattr(rules, "MAX_RUN", 5)
    rng = random.Random(9)
    kinds = [(None, 1.25, "0.0"), (None, 2.05, "0.00"), (None, 3.5, "General"), ("=B1+1", 7.75, "0.0"), "text"]
    cells = {(r, c): rng.choices(kinds, [8, 8, 1, 2, 1])[0] for r in range(1, 25) for c in range(1, 20) if rng.random() < 0.9}
    a = rules.Audit(sheet(spark, ("S", {grid_name(*at): v for at, v in cells.items()})))
    figure = {(r["row"], r["col"]): r for r in rules.figures(a.cells).collect()}
    want = {}
    for (r, c), f in figure.items():
        for way, (down, right) in ((rules.BELOW, (1, 0)), (rules.RIGHT, (0, 1))):
            run = []
            while len(run) < 5 and (g := figure.get((r - down * (len(run) + 1), c - right * (len(run) + 1)))) and g["number"]:
                run.append(g)
            if f["number"] and f["typed"] and f["stored"] is not None and len(run) >= 3 and all(g["stored"] is not None for g in run):
                want[r, c, way] = len(run), 0, sum(g["stored"] for g in run), sum(g["displayed"] for g in run)
    got = {(r["row"], r["col"], r["_way"]): (r["n"], r["n_bad"], r["sum_stored"], r["sum_displayed"]) for r in rules._totals(rules.total_areas(a), rules.figures(a.cells)).collect()}
    assert len(want) > 50 and got == want and {n for n, *_ in want.values()} == {3, 4, 5} and isinstance(next(iter(got.values()))[2], Decimal)


def test_cells_are_shuffled_once_for_rounding_drift(spark):
    """Of the two shuffles, the other has only findings; nothing is joined."""
    text_of_plan = plan(rules.RULES["EA-RND-001"](rules.Audit(saved(sheet(spark, ("S", TABLE)), "cells"))))
    assert text_of_plan.count("Exchange hashpartitioning") == 2 and "Join" not in text_of_plan


def grid_name(row, col):
    from gridspark.functions.formula import column_letters

    return f"{column_letters(col)}{row}"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_cells_go_through_the_driver_in_the_graph_and_changes(spark):
    """Cells compress so well that their size in files and shuffles lets them pass for a small side."""
    cells = saved(grid.with_formulas(sheet(spark, ("Budget", TABLE))), "cells")
    edges = graph.edges(saved(graph.areas(cells), "areas"), cells)
    assert "Broadcast" not in plan(edges)
    edges = saved(edges, "edges")
    impact = graph.impact(edges, cells, graph.output_like(cells, edges))
    assert "Broadcast" not in plan(impact)
    changes = saved(diff.cell_changes(cells, cells, diff.match_sheets(cells, cells)), "changes")
    assert "Broadcast" not in plan(diff.rated(changes, saved(impact, "impact").withColumn("unresolved", F.lit(False))))


def test_no_cells_go_through_the_driver_in_rules(spark):
    a = workflows.settled(rules.Audit(sheet(spark, ("t", TABLE))))
    assert "Broadcast" not in plan(rules.RULES["EA-RNG-001"](a))
    assert re.search("SortMergeJoin [^\n]*LeftAnti", plan(rules.RULES["EA-RNG-002"](a)))


def test_gaps_are_found_without_sorting_all_cells(spark):
    """Few gaps are hashed; the cells and lines stream past them."""
    cells = saved(grid.with_formulas(sheet(spark, ("t", TABLE))), "cells")
    text_of_plan = plan(grid.pattern_gaps(cells))
    assert re.search("ShuffledHashJoin [^\n]*BuildLeft", text_of_plan)
    assert "SortMergeJoin" not in text_of_plan and "BuildRight" not in text_of_plan


def test_references_meet_used_ranges_without_being_sorted(spark):
    """A sheet's used range is one row, which is hashed; the references stream past it."""
    a = workflows.settled(rules.Audit(sheet(spark, ("t", TABLE))))
    assert re.search("ShuffledHashJoin [^\n]*Inner, BuildRight", plan(rules.RULES["EA-RNG-002"](a)))


def test_formulas_without_a_span_of_sheets_are_parsed_once(spark):
    parses = spark.sparkContext.accumulator(0)

    @F.pandas_udf(PARSED)
    def counted(formula: pd.Series, row: pd.Series, col: pd.Series) -> pd.DataFrame:
        parses.add(len(formula))
        return formula_functions._parsed(formula, row, col)

    rows = spark.range(1, 41, 1, 2).select(F.lit("w").alias("wb"), F.lit("S").alias("sheet"), F.lit(0).alias("sheet_no"), F.col("id").cast("int").alias("row"), F.lit(2).alias("col"), F.format_string("=A%s+1", "id").alias("formula"))
    found = graph.areas(rows.withColumn("f", counted("formula", "row", "col"))).select("row", "row1", "col1").collect()
    assert sorted(map(tuple, found)) == [(r, r, 1) for r in range(1, 41)] and parses.value == 40
