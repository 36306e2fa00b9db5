"""Workbooks written by hand as zipped XML, read back as relations, in batches and as a stream."""

import io
import tracemalloc
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gridspark import queries
from gridspark.plans import workflows
from gridspark.sources import workbook
from gridspark.streaming import ingest

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
BOOK = f"""<workbook {MAIN}><workbookPr/><workbookProtection lockStructure="1"/><sheets><sheet name="One" sheetId="1" r:id="rId1"/><sheet name="Two" sheetId="2" state="hidden" r:id="rId2"/></sheets>
<definedNames><definedName name="Rate">One!$B$1</definedName><definedName name="Rate" localSheetId="1">Two!$A$1</definedName></definedNames><calcPr fullPrecision="0"/></workbook>"""
LINKS = '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>'
STYLES = f"""<styleSheet {MAIN}><numFmts><numFmt numFmtId="164" formatCode="yyyy-mm-dd"/><numFmt numFmtId="165" formatCode="€#,##0.00"/></numFmts><fonts><font/><font><b/></font></fonts>
<fills><fill/></fills><cellXfs><xf numFmtId="0" fontId="0" fillId="0"/><xf numFmtId="164" fontId="0" fillId="0"/><xf numFmtId="165" fontId="1" fillId="0"/></cellXfs></styleSheet>"""
STRINGS = f"<sst {MAIN}><si><t>Name</t></si><si><r><t>rich </t></r><r><t>text</t></r></si></sst>"
ONE = f"""<worksheet {MAIN}><cols><col min="3" max="4" hidden="1"/></cols><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1"><v>2.5</v></c><c r="C1" s="1"><v>45366</v></c><c r="D1" t="b"><v>1</v></c><c r="E1" t="e"><v>#N/A</v></c></row>
<row r="2" hidden="1"><c r="A2" t="s"><v>1</v></c><c r="B2" s="2"><f t="shared" ref="B2:B4" si="0">A2*$B$1</f><v>5</v></c><c r="C2" t="inlineStr"><is><t>in line</t></is></c><c r="D2" t="str"><f>A2&amp;"x"</f><v>yx</v></c></row>
<row r="3"><c r="B3"><f t="shared" si="0"/><v>7</v></c><c r="C3" s="1"/></row><row r="4"><c r="B4"><f t="shared" si="0"/></c></row></sheetData><mergeCells><mergeCell ref="A5:B6"/></mergeCells></worksheet>"""
TWO = f"<worksheet {MAIN}><sheetData><row r='1'><c r='A1'><v>1</v></c></row></sheetData><sheetProtection sheet='1'/></worksheet>"
TABLE = f'<table {MAIN} displayName="Sales" ref="A1:C4" totalsRowCount="1"/>'
PARTS = {
    "[Content_Types].xml": "<Types/>", "xl/workbook.xml": BOOK, "xl/_rels/workbook.xml.rels": LINKS, "xl/styles.xml": STYLES, "xl/sharedStrings.xml": STRINGS, "xl/worksheets/sheet1.xml": ONE, "xl/worksheets/sheet2.xml": TWO,
    "xl/worksheets/_rels/sheet1.xml.rels": '<Relationships><Relationship Id="r1" Target="../tables/table1.xml"/></Relationships>', "xl/tables/table1.xml": TABLE, "xl/vbaProject.bin": "x",
}


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("books")
    (path / "good.xlsx").write_bytes(zipped(PARTS))
    (path / "text.xlsx").write_bytes(b"hello")
    (path / "empty.xlsm").write_bytes(zipped({"a": "b"}))
    (path / "bomb.xlsx").write_bytes(zipped(PARTS | {"xl/media/big": "0" * (11 << 20)}))
    (path / "up.xlsx").write_bytes(zipped(PARTS | {"../evil": "x"}))
    (path / "entity.xlsx").write_bytes(zipped(PARTS | {"xl/workbook.xml": "<!DOCTYPE x [<!ENTITY a 'b'>]>" + BOOK}))
    (path / "other.txt").write_bytes(b"not listed")
    return str(path)


def test_cells(spark, folder):
    rows = {(r["sheet"], r["row"], r["col"]): r for r in workbook.read(workbook.files(spark, folder)).collect()}
    assert len(rows) == 12
    one = lambda r, c: rows["One", r, c]
    assert (one(1, 1)["kind"], one(1, 1)["str"], one(2, 1)["str"], one(2, 3)["str"]) == ("s", "Name", "rich text", "in line")
    assert (one(1, 2)["num"], one(1, 4)["kind"], one(1, 5)["kind"], one(1, 5)["str"]) == (2.5, "b", "e", "#N/A")
    assert (one(1, 3)["kind"], str(one(1, 3)["ts"])) == ("d", "2024-03-15 00:00:00")
    assert [one(r, 2)["formula"] for r in (2, 3, 4)] == ["=A2*$B$1", "=A3*$B$1", "=A4*$B$1"] and one(4, 2)["kind"] is None
    assert (one(2, 2)["number_format"], one(2, 2)["style"], one(2, 4)["formula"]) == ("€#,##0.00", "€#,##0.00|100|", '=A2&"x"')


def test_metadata(spark, folder):
    files = workbook.files(spark, folder)
    s = {r["sheet"]: r for r in workbook.read(files, "sheets").collect()}
    assert (s["One"]["hidden_rows"], s["One"]["hidden_cols"], s["One"]["merged"], s["Two"]["visibility"], s["Two"]["is_protected"]) == ([2], [3, 4], ["A5:B6"], "hidden", True)
    assert sorted((r["name"], r["scope"] or "", r["refers_to"]) for r in workbook.read(files, "names").collect()) == [("Rate", "", "One!$B$1"), ("Rate", "Two", "Two!$A$1")]
    t = workbook.read(files, "declared").first()
    assert (t["sheet"], t["name"], t["row1"], t["col2"], t["header_rows"], t["totals_rows"]) == ("One", "Sales", 1, 3, 1, 1)
    w = workbook.read(files, "workbooks").first()
    assert (w["has_macros"], w["has_connections"], w["is_protected"], w["full_precision"]) == (True, False, True, False)
    assert w["wb"] in {r["wb"] for r in workbook.workbook_ids(files).collect()}


def test_what_may_not_be_opened_is_listed(spark, folder):
    got = {r["path"].rpartition("/")[2]: r["reason"] for r in workbook.rejected(workbook.files(spark, folder)).collect()}
    assert got == {"text.xlsx": "not a workbook container", "empty.xlsm": "not a workbook", "bomb.xlsx": "it expands too much", "up.xlsx": "an entry outside the container", "entity.xlsx": "a document type declaration"}


def test_a_stream_of_workbooks_is_audited(spark, folder, tmp_path):
    q = ingest.audit_stream(ingest.workbook_stream(spark, folder), f"{tmp_path}/out", f"{tmp_path}/state", once=True)
    q.awaitTermination(300)
    assert q.exception() is None
    rules = {r["rule"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert {"EA-HID-001", "EA-HID-002", "EA-OPQ-001", "EA-OPQ-003", "EA-RND-002", "EA-ERR-001"} <= rules


def test_table_and_frame_from_a_file(spark, folder):
    found, columns = workflows.detect(workbook.read(workbook.files(spark, folder)))
    assert found.count() == 0 and columns.count() == 0  # its blocks have no data under a header


def test_windows_with_late_rows(spark, tmp_path):
    rows = [("2024-01-01 10:00:00", "a", 1.0), ("2024-01-01 12:00:00", "a", None), ("2024-01-02 01:00:00", "b", 3.0)]
    df = spark.createDataFrame(rows, "ts string, k string, v double")
    df.write.parquet(f"{tmp_path}/in")
    want = [("2024-01-01", "a", 2, 1, 1.0), ("2024-01-02", "b", 1, 1, 3.0)]
    show = lambda d: sorted((str(r["start"])[:10], r["k"], r["n_rows"], r["n_values"], r["total"]) for r in d.collect())
    assert show(ingest.windowed(df, "ts", ["k"], "v")) == want
    stream = ingest.windowed(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "ts", ["k"], "v")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert show(spark.table("windows")) == want


def test_damaged_workbooks_are_rejected_whole(spark, tmp_path):
    rows = "".join(f'<row r="{r}"><c r="A{r}"><v>{r}</v></c></row>' for r in range(1, 25_001))
    parts = {
        "second": {"xl/worksheets/sheet2.xml": "<worksheet><broken"}, "number": {"xl/worksheets/sheet2.xml": TWO.replace("<v>1</v>", "<v>abc</v>")}, "string": {"xl/worksheets/sheet2.xml": TWO.replace("r='A1'", "r='A1' t='s'").replace("<v>1</v>", "<v>99</v>")},
        "address": {"xl/worksheets/sheet2.xml": TWO.replace("r='A1'", "")}, "late": {"xl/worksheets/sheet1.xml": f"<worksheet {MAIN}><sheetData>{rows}<row r='25001'><c r='A25001'><v>x</v></c></row></sheetData></worksheet>"},
    }
    for name, own in parts.items():
        (tmp_path / f"{name}.xlsx").write_bytes(zipped(PARTS | own))
    (tmp_path / "good.xlsx").write_bytes(zipped(PARTS))
    files = workbook.files(spark, str(tmp_path))
    assert {r["path"].rpartition("/")[2] for r in workbook.rejected(files).collect()} == {f"{n}.xlsx" for n in parts}
    for relation in workbook.RELATIONS:
        assert workbook.read(files, relation).select("wb").distinct().count() <= 1
    assert workbook.read(files).count() == 12
    keyed = files.where("path like '%good%'").selectExpr("path", "content", "'pair' as wb")
    assert {r["wb"] for r in workbook.read(keyed, "workbooks").collect()} == {"pair"}


def test_one_parse_gives_all_relations(spark, folder, tmp_path):
    files = workbook.files(spark, folder).withColumn("relation", F.lit("clash"))
    books = workbook.unpacked(files)
    show = lambda df: sorted(map(str, df.collect()))
    for relation in workbook.RELATIONS:
        one, each = books.read(relation), workbook.read(files, relation)
        assert one.schema == each.schema and show(one) == show(each)
        assert "MapInPandas" not in one._jdf.queryExecution().toString()  # nothing is parsed again
    assert show(books.rejected) == show(workbook.rejected(files))
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    source = workbook.audit_source(files.select("path", "content").mapInPandas(counted, "path string, content binary"))
    assert source.cells.count() == 12 and source.sheets.count() == 2 and source.names.count() == 2 and source.declared.count() == 1
    assert seen.value == 6  # six files, each asked for once
    nothing = workbook.unpacked(files.limit(0))
    assert nothing.read().isEmpty() and nothing.read("links").isEmpty() and nothing.rejected.isEmpty()


def test_rows_of_a_file_that_breaks_late_are_left_out(spark, tmp_path):
    rows = "".join(f'<row r="{r}"><c r="A{r}"><v>{r}</v></c></row>' for r in range(1, workbook.BATCH + 5_001))
    late = zipped(PARTS | {"xl/worksheets/sheet1.xml": f"<worksheet {MAIN}><sheetData>{rows}</sheetData><broken"})
    books = workbook.unpacked(spark.createDataFrame([("late", late), ("good", zipped(PARTS)), ("none", None)], "path string, content binary"))
    assert books.table.where("path = 'late' and relation = 'cells'").count() == workbook.BATCH
    assert books.read().count() == 12 and {r["path"] for r in books.rejected.collect()} == {"late", "none"}
    assert books.read("sheets").select("wb").distinct().count() == 1


def test_memory_does_not_grow_with_a_sheet():
    def peak(n):
        rows = "".join(f'<row r="{r}"><c r="A{r}" t="inlineStr"><is><t>{r}</t></is></c><c r="B{r}"><f>A{r}*2</f><v>{r}</v></c></row>' for r in range(1, n + 1))
        reader = workbook.Reader("x", zipped(PARTS | {"xl/worksheets/sheet1.xml": f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>"}))
        tracemalloc.start()
        cells = sum(relation == "cells" for relation, _ in reader.everything())
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert cells == 2 * n + 1
        return top

    peak(100)
    assert peak(40_000) < 1.5 * peak(2_000)


def test_memory_does_not_grow_with_the_number_of_files(monkeypatch):
    good = zipped(PARTS | {"xl/worksheets/sheet1.xml": TWO})

    def peak(n):
        batches = (pa.RecordBatch.from_pylist([{"path": f"/{i}-{k}.xlsx", "content": b"no" if k % 5 == 4 else good} for k in range(50)]) for i in range(n // 50))
        tracemalloc.start()
        sizes = [len(out) for out in workbook._parsed(batches)]
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert sum(sizes) == n // 5 + n // 5 * 4 * 9 and max(sizes) <= 500  # two cells, two sheets, two names, a table, the workbook and its settings; no link
        return top

    monkeypatch.setattr(workbook, "BATCH", 500)
    peak(50)
    assert peak(800) < 1.4 * peak(200)
    refused = (pa.RecordBatch.from_pylist([{"path": f"/{i}.xlsx", "content": b"no"}]) for i in range(1_200))
    assert [len(out) for out in workbook._parsed(refused)] == [500, 500, 200]


def test_long_texts_leave_a_task_in_small_batches():
    cells = "".join(f'<row r="{r}"><c r="A{r}" t="s"><v>0</v></c></row>' for r in range(1, 3_001))  # one shared text of 10,000 characters
    book = zipped(PARTS | {"xl/sharedStrings.xml": f"<sst {MAIN}><si><t>{'ab c' * 2_500}</t></si></sst>", "xl/worksheets/sheet1.xml": f"<worksheet {MAIN}><sheetData>{cells}</sheetData></worksheet>"})
    outs = [(len(out), out.nbytes) for out in workbook._parsed(iter([pa.RecordBatch.from_pylist([{"path": "a", "content": book}])]))]
    assert sum(n for n, _ in outs) == 3_001 + 2 + 2 + 1 + 1 + 1
    assert max(size for _, size in outs) < 10_000_000


def test_numbers_that_are_none_and_nulls_are_as_before(spark):
    odd = zipped(PARTS | {"xl/worksheets/sheet2.xml": TWO.replace("<v>1</v>", "<v>nan</v>")})
    source = spark.createDataFrame([("odd", odd, None), ("none", None, "k"), ("good", zipped(PARTS), "k")], "path string, content binary, wb string").coalesce(1)
    books = workbook.unpacked(source)
    assert "MapIn" not in books.read()._jdf.queryExecution().toString()  # nothing is parsed again
    for df in (books.read(), workbook.read(source)):
        assert {(r["wb"] == "k", r["kind"], r["num"]) for r in df.where("sheet = 'Two'").collect()} == {(False, "n", None), (True, "n", 1.0)}
    assert [r["path"] for r in books.rejected.collect()] == ["none"]


def test_workbooks_are_zipped_a_few_at_a_time(spark, tiny):
    plan = queries._books(spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan  # by Arrow, a task holds the sheets of 10,000 workbooks
