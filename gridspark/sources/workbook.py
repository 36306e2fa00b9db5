"""Workbooks (.xlsx, .xlsm) as relations: files are listed and read by Spark, one task for each, in any file system that Spark reaches.

A file is checked before it is opened up: its kind, the number, names and sizes of its entries, and how much they expand.  What
fails, or is damaged anywhere inside, is a row of :func:`rejected` and gives no other row, never an exception that ends the job.

A workbook's key is the SHA-256 of its file, or ``wb`` of the source if it has that column, by which the versions of a pair get one key.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.functions.formula import column_number, translated
from gridspark.operators.cells import CELLS
from gridspark.operators.graph import DECLARED, LINKS, NAMES
from gridspark.operators.rules import Audit
from gridspark.session import new_path

MAX_ENTRIES, MAX_EXPANDED, MAX_RATIO, RATIO_FROM = 10_000, 250 << 20, 200, 10 << 20
WORKBOOKS = "wb string, path string, bytes long, has_macros boolean, has_connections boolean, is_protected boolean, full_precision boolean"
SHEETS = "wb string, sheet string, sheet_no int, visibility string, hidden_rows array<int>, hidden_cols array<int>, merged array<string>, is_protected boolean"
SETTINGS = "wb string, calc_mode string, lock_structure boolean, lock_windows boolean"
# Fixed values of the format: built-in number formats that show dates, and the texts of some others.
_DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}
_FORMATS = {0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 14: "mm-dd-yy", 22: "m/d/yy h:mm", 37: "#,##0 ;(#,##0)", 39: "#,##0.00;(#,##0.00)", 49: "@"}
_QUOTED = re.compile(r'"[^"]*"|\\.|\[[^\]]*\]')
_ADDRESS = re.compile(r"([A-Z]+)([0-9]+)")


class Rejected(ValueError):
    """The file is no workbook that may be opened."""


def _tag(e) -> str:
    return e.tag.rpartition("}")[2]


def _attr(e, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _plain(head: bytes) -> None:
    if b"<!DOCTYPE" in head or b"<!ENTITY" in head:
        raise Rejected("a document type declaration")


def opened(content: bytes) -> zipfile.ZipFile:
    """The file's container, if it is one that may be read."""
    if content[:4] != b"PK\x03\x04":
        raise Rejected("not a workbook container")
    try:
        box = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise Rejected("a damaged container") from e
    entries = box.infolist()
    names = {e.filename for e in entries}
    expanded = sum(e.file_size for e in entries)
    if len(entries) > MAX_ENTRIES:
        raise Rejected("too many entries")
    if any(n.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", n) for n in names):
        raise Rejected("an entry outside the container")
    if expanded > MAX_EXPANDED or expanded > RATIO_FROM and expanded > MAX_RATIO * max(1, len(content)):
        raise Rejected("it expands too much")
    if not {"xl/workbook.xml", "[Content_Types].xml"} <= names:
        raise Rejected("not a workbook")
    return box


class Reader:
    """One workbook's relations, as lists of rows."""

    def __init__(self, path: str, content: bytes, wb: str | None = None):
        self.box = opened(content)
        self.names = set(self.box.namelist())
        self.wb, self.path, self.bytes = wb or hashlib.sha256(content).hexdigest(), path, len(content)
        self.book = self._xml("xl/workbook.xml")
        self.links = self._relations("xl/workbook.xml")
        self.strings = ["".join(t.text or "" for t in si.iter() if _tag(t) == "t") for si in self._all("xl/sharedStrings.xml", "si")]
        props = next((e for e in self.book if _tag(e) == "workbookPr"), None)
        self.epoch = datetime(1904, 1, 1) if props is not None and _attr(props, "date1904") in ("1", "true") else datetime(1899, 12, 30)
        self._styles()
        self.listed = [(_attr(s, "name"), _attr(s, "state") or "visible", self.links.get(_attr(s, "id"), "")) for e in self.book if _tag(e) == "sheets" for s in e]

    def _xml(self, name: str):
        data = self.box.read(name)
        _plain(data[:4096])
        return ElementTree.fromstring(data)

    def _all(self, name: str, tag: str) -> list:
        return [e for e in self._xml(name).iter() if _tag(e) == tag] if name in self.names else []

    def _relations(self, name: str) -> dict[str, str]:
        """Id -> entry name of what a part refers to."""
        folder, _, own = name.rpartition("/")
        out = {}
        for r in self._all(f"{folder}/_rels/{own}.rels", "Relationship"):
            target = r.get("Target", "")
            parts: list[str] = [] if target.startswith("/") else folder.split("/")
            for p in target.strip("/").split("/"):
                if p == "..":
                    parts = parts[:-1]
                elif p != ".":
                    parts.append(p)
            out[r.get("Id")] = "/".join(parts)
        return out

    def _styles(self) -> None:
        own, fonts, fills, self.styles = dict(_FORMATS), [], [], []
        root = self._xml("xl/styles.xml") if "xl/styles.xml" in self.names else []
        for part in root:
            if _tag(part) == "numFmts":
                own.update({int(e.get("numFmtId")): e.get("formatCode", "") for e in part})
            elif _tag(part) == "fonts":
                fonts = ["".join(str(int(any(_tag(x) == mark and x.get("val") not in ("0", "false") for x in f))) for mark in ("b", "i", "u")) for f in part]
            elif _tag(part) == "fills":
                fills = [next((x.get("rgb") or x.get("theme") or "" for x in f.iter() if _tag(x) == "fgColor"), "") for f in part]
            elif _tag(part) == "cellXfs":
                for x in part:
                    number, font, fill = (int(x.get(k, 0)) for k in ("numFmtId", "fontId", "fillId"))
                    code = own.get(number, "General")
                    dated = number in _DATE_FORMATS or (number not in _FORMATS and bool(re.search("[ymdhs]", _QUOTED.sub("", code.lower()).replace("general", ""))))
                    self.styles.append((code, f"{code}|{fonts[font] if font < len(fonts) else '000'}|{fills[fill] if fill < len(fills) else ''}", dated))

    def everything(self) -> Iterator[tuple[str, tuple]]:
        """(relation, row) of all that is in the workbook, as it is read; no sheet is held."""
        for number, (sheet, state, part) in enumerate(self.listed):
            yield from self._sheet(number, sheet, state, part)
        for relation, rows in (("names", self._names_defined()), ("declared", self._declared()), ("links", self._links()), ("workbooks", self._workbook()), ("settings", self._settings())):
            for row in rows:
                yield relation, row

    def _closed(self, part: str) -> Iterator:
        """The elements of a sheet as they end, cells with all that is in them; what is given out is let go when the next one is asked for."""
        with self.box.open(part) as f:
            _plain(f.read(4096))
        with self.box.open(part) as f:
            above: list = []
            inside = 0
            for event, e in ElementTree.iterparse(f, ("start", "end")):
                cell = _tag(e) == "c"
                if event == "start":
                    above.append(e)
                    inside += cell
                    continue
                above.pop()
                inside -= cell
                if not inside:
                    yield e
                    if above:
                        above[-1].remove(e)

    def _sheet(self, number: int, sheet: str, state: str, part: str) -> Iterator[tuple[str, tuple]]:
        """A sheet's cells, and its own row when all have been seen."""
        shared: dict[str, tuple[str, int, int]] = {}
        rows, cols, merged, locked = set(), set(), [], False
        for e in self._closed(part) if part in self.names else ():
            tag = _tag(e)
            if tag == "c":
                row = self._cell(number, sheet, e, shared)
                if row:
                    yield "cells", row
            elif tag == "mergeCell":
                merged.append(e.get("ref"))
            elif tag == "sheetProtection":
                locked = True
            elif tag in ("row", "col") and e.get("hidden") in ("1", "true"):
                if tag == "row":
                    rows.add(int(e.get("r")))
                else:
                    cols.update(range(int(e.get("min")), min(int(e.get("max")), 16_384) + 1))
        yield "sheets", (self.wb, sheet, number, state, sorted(rows), sorted(cols), sorted(merged), locked)

    def _cell(self, number: int, sheet: str, c, shared: dict[str, tuple[str, int, int]]) -> tuple | None:
        letters, digits = _ADDRESS.match(c.get("r")).groups()
        row, col = int(digits), column_number(letters)
        code, style, dated = self.styles[int(c.get("s", 0))] if self.styles else ("General", "", False)
        parts = {_tag(e): e for e in c}
        f, v = parts.get("f"), parts.get("v")
        formula = None
        if f is not None:
            formula = f"={f.text}" if f.text else None
            if f.get("t") == "shared" and formula:
                shared[f.get("si")] = formula, row, col
            elif f.get("t") == "shared" and f.get("si") in shared:
                first, r, k = shared[f.get("si")]
                formula = translated(first, row - r, col - k)
        kind, num, text, moment = None, None, None, None
        raw = v.text if v is not None else None
        sort = c.get("t", "n")
        if sort == "inlineStr" and "is" in parts:
            kind, text = "s", "".join(t.text or "" for t in parts["is"].iter() if _tag(t) == "t")
        elif raw is not None:
            if sort == "s":
                kind, text = "s", self.strings[int(raw)]
            elif sort in ("str", "e", "d"):
                kind, text = "e" if sort == "e" else "s", raw
            elif sort == "b":
                kind, num = "b", float(raw)
            else:
                kind, num = "n", float(raw)
                if dated and 0 <= num < 2_958_466:
                    kind, moment, num = "d", self.epoch + timedelta(milliseconds=round(num * 86_400_000)), None
        return (self.wb, sheet, number, row, col, kind, num, text, moment, formula, code, style) if kind is not None or formula is not None else None

    def _names_defined(self) -> Iterator[tuple]:
        for n in (n for e in self.book if _tag(e) == "definedNames" for n in e):
            scope = n.get("localSheetId")
            yield self.wb, n.get("name"), self.listed[int(scope)][0] if scope is not None else None, n.text or ""

    def _declared(self) -> Iterator[tuple]:
        for sheet, _, part in self.listed:
            for target in self._relations(part).values():
                if "/tables/" in target and target in self.names:
                    t = self._xml(target)
                    (c1, r1), (c2, r2) = (_ADDRESS.match(p).groups() for p in (t.get("ref").split(":") * 2)[:2])
                    yield self.wb, sheet, t.get("displayName") or t.get("name"), int(r1), column_number(c1), int(r2), column_number(c2), int(t.get("headerRowCount", 1)), int(t.get("totalsRowCount", 0))

    def _links(self) -> Iterator[tuple]:
        """Targets of the files that the workbook links to, numbered in the order in which formulas name them."""
        order = [self.links.get(_attr(e, "id"), "") for part in self.book if _tag(part) == "externalReferences" for e in part]
        found = [r.get("Target") for part in order for r in self._all(f"{part.rpartition('/')[0]}/_rels/{part.rpartition('/')[2]}.rels", "Relationship") if r.get("Target") and r.get("TargetMode") == "External"]
        parts = sum(bool(re.fullmatch(r"xl/externalLinks/[^/]+\.xml", n)) for n in self.names)
        if not found and parts:
            found = [f"<{parts} external link part(s) present>"]
        for nth, target in enumerate(found, 1):
            yield self.wb, nth, target

    def _element(self, tag: str):
        return next((e for e in self.book if _tag(e) == tag), None)

    def _workbook(self) -> Iterator[tuple]:
        calc = self._element("calcPr")
        full = calc.get("fullPrecision") if calc is not None else None
        yield self.wb, self.path, self.bytes, "xl/vbaProject.bin" in self.names, "xl/connections.xml" in self.names, self._element("workbookProtection") is not None, None if full is None else full in ("1", "true")

    def _settings(self) -> Iterator[tuple]:
        calc, lock = self._element("calcPr"), self._element("workbookProtection")
        locked = lambda name: lock is not None and lock.get(name) in ("1", "true")
        yield self.wb, calc.get("calcMode") if calc is not None else None, locked("lockStructure"), locked("lockWindows")


RELATIONS = {"cells": CELLS, "sheets": SHEETS, "names": NAMES, "declared": DECLARED, "links": LINKS, "workbooks": WORKBOOKS, "settings": SETTINGS}
BATCH, BATCH_CHARS = 20_000, 8_000_000  # rows, and characters of their texts, that a task holds of all relations together
_ARROW = {
    "string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "timestamp_ntz": pa.timestamp("us"),
    "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
}


def _contents(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Path, content and key of each file; Spark bounds a batch by its bytes (``spark.sql.execution.arrow.maxBytesPerBatch``), and only one file is copied out of it at a time."""
    columns = [batch.column(c) if c in batch.schema.names else pa.nulls(len(batch)) for c in ("path", "content", "wb")]
    for row in zip(*columns, strict=True):
        yield tuple(v.as_py() for v in row)


def _arrow(rows: list[tuple], columns: dict[str, str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, _ARROW[kind], from_pandas=True) for values, kind in zip(zip(*rows, strict=True), columns.values(), strict=True)], names=list(columns))


def read(source: DataFrame, relation: str = "cells") -> DataFrame:
    """One relation of the workbooks in ``source`` (``path`` and ``content``, as ``binaryFile`` gives them, streamed or not, and ``wb`` if keys are given).

    A file's rows are given out when all of it has been read, so that a damaged one gives none in any relation.
    """
    schema, columns = RELATIONS[relation], _OWN[relation]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, wb in _contents(batch):
                done: list[pa.RecordBatch] = []
                held: list[tuple] = []
                try:
                    for kind, row in Reader(path, content, wb).everything():
                        if kind == relation:
                            held.append(row)
                            if len(held) >= BATCH:
                                done.append(_arrow(held, columns))
                                held = []
                except Exception:  # noqa: BLE001 - whatever a damaged file brings about; it is a row of rejected()
                    continue
                yield from done
                if held:
                    yield _arrow(held, columns)

    return _slim(source).mapInArrow(run, schema)


def _slim(source: DataFrame) -> DataFrame:
    return source.select("path", "content", *[c for c in ("wb",) if c in source.columns])


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xls[xm]").load(path)


_REJECTED = "path string, reason string"
_OWN = {r: dict(c.split() for c in schema.split(", ")) for r, schema in (RELATIONS | {"rejected": _REJECTED}).items()}
_TABLE = {"relation": "string"} | {name: kind for columns in _OWN.values() for name, kind in columns.items()}


class Books:
    """All relations of some workbooks in one working table, from one parse of each file."""

    def __init__(self, table: DataFrame):
        self.table = table
        self.rejected = table.where("relation = 'rejected'").select("path", "reason")
        self._whole = self.rejected.isEmpty()

    def read(self, relation: str = "cells") -> DataFrame:
        """One relation; what was read of a file before it turned out to be damaged is left out."""
        rows = self.table.where(F.col("relation") == relation)
        rows = rows if self._whole else rows.join(self.rejected.select("path").distinct(), "path", "left_anti")
        return rows.select(*_OWN[relation])

    def audit(self) -> Audit:
        return Audit(*(self.read(r) for r in ("cells", "sheets", "workbooks", "names", "declared", "links")))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of all relations of the files in ``batches``; what is held does not grow with their number, nor with a sheet."""
    held: dict[str, list[tuple]] = {r: [] for r in _OWN}
    rows = chars = 0

    def taken() -> Iterator[pa.RecordBatch]:
        for relation, columns in _OWN.items():
            if held[relation]:
                own = _arrow([r for r, _ in held[relation]], columns)
                found = dict(zip(columns, own.columns, strict=True)) | {"relation": pa.array([relation] * len(own), pa.string()), "path": pa.array([p for _, p in held[relation]], pa.string())}
                held[relation] = []
                yield pa.RecordBatch.from_arrays([found[n] if n in found else pa.nulls(len(own), _ARROW[kind]) for n, kind in _TABLE.items()], names=list(_TABLE))

    for batch in batches:
        for path, content, wb in _contents(batch):
            reason, start = None, {r: len(own) for r, own in held.items()}
            try:
                for relation, row in Reader(path, content, wb).everything():
                    held[relation].append((row, path))
                    rows += 1
                    chars += sum(len(v) for v in row if isinstance(v, (str, list)))
                    if rows >= BATCH or chars >= BATCH_CHARS:
                        yield from taken()
                        rows, chars, start = 0, 0, dict.fromkeys(_OWN, 0)
            except Rejected as e:
                reason = str(e)
            except Exception as e:  # noqa: BLE001 - as in read()
                reason = f"damaged: {type(e).__name__}: {e}"
            if reason is not None:
                for r, own in held.items():
                    del own[start[r] :]
                held["rejected"].append(((path, reason), path))
                rows = sum(map(len, held.values()))
                if rows >= BATCH:
                    yield from taken()
                    rows = chars = 0
    yield from taken()


def unpacked(source: DataFrame) -> Books:
    """The workbooks in ``source`` (as for :func:`read`, not streamed), each parsed once; rows leave a task as they are read, so that no sheet is held.

    The table has a column for each column of any relation, and lies in a folder for each relation; of one file, all rows have its ``path``.
    """
    spark, path = source.sparkSession, new_path(source.sparkSession, "workbooks")
    schema = ", ".join(f"{name} {kind}" for name, kind in _TABLE.items())
    _slim(source).mapInArrow(_parsed, schema).write.partitionBy("relation").parquet(path)
    return Books(spark.read.schema(schema).parquet(path))


def audit_source(source: DataFrame) -> Audit:
    """All relations of the workbooks in ``source``, as rules read them; each file is parsed once, now."""
    return unpacked(source).audit()


def rejected(source: DataFrame) -> DataFrame:
    """``path`` and ``reason`` of files that are not read; found by reading all of every file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content, wb in _contents(batch):
                try:
                    for _ in Reader(path, content, wb).everything():
                        pass
                except Rejected as e:
                    out.append((path, str(e)))
                except Exception as e:  # noqa: BLE001 - as in read()
                    out.append((path, f"damaged: {type(e).__name__}: {e}"))
            if out:
                yield _arrow(out, _OWN["rejected"])

    return _slim(source).mapInArrow(run, _REJECTED)


def workbook_ids(source: DataFrame) -> DataFrame:
    return source.select("path", F.sha2("content", 256).alias("wb"))
