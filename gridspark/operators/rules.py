"""Audit rules over the cell relation, one DataFrame of findings for each, and what is made of findings.

A finding is a row of :data:`FINDINGS`.  Rules that list examples keep the first so many of each workbook, in canonical order; these limits
are part of what a rule reports.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions import text
from gridspark.functions.formula import coordinate
from gridspark.operators import cells as grid
from gridspark.operators import graph
from gridspark.operators.cells import ADDRESS, SHEET, spread
from gridspark.session import saved

FINDINGS = "wb string, rule string, severity string, confidence string, sheet string, sheet_no int, row int, col int, evidence string"
SEVERITIES = ("info", "low", "medium", "high", "critical")
CONFIDENCES = ("low", "medium", "high")
# Fixed values of the rules.
ERRORS = ("#DIV/0!", "#N/A", "#NAME?", "#NULL!", "#NUM!", "#REF!", "#VALUE!")
VOLATILE = {"INDIRECT": "medium", "OFFSET": "medium", "RAND": "medium", "RANDBETWEEN": "medium", "NOW": "low", "TODAY": "low"}
HARMLESS = (0.0, 1.0, -1.0, 2.0, 12.0, 100.0, 1000.0, 0.5)
AGGREGATIONS = ("SUM", "AVERAGE", "MIN", "MAX", "COUNT", "COUNTA", "SUBTOTAL", "MEDIAN")
TOTALS = ("SUM", "SUBTOTAL")
LONG_FORMULA = 250
GROUP_FROM = 4
MIN_COMPONENTS = 3
MAX_RUN = 200


@dataclass
class Audit:
    """What rules read.  All but ``cells`` are the metadata relations of a source; each may be missing."""

    cells: DataFrame
    sheets: DataFrame | None = None
    workbooks: DataFrame | None = None
    names: DataFrame | None = None
    declared: DataFrame | None = None
    links: DataFrame | None = None

    def __post_init__(self):
        self.parsed = grid.with_formulas(self.cells)

    # What several rules read; a caller may put working tables in their place.
    @cached_property
    def numbered(self) -> DataFrame:
        """``wb``, ``sheet`` and ``sheet_no``."""
        return self.cells.select(*SHEET, "sheet_no").distinct()

    @cached_property
    def gaps(self) -> DataFrame:
        return grid.pattern_gaps(self.parsed).join(self.numbered, SHEET)

    @cached_property
    def areas(self) -> DataFrame:
        return graph.areas(self.parsed, self.names, self.declared)

    @cached_property
    def edge_rows(self) -> DataFrame:
        return graph.edges(self.areas, self.cells)


Rule = Callable[[Audit], DataFrame]
RULES: dict[str, Rule] = {}


def rule(name: str) -> Callable[[Rule], Rule]:
    def keep(f: Rule) -> Rule:
        RULES[name] = f
        return f

    return keep


def _finding(df: DataFrame, name: str, severity: str | Column, confidence: str | Column, evidence: dict[str, Column], limit: int | None = None, place: bool = True) -> DataFrame:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    has = set(df.columns)
    at = [F.col(c) if place and c in has else F.lit(None).cast(t).alias(c) for c, t in (("row", "int"), ("col", "int"))]
    sheet = [F.col(c) if c in has else F.lit(None).cast(t).alias(c) for c, t in (("sheet", "string"), ("sheet_no", "int"))]
    packed = F.to_json(F.struct(*[v.alias(k) for k, v in evidence.items()])) if evidence else F.lit("{}")
    out = df.select("wb", F.lit(name).alias("rule"), as_column(severity).alias("severity"), as_column(confidence).alias("confidence"), *sheet, *at, packed.alias("evidence"))
    if limit is None:
        return out
    order = Window.partitionBy("wb").orderBy("sheet_no", "sheet", "row", "col")
    return out.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


@rule("EA-REF-001")
def broken_references(a: Audit) -> DataFrame:
    """Formulas with #REF!, and names that refer to it in workbooks where formulas gave fewer than the limit."""
    hit = _finding(a.cells.where(F.upper("formula").contains("#REF!")), "EA-REF-001", "high", "high", {"formula": F.col("formula")}, 50)
    if a.names is None:
        return hit
    full = hit.groupBy("wb").count().where(F.col("count") >= 50).select("wb")
    names = a.names.where(F.upper("refers_to").contains("#REF!")).join(full, "wb", "left_anti")
    return hit.unionByName(_finding(names, "EA-REF-001", "high", "high", {"name": F.col("name"), "refers_to": F.col("refers_to")}))


@rule("EA-CIR-001")
def circular_references(a: Audit) -> DataFrame:
    """One finding for each cycle, at its first cell, and for each formula inside its own range that is in no other cycle."""
    spans = a.areas
    loops = graph.interval_cycles(spans)
    members = F.slice(F.array_sort(F.collect_list(F.struct("sheet", "row", "col"))), 1, 20)
    cycle = loops.groupBy("wb", "cycle").agg(members.alias("m"), F.count("*").alias("n")).select("wb", F.col("m")[0]["sheet"].alias("sheet"), F.col("m")[0]["row"].alias("row"), F.col("m")[0]["col"].alias("col"), "n", "m")
    alone = graph.self_loops(spans).join(spread(loops.select(*ADDRESS)), ADDRESS, "left_anti").select(*ADDRESS, F.lit(1).cast("long").alias("n"), F.array(F.struct("sheet", "row", "col")).alias("m"))
    numbered = cycle.unionByName(alone).join(a.numbered, SHEET)
    return _finding(numbered, "EA-CIR-001", "high", "high", {"cells": F.col("n"), "members": F.transform("m", lambda x: F.concat(x["sheet"], F.lit("!"), coordinate(x["row"], x["col"])))})


@rule("EA-CPX-001")
def long_formulas(a: Audit) -> DataFrame:
    return _finding(a.cells.where(F.length("formula") > LONG_FORMULA), "EA-CPX-001", "low", "high", {"length": F.length("formula")}, 20)


@rule("EA-ERR-001")
def error_values(a: Audit) -> DataFrame:
    hit = a.cells.where((F.col("kind") == "e") | F.col("str").isin(*ERRORS))
    return _finding(hit, "EA-ERR-001", F.when(F.col("str") == "#N/A", "low").otherwise("high"), "high", {"error": F.col("str")}, 50)


@rule("EA-EXT-001")
def external_links(a: Audit) -> DataFrame:
    """One finding for each workbook with link targets or formulas that refer to other files."""
    used = graph.references(a.parsed).where("ref.external is not null")
    cells = used.groupBy("wb").agg(F.count_distinct("sheet", "row", "col").alias("cells"))
    targets = graph.link_targets(a.parsed, a.links).groupBy("wb").agg(F.array_sort(F.collect_list(F.struct("place", "target"))).alias("t"))
    found = targets.join(cells, "wb", "left")
    return _finding(found, "EA-EXT-001", "medium", "high", {"targets": F.transform(F.slice("t", 1, 10), lambda x: x["target"]), "cells": F.coalesce("cells", F.lit(0))})


@rule("EA-HRD-001")
def hardcoded_numbers(a: Audit) -> DataFrame:
    """One finding for each sheet, with up to ten examples."""
    odd = F.filter("f.numbers", lambda x: ~x.isin(*HARMLESS) & ((x != F.floor(x)) | (F.abs(x) >= 10)))
    hit = a.parsed.where("size(f.numbers) > 0").withColumn("_odd", odd).where(F.size("_odd") > 0)
    examples = F.slice(F.array_sort(F.collect_list(F.struct("row", "col", "_odd"))), 1, 10)
    by_sheet = hit.groupBy(*SHEET, "sheet_no").agg(F.count("*").alias("total"), examples.alias("_e"))
    return _finding(by_sheet, "EA-HRD-001", "low", "medium", {"total": F.col("total"), "examples": F.transform("_e", lambda x: F.struct(coordinate(x["row"], x["col"]).alias("cell"), x["_odd"].alias("numbers")))})


@rule("EA-HID-001")
def hidden_sheets(a: Audit) -> DataFrame:
    hit = a.sheets.where("visibility <> 'visible'")
    return _finding(hit, "EA-HID-001", F.when(F.col("visibility") == "veryHidden", "medium").otherwise("low"), "high", {"visibility": F.col("visibility")})


@rule("EA-HID-002")
def hidden_data(a: Audit) -> DataFrame:
    """Hidden rows and columns that hold data, the first 50 of each for a workbook."""
    out = []
    for axis, listed in (("row", "hidden_rows"), ("col", "hidden_cols")):
        hidden = a.sheets.select(*SHEET, "sheet_no", F.explode(listed).alias("_at"))
        held = hidden.join(spread(a.cells.select(*SHEET, F.col(axis).alias("_at")).distinct()), [*SHEET, "_at"], "left_semi")
        placed = held.select(*SHEET, "sheet_no", F.col("_at").alias(axis))
        out.append(_finding(placed, "EA-HID-002", "low", "high", {axis: F.col(axis)}, 50))
    return out[0].unionByName(out[1])


def _gaps(a: Audit, anomaly: str) -> DataFrame:
    return a.gaps.where(F.col("anomaly") == anomaly)


@rule("EA-PAT-001")
def overwritten_formulas(a: Audit) -> DataFrame:
    return _finding(_gaps(a, "overwritten_constant"), "EA-PAT-001", "high", "high", {"expected": F.col("expected"), "value": F.col("num")})


@rule("EA-PAT-002")
def inconsistent_formulas(a: Audit) -> DataFrame:
    gaps = _gaps(a, "inconsistent_formula")
    return _finding(gaps, "EA-PAT-002", "high", F.when(F.col("shift").isNotNull(), "high").otherwise("medium"), {"expected": F.col("expected"), "formula": F.col("formula"), "shift": F.col("shift")})


@rule("EA-PAT-003")
def missing_formulas(a: Audit) -> DataFrame:
    return _finding(_gaps(a, "missing_formula"), "EA-PAT-003", "medium", "medium", {"expected": F.col("expected")})


def _workbook(name: str, flag: str, severity: str) -> None:
    @rule(name)
    def opaque(a: Audit) -> DataFrame:
        return _finding(a.workbooks.where(flag), name, severity, "high", {})


_workbook("EA-OPQ-001", "has_macros", "medium")
_workbook("EA-OPQ-002", "has_connections", "medium")
_workbook("EA-OPQ-003", "is_protected", "info")
_workbook("EA-RND-002", "full_precision = false", "medium")


def _shown(cells: DataFrame) -> DataFrame:
    """Cells with ``number``, ``typed`` and ``d`` (decimals that are shown) in place of all but their ``num``."""
    fmt = F.coalesce("number_format", F.lit(""))
    d = F.when((F.col("kind") == "n") & ~fmt.isin("", "General"), text.display_decimals(fmt))
    return cells.select(*ADDRESS, "sheet_no", F.coalesce(F.col("kind") == "n", F.lit(False)), F.col("formula").isNull(), d, "num").toDF(*ADDRESS, "sheet_no", "number", "typed", "d", "num")


def _exact(shown: DataFrame) -> DataFrame:
    known = F.col("d").isNotNull()
    return shown.withColumns({"stored": F.when(known, text.exact(F.col("num"))), "displayed": F.when(known, text.display_rounded(F.col("num"), F.col("d")))}).drop("num")


def figures(cells: DataFrame) -> DataFrame:
    """Cells with ``d`` (decimals that are shown), ``stored`` and ``displayed``; the latter are null where a figure has no exact form."""
    return _exact(_shown(cells))


_SUMS = ("n", "n_bad", "sum_stored", "sum_displayed")
_ENDS = ("row1", "col1", "row2", "col2")
#: The ways to find a total: an area under SUM or SUBTOTAL, the numbers above it, the numbers left of it.
BY_FORMULA, BELOW, RIGHT = 0, 1, 2


def total_areas(a: Audit) -> DataFrame:
    """Addresses of formulas with one area on their own sheet under SUM or SUBTOTAL, and the area's ends."""
    formula = a.parsed.where("formula is not null").where("size(f.refs) = 1").where(F.arrays_overlap("f.functions", F.array(*map(F.lit, TOTALS)))).withColumn("ref", F.col("f.refs")[0])
    own = formula.where("ref.external is null and ref.is_range and ref.row1 is not null and ref.col1 is not null and (ref.sheet is null or upper(ref.sheet) = upper(sheet))")
    return own.select(*ADDRESS, F.least("ref.row1", "ref.row2").alias("row1"), F.least("ref.col1", "ref.col2").alias("col1"), F.greatest("ref.row1", "ref.row2").alias("row2"), F.greatest("ref.col1", "ref.col2").alias("col2"))


def _points(rows: DataFrame) -> DataFrame:
    """Each cell in its column and in its row, and both ends of an area in each line that it has of the kind of which it has fewer.

    ``_flat`` tells rows from columns, ``_sign`` the ends (-1 and 1) from cells (0).
    """
    point = lambda flat, line, at, order, sign: F.struct(flat.alias("_flat"), line.alias("_line"), at.alias("_at"), F.lit(order).alias("_order"), F.lit(sign).alias("_sign"))
    flat = F.col("row2") - F.col("row1") < F.col("col2") - F.col("col1")
    pick = lambda across, along: F.when(flat, F.col(across)).otherwise(F.col(along))
    # An end before a place, the cell at it, an end after it.
    ends = F.flatten(F.transform(F.sequence(pick("row1", "col1"), pick("row2", "col2")), lambda line: F.array(point(flat, line, pick("col1", "row1"), 0, -1), point(flat, line, pick("col2", "row2"), 2, 1))))
    cell = F.array(point(F.lit(False), F.col("col"), F.col("row"), 1, 0), point(F.lit(True), F.col("row"), F.col("col"), 1, 0))
    itself = F.col("row").between(F.col("row1"), F.col("row2")) & F.col("col").between(F.col("col1"), F.col("col2"))
    kept = [c for c in rows.columns if c not in _ENDS]
    return rows.select(*kept, itself.alias("_itself"), F.explode(F.when(F.col("row1").isNotNull(), ends).otherwise(cell)).alias("_p")).select(*kept, "_itself", "_p.*")


def _totals(spans: DataFrame, shown: DataFrame) -> DataFrame:
    """Places that may be totals: address, ``sheet_no``, ``_way``, the sums of the components (``_SUMS``), ``d``, ``stored`` and ``displayed``.

    By formula, these are the sums of what is in the area of ``spans`` (:func:`total_areas`), but for the place itself.  Else the place is a number
    without a formula, and they are those of the run of up to ``MAX_RUN`` numbers right before it along an axis, at least ``MIN_COMPONENTS`` and none without an exact form.

    Cells and areas are shuffled once, by their sheet.  In it, each line of cells is added up once, with the ends of all areas over it among its
    cells: a sum is the difference of two running sums.  All that follows is keyed by the sheet and more, and needs no other shuffle.
    """
    # Not fewer partitions by their compressed size: the lines of a partition are sorted.
    parts = int(shown.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = shown.unionByName(spans, allowMissingColumns=True).repartition(parts, *SHEET)
    points = _points(_exact(rows) if "num" in rows.columns else rows)
    cell, zero = F.col("_sign") == 0, F.lit(0).cast("decimal(38,12)")
    own = {"n": F.lit(1).cast("long"), "n_bad": F.col("stored").isNull().cast("long"), "sum_stored": F.coalesce(F.col("stored").cast("decimal(38,12)"), zero), "sum_displayed": F.coalesce(F.col("displayed").cast("decimal(38,12)"), zero)}
    none = lambda c: F.lit(0).cast("long") if c.startswith("n") else zero
    line = [*SHEET, "_flat", "_line"]
    order = Window.partitionBy(*line).orderBy("_at", "_order").rowsBetween(Window.unboundedPreceding, -1)
    number = cell & F.col("number")
    # Up to each end, and up to each cell without itself.
    running = {f"_{c}": F.coalesce(F.sum(F.when(cell, own[c]).otherwise(none(c))).over(order), none(c)) for c in _SUMS}
    read = points.withColumns({**running, "_island": F.when(number, F.col("_at") - F.coalesce(F.sum(number.cast("int")).over(order), F.lit(0)))}).where(~cell | F.col("number") | ~F.col("typed"))
    run = Window.partitionBy(*line, "_island").orderBy("_at")
    before = lambda c: F.coalesce(F.lag(c, MAX_RUN).over(run), F.first(c).over(run))
    within = {f"_in_{c}": F.col(f"_{c}") - before(f"_{c}") for c in _SUMS if c != "n"} | {"_in_n": (F.col("_at") - before("_at")).cast("long")}
    typed = number & F.col("typed") & F.col("stored").isNotNull() & (F.col("_in_n") >= MIN_COMPONENTS) & (F.col("_in_n_bad") == 0)
    kept = read.withColumns(within).withColumn("_typed", typed).where(~cell | ~F.col("typed") | F.col("_typed"))
    # The rows of a place: the ends of its area, and its cell once for each axis.
    ways = {}
    for c in _SUMS:
        ways[f"{c}_{BY_FORMULA}"] = F.sum(F.when(F.col("_sign") > 0, F.col(f"_{c}")).when(F.col("_sign") < 0, -F.col(f"_{c}")))
        ways[f"{c}_{BELOW}"] = F.max(F.when(F.col("_typed") & ~F.col("_flat"), F.col(f"_in_{c}")))
        ways[f"{c}_{RIGHT}"] = F.max(F.when(F.col("_typed") & F.col("_flat"), F.col(f"_in_{c}")))
    known = ("sheet_no", "d", "stored", "displayed")
    places = kept.groupBy(*ADDRESS).agg(*[v.alias(k) for k, v in ways.items()], *[F.max(F.when(cell, F.col(c))).alias(c) for c in known], F.max("_itself").alias("_itself")).where("stored is not null")
    less = lambda c: F.when(F.col("_itself"), own[c]).otherwise(none(c))
    found = [F.struct(F.lit(w).alias("_way"), *[(F.col(f"{c}_{w}") - less(c) if w == BY_FORMULA else F.col(f"{c}_{w}")).cast(t).alias(c) for c, t in zip(_SUMS, ("long", "long", "decimal(38,12)", "decimal(38,12)"), strict=True)]) for w in (BY_FORMULA, BELOW, RIGHT)]
    return places.select(*ADDRESS, *known, F.explode(F.array(*found)).alias("_w")).select(*ADDRESS, *known, "_w.*").where("n is not null")


def formula_totals(a: Audit, shown: DataFrame) -> DataFrame:
    """Addresses of formulas with one area on their own sheet under SUM or SUBTOTAL, and the sums of what is in the area; ``shown`` are :func:`figures`."""
    return _totals(total_areas(a), shown).where(F.col("_way") == BY_FORMULA).drop("_way")


@rule("EA-RND-001")
def rounding_drift(a: Audit) -> DataFrame:
    """Totals whose displayed components add up to another figure than is displayed, though the stored ones agree.

    A total is a SUM formula or a number under or right of a run of numbers.  It counts if it and all its components have formats with
    fixed decimals and exact forms (see :func:`gridspark.functions.text.exact`).
    """
    found = _totals(total_areas(a), _shown(a.cells))
    both = found.where((F.col("n") >= MIN_COMPONENTS) & (F.col("n_bad") == 0)).withColumns({"unit": text.display_unit(F.col("d")), "drift": F.col("sum_displayed") - F.col("displayed")})
    hit = both.where((F.abs(F.col("sum_stored") - F.col("stored")) < F.col("unit")) & (F.abs("drift") >= F.col("unit")))
    first = hit.withColumn("_n", F.row_number().over(Window.partitionBy(*ADDRESS).orderBy("_way"))).where("_n = 1")
    return _finding(first, "EA-RND-001", "medium", "high", {"components": F.col("n"), "drift": F.col("drift").cast("double"), "displayed_sum": F.col("sum_displayed").cast("double"), "displayed_total": F.col("displayed").cast("double")}, 25)


@rule("EA-RNG-001")
def short_ranges(a: Audit) -> DataFrame:
    """Aggregates over a line of cells that ends right before a number or formula other than the aggregate itself."""
    hit = a.parsed.where(F.arrays_overlap("f.functions", F.array(*map(F.lit, AGGREGATIONS)))).select(*ADDRESS, "sheet_no", F.posexplode("f.refs").alias("nth", "ref"))
    own = hit.where("ref.is_range and ref.external is null and ref.row1 is not null and ref.col1 is not null and (ref.sheet is null or upper(ref.sheet) = upper(sheet))")
    down, right = F.col("ref.col1") == F.col("ref.col2"), F.col("ref.row1") == F.col("ref.row2")
    line = own.where(down != right)
    beyond = line.select("*", F.when(down, F.greatest("ref.row1", "ref.row2") + 1).otherwise(F.col("ref.row1")).alias("_r"), F.when(down, F.col("ref.col1")).otherwise(F.greatest("ref.col1", "ref.col2") + 1).alias("_c")).where("not (_r = row and _c = col)")
    there = a.cells.where("formula is not null or kind = 'n'").select(*SHEET, F.col("row").alias("_r"), F.col("col").alias("_c"))
    found = beyond.join(spread(there), [*SHEET, "_r", "_c"])
    return _finding(found, "EA-RNG-001", "high", "medium", {"range": F.col("ref.text"), "excluded": coordinate(F.col("_r"), F.col("_c"))}, 25)


@rule("EA-RNG-002")
def blank_references(a: Audit) -> DataFrame:
    """One finding for each sheet whose formulas use single blank cells inside the used range, with up to ten examples."""
    single = graph.references(a.parsed).where("not ref.is_range and ref.external is null")
    used = graph.used_ranges(a.cells).select("wb", F.upper("sheet").alias("_upper"), F.col("sheet").alias("_sheet"), "max_row", "max_col")
    at = single.withColumn("_upper", F.upper(F.coalesce("ref.sheet", "sheet"))).join(used.hint("shuffle_hash"), ["wb", "_upper"]).where("ref.row1 <= max_row and ref.col1 <= max_col")
    at = at.select(*ADDRESS, "nth", F.col("_sheet"), F.col("ref.row1").alias("_row"), F.col("ref.col1").alias("_col"))
    there = a.cells.select("wb", F.col("sheet").alias("_sheet"), F.col("row").alias("_row"), F.col("col").alias("_col"))
    blank = at.join(spread(there), ["wb", "_sheet", "_row", "_col"], "left_anti")
    first = blank.groupBy(*ADDRESS).agg(F.min(F.struct("nth", "_sheet", "_row", "_col")).alias("b"))
    by_sheet = first.groupBy(*SHEET).agg(F.count("*").alias("total"), F.slice(F.array_sort(F.collect_list(F.struct("row", "col", "b"))), 1, 10).alias("_e")).join(a.numbered, SHEET)
    shown = F.transform("_e", lambda x: F.struct(coordinate(x["row"], x["col"]).alias("cell"), F.concat(x["b"]["_sheet"], F.lit("!"), coordinate(x["b"]["_row"], x["b"]["_col"])).alias("blank")))
    return _finding(by_sheet, "EA-RNG-002", "low", "low", {"total": F.col("total"), "examples": shown})


@rule("EA-VOL-001")
def volatile_functions(a: Audit) -> DataFrame:
    used = F.array_intersect("f.functions", F.array(*map(F.lit, VOLATILE)))
    hit = a.parsed.where("formula is not null").withColumn("_used", used).where(F.size("_used") > 0)
    worst = F.arrays_overlap("_used", F.array(*[F.lit(k) for k, v in VOLATILE.items() if v == "medium"]))
    return _finding(hit, "EA-VOL-001", F.when(worst, "medium").otherwise("low"), "high", {"functions": F.array_sort("_used")}, 50)


def rank(names: tuple[str, ...], c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, names)), c)


def grouped(findings: DataFrame) -> DataFrame:
    """Repeated findings as one: of a rule on a sheet, up to medium, with an address, four or more; severity and confidence are the greatest.

    ``count`` tells how many a row stands for, ``cells`` the first 30 addresses.  ``related`` of :func:`cross_linked` goes along.
    """
    level, sure = rank(SEVERITIES, F.col("severity")), rank(CONFIDENCES, F.col("confidence"))
    apart = F.row_number().over(Window.partitionBy("wb", "rule", "sheet").orderBy("row", "col"))
    low = (level <= rank(SEVERITIES, F.lit("medium"))) & F.col("row").isNotNull() & F.col("col").isNotNull()
    small = F.count(F.when(low, 1)).over(Window.partitionBy("wb", "rule", "sheet")) < GROUP_FROM
    keyed = findings.withColumn("_key", F.when(~low | small, apart).otherwise(0))
    first = F.min_by(F.struct("row", "col", "evidence"), F.struct("row", "col"))
    related = [F.array_sort(F.array_distinct(F.flatten(F.collect_list("related")))).alias("related")] if "related" in findings.columns else []
    out = keyed.groupBy("wb", "rule", "sheet", "sheet_no", "_key").agg(F.max(F.struct(level.alias("r"), F.col("severity").alias("x"))).alias("s"), F.max(F.struct(sure.alias("r"), F.col("confidence").alias("x"))).alias("c"), first.alias("f"), F.count("*").alias("count"), F.slice(F.array_sort(F.collect_list(F.struct("row", "col"))), 1, 30).alias("cells"), *related)
    return out.select("wb", "rule", F.col("s.x").alias("severity"), F.col("c.x").alias("confidence"), "sheet", "sheet_no", "f.row", "f.col", "f.evidence", "count", "cells", *["related" for _ in related])


DRIFT, MANUAL_FIXES = "EA-RND-001", ("EA-PAT-001", "EA-HRD-001")


def cross_linked(findings: DataFrame) -> DataFrame:
    """``findings`` with ``related``: a drifting total and a manual fix of the same cell name each other's rules."""
    at = findings.where("row is not null and col is not null")
    drift = at.where(F.col("rule") == DRIFT).select(*ADDRESS).distinct()
    fixes = at.where(F.col("rule").isin(*MANUAL_FIXES)).join(spread(drift), ADDRESS, "left_semi").groupBy(*ADDRESS).agg(F.array_sort(F.collect_set("rule")).alias("_fixes"))
    none = F.array().cast("array<string>")
    related = F.when(F.col("_fixes").isNull(), none).when(F.col("rule") == DRIFT, F.col("_fixes")).when(F.col("rule").isin(*MANUAL_FIXES), F.array(F.lit(DRIFT))).otherwise(none)
    return findings.join(spread(fixes), ADDRESS, "left").select(*findings.columns, related.alias("related"))


def risk(findings: DataFrame) -> DataFrame:
    """The risk level of each workbook and how many findings of each severity there are."""
    counts = findings.groupBy("wb").agg(F.max(rank(SEVERITIES, F.col("severity"))).alias("_top"), *[F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES])
    names = F.array(*[F.lit(x) for x in ("minimal", "low", "elevated", "high", "critical")])
    return counts.select("wb", F.element_at(names, F.col("_top").cast("int")).alias("risk"), *[f"n_{s}" for s in SEVERITIES])


def _applicable(a: Audit, only: list[str] | None) -> list[str]:
    """The rules whose relations are there."""
    needs = {"EA-HID-001": a.sheets, "EA-HID-002": a.sheets, "EA-OPQ-001": a.workbooks, "EA-OPQ-002": a.workbooks, "EA-OPQ-003": a.workbooks, "EA-RND-002": a.workbooks}
    return [r for r in RULES if (only is None or r in only) and needs.get(r, a.cells) is not None]


def run(a: Audit, only: list[str] | None = None) -> DataFrame:
    """All findings of all rules whose relations are there, as one plan."""
    return reduce(DataFrame.unionByName, [RULES[r](a) for r in _applicable(a, only)])


#: Rules that run at the same time; each is a few small jobs, which leave a cluster idle one by one.
AT_ONCE = 8
FAILED = "rule string, reason string"


def isolated(a: Audit, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(findings, ``rule`` and ``reason`` of rules that failed).

    Each rule's findings are written to a working table, so that a rule that fails, when it is planned or when it runs, sinks no other.
    """
    spark = a.cells.sparkSession

    def one(name: str) -> DataFrame | tuple[str, str]:
        try:
            return saved(RULES[name](a), f"findings-{name}")
        except Exception as e:  # noqa: BLE001 - whatever a rule raises
            return name, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"

    with ThreadPoolExecutor(AT_ONCE) as pool:
        done = list(pool.map(one, _applicable(a, only)))
    found = [d for d in done if isinstance(d, DataFrame)]
    none = spark.createDataFrame([], FINDINGS)
    return reduce(DataFrame.unionByName, found, none), spark.createDataFrame([d for d in done if not isinstance(d, DataFrame)], FAILED)
