"""Audit and comparison of any number of workbooks at once, and answers with their provenance."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, TimestampNTZType, TimestampType

from gridspark.functions import concepts, text
from gridspark.functions.formula import column_letters, coordinate
from gridspark.operators import cells as grid
from gridspark.operators import columns, diff, graph, rules, table
from gridspark.session import saved


def settled(source: rules.Audit) -> rules.Audit:
    """The same with its cells and read formulas in a working table, as every rule reads them."""
    out = rules.Audit(source.cells, source.sheets, source.workbooks, source.names, source.declared, source.links)
    out.parsed = saved(source.parsed, "parsed-cells")
    out.cells = out.parsed.drop("f")
    return out


def _shared(a: rules.Audit) -> rules.Audit:
    """``a`` with what several rules read in working tables as well; these are written at the same time."""
    makers = {"numbered": lambda: a.numbered, "gaps": lambda: a.gaps, "areas": lambda: a.areas}
    with ThreadPoolExecutor(len(makers)) as pool:
        done = list(pool.map(lambda name: saved(makers[name](), name), makers))
    a.numbered, a.gaps, a.areas = done
    return a


class RulesFailed(Exception):
    """Some rules failed, so that findings are not whole; ``failed`` lists each with its reason."""

    def __init__(self, failed: Sequence[tuple[str, str]]):
        super().__init__("rules failed: " + "; ".join(f"{rule} ({reason})" for rule, reason in failed))
        self.failed = list(failed)


def _none_failed(failed: DataFrame) -> None:
    """Raises :class:`RulesFailed` if any rule did."""
    if rows := failed.collect():
        raise RulesFailed([(r["rule"], r["reason"]) for r in rows])


@dataclass
class Report:
    """``findings`` repeated ones grouped, ``failed`` (``rule``, ``reason``) and ``risk`` of each workbook, and ``left_out``: what its graph does not hold.

    Where rules failed, ``findings`` are those of the others alone, and every level of ``risk`` is ``INCOMPLETE``: its counts are what was found, but
    what was not looked for may be worse.  A workbook without a row in ``risk`` is then not known to be without findings.
    """

    findings: DataFrame
    failed: DataFrame
    risk: DataFrame
    left_out: DataFrame

    def whole(self) -> Report:
        """This report, if all rules ran; else it raises :class:`RulesFailed`."""
        _none_failed(self.failed)
        return self


INCOMPLETE = "incomplete"


def audited(source: rules.Audit) -> Report:
    """All rules, each on its own: one that fails is listed in ``failed`` and the others go on.  :meth:`Report.whole` refuses a report in which any did."""
    book = _shared(settled(source))
    found, failed = rules.isolated(book)
    linked = rules.grouped(rules.cross_linked(found))
    risk = rules.risk(linked)
    if not failed.isEmpty():
        risk = risk.withColumn("risk", F.lit(INCOMPLETE))
    return Report(linked.orderBy("wb", F.desc(rules.rank(rules.SEVERITIES, F.col("severity"))), "rule", "sheet_no", "row", "col"), failed, risk, graph.left_out(book.parsed, book.areas, book.names, book.declared))


def audit(source: rules.Audit) -> DataFrame:
    """Findings of all rules, repeated ones grouped, in order of severity; if any rule failed, :class:`RulesFailed` is raised instead."""
    return audited(source).whole().findings


@dataclass
class Comparison:
    matches: DataFrame
    row_runs: DataFrame
    changes: DataFrame
    items: DataFrame
    failed: DataFrame
    structure: DataFrame | None = None

    @property
    def summary(self) -> DataFrame:
        """Counts of changes and items; if any rule failed, items are not whole and :class:`RulesFailed` is raised instead."""
        _none_failed(self.failed)
        return diff.summary(self.changes, self.items, self.structure)


def compare(old: rules.Audit, new: rules.Audit, align: bool = True) -> Comparison:
    """Changes between two versions, rated by what depends on them in the new one, merged with the findings of the new one.

    Both sides of a pair have the same ``wb``.  ``structure`` is what changed around the cells, if both versions have ``sheets`` and ``workbooks``;
    ``failed`` lists rules that failed on the new one; where it has rows, ``items`` lack what these would have found.
    """
    spark = old.cells.sparkSession
    with ThreadPoolExecutor(2) as pool:
        old, new = pool.map(settled, (old, new))
    matches = saved(diff.match_sheets(old.cells, new.cells), "sheet-matches")
    with ThreadPoolExecutor(2) as pool:  # the new side's shared tables do not wait for the changes
        shared = pool.submit(_shared, new)
        pairs = saved(diff.row_pairs(old.parsed, new.parsed, matches), "row-pairs") if align else None
        changes = saved(diff.cell_changes(old.parsed, new.parsed, matches, pairs), "cell-changes")
        new = shared.result()
    # A removed cell is blank now; formulas that still refer to it depend on it.
    roots = changes.where(F.col("change").isin(*diff.RATED)).select(*graph.ADDRESS)
    points = new.cells.select(*graph.ADDRESS).union(roots).distinct()
    new.edge_rows = saved(graph.edges(new.areas, points), "edges")
    with ThreadPoolExecutor(2) as pool:
        found = pool.submit(rules.isolated, new)
        unsure = spark.createDataFrame([], "wb string, unresolved boolean")
        if new.names is not None or new.declared is not None:
            names, declared = (x if x is not None else spark.createDataFrame([], schema) for x, schema in ((new.names, graph.NAMES), (new.declared, graph.DECLARED)))
            unsure = graph.unresolved(new.parsed, names, declared).select("wb").distinct().withColumn("unresolved", F.lit(True))
        else:
            unsure = new.parsed.where("size(f.names) > 0").select("wb").distinct().withColumn("unresolved", F.lit(True))
        impacts = graph.impact(new.edge_rows, roots, graph.output_like(new.cells, new.edge_rows)).join(unsure, "wb", "left")
        rated = saved(diff.rated(changes, impacts).select(*changes.columns, "severity", "confidence", "outputs"), "rated-changes")
        findings, failed = found.result()
    runs = diff.row_runs(pairs) if pairs is not None else spark.createDataFrame([], "wb string, change string, sheet string, start_row int, count long")
    known = all(x is not None for side in (old, new) for x in (side.sheets, side.workbooks))
    around = lambda side: {"sheets": side.sheets, "workbooks": side.workbooks, "links": side.links, "names": side.names if side.names is not None else spark.createDataFrame([], graph.NAMES)}
    structure = diff.structural_changes(around(old), around(new), matches) if known else None
    return Comparison(matches, runs, rated, diff.review_items(rated, findings), failed, structure)


def trace(source: rules.Audit, at: DataFrame) -> DataFrame:
    """What depends on each of the cells in ``at`` (``wb`` and ``cell``, such as ``'My Sheet'!$D$7``): :data:`gridspark.operators.graph.IMPACT` and a ``message``.

    A text that names no sheet, or a sheet that is not there, gives no row.
    """
    book = _shared(settled(source))
    plain = F.replace("cell", F.lit("$"), F.lit(""))
    sheet = F.trim(F.regexp_extract(plain, r"^(.*)!", 1))
    named = at.select("wb", F.regexp_replace(sheet, "^'|'$", "").alias("_s"), F.upper(F.regexp_extract(plain, r"!([A-Za-z]{1,3})\d+$", 1)).alias("_letters"), F.regexp_extract(plain, r"(\d+)$", 1).try_cast("int").alias("row")).where("_letters <> '' and row is not null")
    number = F.aggregate(F.split("_letters", ""), F.lit(0), lambda n, c: F.when(c == "", n).otherwise(n * 26 + F.ascii(c) - 64)).alias("col")
    roots = named.join(book.numbered.select("wb", "sheet"), (named["wb"] == book.numbered["wb"]) & (F.upper("_s") == F.upper("sheet"))).select(named["wb"], "sheet", "row", number)
    edge_rows = saved(graph.edges(book.areas, book.cells.select(*graph.ADDRESS).union(roots).distinct()), "edges")
    found = graph.impact(edge_rows, roots, graph.output_like(book.cells, edge_rows))
    where = F.when(F.size("sheets") > 0, F.array_join("sheets", ", ")).otherwise("no other sheets")
    reached = F.when(F.size("output_cells") > 0, F.concat(F.lit(" Reaches output cells: "), F.array_join(F.slice("output_cells", 1, 3), "; "), F.lit("."))).otherwise("")
    cell = F.concat("sheet", F.lit("!"), coordinate(F.col("row"), F.col("col")))
    return found.withColumn("message", F.concat(cell, F.lit(" feeds "), F.col("direct").cast("string"), F.lit(" direct and "), F.col("transitive").cast("string"), F.lit(" transitive dependent cell(s) across "), where, F.lit("."), reached))


class NeedsConfirmation(Exception):
    """Several columns fit; ``candidates`` lists them in order, and a choice (from 1) picks one."""

    def __init__(self, what: str, candidates: Sequence[str]):
        super().__init__(f"{what} may be {', '.join(candidates)}")
        self.what, self.candidates = what, list(candidates)


class CannotAnswer(Exception):
    """The question has no safe answer."""


def _forms(name: str) -> set[str]:
    """The name folded, without punctuation, and the same in Latin letters."""
    plain = " ".join("".join(c if c.isalnum() or c == "_" else " " for c in text.fold(name)).split())
    return {plain, "".join(text.CYRILLIC.get(c, c) for c in plain)}


def resolve(df: DataFrame, name: str, choices: list[int] | None = None) -> str:
    """The column that ``name`` means: by exact spelling, else by any folded form, else by what it speaks of.  One choice is taken off for each ambiguity."""
    if df.columns.count(name) == 1:
        return name
    wanted = _forms(name)
    found = [c for c in df.columns if _forms(c) & wanted] or _meant(df, name)
    if not found:
        raise CannotAnswer(f"no column is called {name!r} or holds it")
    return _chosen(repr(name), found, choices)


def _meant(df: DataFrame, name: str) -> list[str]:
    """The columns that share a concept with ``name``; those for amounts must be numeric."""
    wanted = concepts.wanted(F.lit(name))
    shared = [F.array_intersect(wanted, concepts.of_name(F.lit(f.name))) for f in df.schema]
    tests = [columns.fits(s, F.lit(isinstance(f.dataType, NumericType))) for s, f in zip(shared, df.schema, strict=True)]
    return [c for c, fit in zip(df.columns, df.sparkSession.range(1).select(F.array(*tests)).first()[0], strict=True) if fit]


def _chosen(what: str, found: list[str], choices: list[int] | None) -> str:
    """The only one, or the one that a choice picks."""
    if not found:
        raise CannotAnswer(f"no column for {what}")
    if len(found) == 1:
        return found[0]
    if not choices:
        raise NeedsConfirmation(what, found)
    at = choices.pop(0)
    if not 1 <= at <= len(found):
        raise CannotAnswer(f"{at} is none of the {len(found)} candidates for {what}")
    return found[at - 1]


def resolve_value(df: DataFrame, choices: list[int] | None = None) -> str:
    """The only numeric column whose name is no identifier's; several ask for a choice."""
    says = {w for name in grid.IDENTIFIERS for w in _forms(name)}
    numeric = [f.name for f in df.schema if isinstance(f.dataType, NumericType) and not any(set(form.replace("_", " ").split()) & says for form in _forms(f.name))]
    return _chosen("a value", numeric, choices)


def resolve_date(df: DataFrame, hint: str | None = None, choices: list[int] | None = None, deadline: bool = False) -> str:
    """The column that ``hint`` names or means, else the only one with dates; several ask for a choice, but for a ``deadline`` the only one that speaks of a due date is taken."""
    if hint and (any(_forms(c) & _forms(hint) for c in df.columns) or _meant(df, hint)):
        return resolve(df, hint, choices)
    dates = [f.name for f in df.schema if isinstance(f.dataType, DateType | TimestampType | TimestampNTZType)]
    due = _meant(df.select(*[df[f"`{c}`"] for c in dates]), "due date") if deadline and len(dates) > 1 else []
    return _chosen("a date", due if len(due) == 1 else dates, choices)


def by_month(df: DataFrame, function: str, column: str | None = None, *, date: str | None = None, filters: Sequence[table.Filter] = (), choices: Sequence[int] = ()) -> DataFrame:
    """One aggregate for each month of a date column, which is found by hint or by type; so is the value's where none is named."""
    left = list(choices)
    value = resolve(df, column, left) if column else None if function == "count" else resolve_value(df, left)
    when = resolve_date(df, date, left)
    return table.aggregate(df, function, value, filters=filters, group_by=[when])


@dataclass
class Answer:
    """A value or rows with where they come from; ``status`` is ``verified``, or ``review_recommended`` if there are warnings."""

    rows: DataFrame
    value: Any
    column: str | None
    filters: list[str]
    rows_total: int
    rows_included: int
    rows_blank: int
    warnings: list[str] = field(default_factory=list)

    @property
    def status(self) -> str:
        return "review_recommended" if self.warnings else "verified"


def answer(df: DataFrame, function: str, column: str | None = None, *, filters: Sequence[table.Filter] = (), group_by: Sequence[str] = (), choices: Sequence[int] = ()) -> Answer:
    """One aggregate with its provenance, from a single job: counts and warnings go along in the same pass as the value."""
    left = list(choices)
    column = resolve(df, column, left) if column else None
    filters = [table.Filter(resolve(df, f.column, left), f.operator, f.value) for f in filters]
    groups = [resolve(df, g, left) for g in group_by]
    kept = F.lit(True)
    for f in filters:
        kept = kept & F.coalesce(table.condition(df, f), F.lit(False))
    marked = df.withColumn("_kept", kept)
    only = F.when(F.col("_kept"), df[f"`{column}`"]) if column else None
    inner = marked.withColumn("_value", only) if column else marked
    missing = F.count_if(F.col("_kept")) - (F.count(text.numeric(F.col("_value"), df.schema[column].dataType)) if column and function not in ("count", "distinct_count") else F.count_if(F.col("_kept") & (F.col("_value").isNotNull() if column and function == "distinct_count" else F.lit(True))))
    value = table.aggregate_column(inner, function, "_value" if column else None, F.col("_kept"))
    bad = table.unreadable(df, filters)
    one = inner.agg(value.alias("value"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("_kept")).alias("kept"), missing.alias("blank"), *[b.alias(f"bad{i}") for i, b in enumerate(bad)]).first()
    warnings = [f"{one['blank']} rows have no usable value in {column}"] if one["blank"] else []
    warnings += [f"{one[f'bad{i}']} values are no dates" for i in range(len(bad)) if one[f"bad{i}"]]
    rows = table.aggregate(df, function, column, filters=filters, group_by=groups)
    return Answer(rows, one["value"], column, [str(f) for f in filters], one["n"], one["kept"], one["blank"], warnings)


def listed(df: DataFrame, order_by: Sequence[str], *, filters: Sequence[table.Filter] = (), limit: int | None = None, choices: Sequence[int] = ()) -> Answer:
    """The first rows that match, with how many there are as ``value``: rows, counts and values that are no dates come from one job.

    At most ``MAX_LISTED`` rows are held, in the order of the columns in ``order_by`` (one at least); where more match, a warning says so.
    """
    if not order_by:
        raise ValueError("rows are listed in the order of some column")
    left = list(choices)
    order = [resolve(df, c, left) for c in order_by]
    filters = [table.Filter(resolve(df, f.column, left), f.operator, f.value) for f in filters]
    bad = table.unreadable(df, filters)
    before, after = Observation(), Observation()
    seen = df.observe(before, F.count(F.lit(1)).alias("n"), *[b.alias(f"bad{i}") for i, b in enumerate(bad)])
    found = table.where(seen, filters).observe(after, F.count(F.lit(1)).alias("n"))
    # No input is known to be in the order of a struct; one that is in the wanted order would be read only up to the limit.
    rows = table.list_rows(found, [F.struct(*[F.col(f"`{c}`") for c in order])], limit=limit)
    held = df.sparkSession.createDataFrame(rows.collect(), df.schema)
    n, shown = after.get["n"], min(limit or table.MAX_LISTED, table.MAX_LISTED)
    warnings = [f"only the first {shown} of {n} rows are listed"] if n > shown else []
    warnings += [f"{before.get[f'bad{i}']} values are no dates" for i in range(len(bad)) if before.get[f"bad{i}"]]
    return Answer(held, n, None, [str(f) for f in filters], before.get["n"], n, 0, warnings)


def detect(cells: DataFrame, declared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Tables and their columns."""
    found = grid.tables(cells, declared)
    return found, grid.table_columns(cells, found)


def frame(cells: DataFrame, found: dict[str, Any]) -> DataFrame:
    """The body of one detected table (a row of :func:`gridspark.operators.cells.tables`) as a wide DataFrame; repeated headers get their column's letter."""
    inside = cells.where((F.col("wb") == found["wb"]) & (F.col("sheet") == found["sheet"]) & F.col("col").between(found["first_col"], found["last_col"]))
    heads = inside.where(F.col("row").between(found["header_row"], found["first_data"] - 1)).orderBy("row").select("col", F.coalesce("str", F.col("num").cast("string")).alias("name")).collect()
    names: dict[int, str] = {}
    for h in heads:
        names[h["col"]] = f"{names[h['col']]} / {h['name']}" if h["col"] in names else h["name"]
    twice = {n for n in names.values() if list(names.values()).count(n) > 1}
    names = {c: f"{n} ({column_letters(c)})" if n in twice else n for c, n in names.items()}
    body = inside.where(F.col("row").between(found["first_data"], found["last_data"]) & ~F.col("row").isin(list(found["total_rows"])) & F.col("kind").isNotNull())
    kinds = {r["col"]: r["kind"] for r in body.groupBy("col").agg(F.when(F.min("kind") == F.max("kind"), F.min("kind")).otherwise("s").alias("kind")).collect()}
    values = {"n": F.col("num"), "d": F.col("ts"), "b": F.col("num").cast("boolean")}
    as_text = F.coalesce("str", F.col("num").cast("string"), F.col("ts").cast("string"))
    picked = [F.first(F.when(F.col("col") == c, values.get(kinds.get(c, "s"), as_text)), ignorenulls=True).alias(n) for c, n in sorted(names.items())]
    return body.groupBy("row").agg(*picked).orderBy("row")
