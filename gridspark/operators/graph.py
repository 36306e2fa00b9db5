"""The dependency graph of formulas: references as intervals, edges between cells, dependents, cycles and impact.

References stay intervals and are joined with populated cells by bins of rows, so that a range over a whole column costs its
populated cells only.  A workbook's graph is bounded by its file, so what needs a walk (closure, components) runs over one
workbook at a time inside ``applyInPandas``; workbooks spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions.formula import column_letters, parsed
from gridspark.operators.cells import ADDRESS, SHEET, spread
from gridspark.operators.reach import Graph

MAX_RANGE_CELLS = 10_000
ROW_BIN = 256
MANY_DEPENDENTS = 15
ESCALATING_DEPENDENTS = 10
# What makes a cell look like an output of its model.
OUTPUT_SHEETS = ("summary", "dashboard", "report", "p&l", "pnl", "balance", "cash flow", "cashflow", "forecast", "budget")
OUTPUT_LABELS = ("total", "ebitda", "revenue", "profit", "cash", "margin", "net", "subtotal")

NAMES = "wb string, name string, scope string, refers_to string"
LINKS = "wb string, nth int, target string"
DECLARED = "wb string, sheet string, name string, row1 int, col1 int, row2 int, col2 int, header_rows int, totals_rows int"


def used_ranges(cells: DataFrame) -> DataFrame:
    """``wb``, ``sheet``, ``max_row`` and ``max_col``."""
    return cells.groupBy(*SHEET).agg(F.max("row").alias("max_row"), F.max("col").alias("max_col"))


def _area(refs: DataFrame, sheets: DataFrame) -> DataFrame:
    """References with their sheet resolved and their ends ordered and clamped to the used range; areas beyond the cap become a strip."""
    to = sheets.select(F.col("wb"), F.upper("sheet").alias("_upper"), F.col("sheet").alias("to_sheet"), "max_row", "max_col")
    wanted = refs.withColumn("_upper", F.upper(F.coalesce("ref.sheet", "sheet")))
    found = wanted.where("ref.external is null").join(to, ["wb", "_upper"])
    r1, c1 = F.coalesce("ref.row1", F.lit(1)), F.coalesce("ref.col1", F.lit(1))
    r2, c2 = F.coalesce("ref.row2", "max_row"), F.coalesce("ref.col2", "max_col")
    out = found.select(*ADDRESS, "to_sheet", "max_row", "max_col", F.least(r1, r2).alias("row1"), F.least(c1, c2).alias("col1"), F.greatest(r1, r2).alias("_r2"), F.greatest(c1, c2).alias("_c2"))
    out = out.withColumns({"row2": F.least("_r2", F.greatest("max_row", "row1")), "col2": F.least("_c2", F.greatest("max_col", "col1"))})
    large = (F.col("row2") - F.col("row1") + 1).cast("long") * (F.col("col2") - F.col("col1") + 1) > MAX_RANGE_CELLS
    out = out.withColumn("truncated", large)
    return out.select(*ADDRESS, "to_sheet", "row1", "col1", F.when(large, F.least("row2", F.col("row1") + MAX_RANGE_CELLS - 1)).otherwise(F.col("row2")).alias("row2"), F.when(large, F.col("col1")).otherwise(F.col("col2")).alias("col2"), "truncated")


def references(parsed_cells: DataFrame) -> DataFrame:
    """A row for each reference of each formula: its address, ``nth`` and the struct ``ref``."""
    # Inner explodes bring a filter on the size of ``f.refs`` with them, for which the formulas would be parsed once more.
    return parsed_cells.where("formula is not null").select(*ADDRESS, F.posexplode_outer("f.refs").alias("nth", "ref")).where("nth is not null")


def link_targets(parsed_cells: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """``wb``, ``target`` and ``place`` (by which they sort): the workbook's link targets, then what formulas refer to in other files.

    ``links`` is the relation :data:`LINKS`, numbered from 1; a formula's ``[n]`` stands for the n-th of them.
    """
    links = links if links is not None else parsed_cells.sparkSession.createDataFrame([], LINKS)
    refs = parsed_cells.where("formula is not null").select("wb", "sheet_no", "row", "col", F.posexplode("f.refs").alias("nth", "ref"))
    used = refs.where("ref.external <> ''").groupBy("wb", F.col("ref.external").alias("_marker")).agg(F.min(F.struct("sheet_no", "row", "col", "nth")).alias("_at"))
    told = used.join(links.select("wb", F.col("nth").cast("string").alias("_marker"), "target"), ["wb", "_marker"], "left")
    place = lambda k, at: F.concat(F.array(F.lit(k)), F.array(*at)).alias("place")
    found = told.select("wb", F.coalesce("target", "_marker").alias("target"), place(1, ["_at.sheet_no", "_at.row", "_at.col", "_at.nth"]))
    own = links.select("wb", "target", place(0, ["nth", F.lit(0), F.lit(0), F.lit(0)]))
    return own.union(found).groupBy("wb", "target").agg(F.min("place").alias("place"))


def _table_areas(parsed_cells: DataFrame, declared: DataFrame) -> DataFrame:
    """``wb``, ``_table``, ``_column`` (empty: the whole table) and the ``_areas`` of rows of data that they stand for.

    Header and totals rows are left out; where no totals row is declared, one is told by a formula in the last row that uses the table.
    A column is known if one header cell has its text.  A table without rows of data stands for no area.
    """
    sheet, upper = F.col("sheet").alias("_sheet"), F.upper("name").alias("_table")
    known = declared.select("wb", sheet, upper, "row1", "col1", "row2", "col2", "header_rows", "totals_rows")
    at = parsed_cells.select("wb", sheet, F.col("row").alias("_row"), F.col("col").alias("_col"), F.upper(F.trim("str")).alias("_column"), F.upper("formula").alias("_formula"))
    cells = known.join(spread(at), ["wb", "_sheet"]).where("_col between col1 and col2")
    own = cells.where("totals_rows = 0 and _row = row2 and contains(_formula, _table)").select("wb", "_table").distinct().withColumn("_own", F.lit(1))
    data = known.join(own, ["wb", "_table"], "left").withColumns({"_first": F.col("row1") + F.col("header_rows"), "_last": F.col("row2") - F.col("totals_rows") - F.coalesce("_own", F.lit(0))})

    def area(low: str, high: str) -> Column:
        one = F.struct(F.lit(None).cast("string").alias("text"), F.col("_sheet").alias("sheet"), F.lit(None).cast("string").alias("external"), F.col("_first").alias("row1"), F.col(low).alias("col1"), F.col("_last").alias("row2"), F.col(high).alias("col2"), F.lit(True).alias("is_range"))
        return F.when(F.col("_first") <= F.col("_last"), F.array(one)).otherwise(F.filter(F.array(one), lambda x: F.lit(False))).alias("_areas")

    heads = cells.where("header_rows >= 1 and _row = row1 + header_rows - 1 and _column is not null").groupBy("wb", "_table", "_column").agg(F.count("*").alias("_n"), F.min("_col").alias("_col")).where("_n = 1")
    whole = data.select("wb", "_table", F.lit("").alias("_column"), area("col1", "col2"))
    return heads.join(data, ["wb", "_table"]).select("wb", "_table", "_column", area("_col", "_col")).union(whole)


def _name_areas(parsed_cells: DataFrame, names: DataFrame, declared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references that names and table columns stand for, addresses of formulas with a name that cannot be resolved).

    A name of the formula's own sheet goes before one of the workbook.  A name is resolved if it is a constant or nothing but
    areas with a sheet; ``Table[Column]`` and ``Table[]`` as :func:`_table_areas` tells.
    """
    used = parsed_cells.where("size(f.names) > 0").select(*ADDRESS, F.explode("f.names").alias("token"))
    token = F.upper("token")
    known = names.select("wb", F.upper("name").alias("_name"), F.upper("scope").alias("_scope"), parsed(F.concat(F.lit("="), F.regexp_replace("refers_to", "^=", "")), F.lit(1), F.lit(1)).alias("p"))
    good = F.col("p.norm").isNotNull() & ~F.col("p.norm").contains("#REF!") & (F.size("p.names") == 0) & F.forall("p.refs", lambda r: r["sheet"].isNotNull() & r["external"].isNull())
    known = known.select("wb", "_name", "_scope", F.when(good, F.col("p.refs")).alias("areas")).dropDuplicates(["wb", "_name", "_scope"])
    local = known.where("_scope is not null").toDF("wb", "_name", "_scope", "_local")
    everywhere = known.where("_scope is null").select("wb", "_name", F.col("areas").alias("_global"), F.lit(True).alias("_is_global"))
    table, column = (F.regexp_extract("token", r"^([^\[]+)\[([^\[\]#@:']*)\]$", k) for k in (1, 2))
    used = used.select("*", token.alias("_name"), F.upper("sheet").alias("_scope"), F.upper(table).alias("_table"), F.upper(F.trim(column)).alias("_column"))
    seen = used.join(local, ["wb", "_name", "_scope"], "left").join(everywhere, ["wb", "_name"], "left").join(_table_areas(parsed_cells, declared), ["wb", "_table", "_column"], "left")
    areas = seen.select(*ADDRESS, F.coalesce("_local", F.when(F.col("_table") == "", F.col("_global")), "_areas").alias("areas"))
    return areas.where("areas is not null").select(*ADDRESS, F.explode("areas").alias("ref")), areas.where("areas is null").select(*ADDRESS).distinct()


def _unfolded(refs: DataFrame, spanning: DataFrame, parsed_cells: DataFrame) -> DataFrame:
    """References with spans of sheets (``First:Last!A1``) as one reference to each sheet from the first to the last, in the workbook's order; a span whose ends are not both there is none.

    ``spanning`` are those of ``refs`` that may be spans.
    """
    span = F.coalesce(F.col("ref.sheet").contains(":") & F.col("ref.external").isNull(), F.lit(False))
    if "sheet_no" not in parsed_cells.columns:
        return refs.where(~span)
    sheets = parsed_cells.select("wb", "sheet", "sheet_no").distinct()
    end = lambda k: sheets.select("wb", F.upper("sheet").alias(f"_end{k}"), F.col("sheet_no").alias(f"_no{k}"))
    ends = spanning.where(span).select("*", *[F.get(F.split(F.upper("ref.sheet"), ":"), F.lit(k)).alias(f"_end{k}") for k in (0, 1)])
    told = ends.join(end(0), ["wb", "_end0"]).join(end(1), ["wb", "_end1"])
    inside = told.join(sheets.select("wb", F.col("sheet").alias("_sheet"), F.col("sheet_no").alias("_no")), "wb").where("_no between least(_no0, _no1) and greatest(_no0, _no1)")
    return refs.where(~span).unionByName(inside.select(*ADDRESS, F.col("ref").withField("sheet", F.col("_sheet")).alias("ref")))


def _all_references(parsed_cells: DataFrame, names: DataFrame | None, declared: DataFrame | None, of: DataFrame | None = None) -> DataFrame:
    """``ref`` of each formula's address: its own references (of the cells ``of`` alone, if given), and what its names and table columns stand for."""
    spark = parsed_cells.sparkSession
    direct = references(parsed_cells if of is None else of).select(*ADDRESS, "ref")
    if names is None and declared is None:
        return direct
    names = names if names is not None else spark.createDataFrame([], NAMES)
    declared = declared if declared is not None else spark.createDataFrame([], DECLARED)
    return direct.unionByName(_name_areas(parsed_cells, names, declared)[0])


def areas(parsed_cells: DataFrame, names: DataFrame | None = None, declared: DataFrame | None = None) -> DataFrame:
    """What each formula refers to, as intervals: its address, ``to_sheet``, ``row1``, ``col1``, ``row2``, ``col2`` and ``truncated``."""
    # Told by their text before they are parsed, so that formulas without a span are parsed once.
    may_span = parsed_cells.where(F.col("formula").contains(":") & F.col("formula").contains("!"))
    return _area(_unfolded(_all_references(parsed_cells, names, declared), _all_references(parsed_cells, names, declared, of=may_span), parsed_cells), used_ranges(parsed_cells))


def left_out(parsed_cells: DataFrame, found: DataFrame, names: DataFrame | None = None, declared: DataFrame | None = None) -> DataFrame:
    """What the graph does not hold of each workbook: ``wb``, ``kind``, ``n`` and ``cells`` (formulas), and ``example``, the first of these by sheet, row and column.

    Kinds are ``missing_sheet`` (references, spans of sheets too, to sheets without cells), ``truncated`` (areas of ``found``, as :func:`areas` gives them, that
    were cut to a strip), ``unresolved_name`` and ``other_workbook``.  A workbook of which nothing is left out has no row.
    """
    spark = parsed_cells.sparkSession
    refs = _all_references(parsed_cells, names, declared)
    sheets = parsed_cells.select("wb", F.upper("sheet").alias("_upper")).distinct()
    own = refs.where("ref.external is null and ref.sheet is not null").select(*ADDRESS, F.col("ref.text").alias("what"), F.explode(F.split(F.upper("ref.sheet"), ":")).alias("_upper"))
    missing = own.join(sheets, ["wb", "_upper"], "left_anti").select(*ADDRESS, "what").distinct().select(*ADDRESS, F.lit("missing_sheet").alias("kind"))
    cut = found.where("truncated").select(*ADDRESS, F.lit("truncated").alias("kind"))
    empty = lambda x, schema: x if x is not None else spark.createDataFrame([], schema)
    unsure = unresolved(parsed_cells, empty(names, NAMES), empty(declared, DECLARED)).select(*ADDRESS, F.lit("unresolved_name").alias("kind"))
    away = refs.where("ref.external is not null").select(*ADDRESS, F.lit("other_workbook").alias("kind"))
    rows = missing.unionByName(cut).unionByName(unsure).unionByName(away)
    each = rows.groupBy(*ADDRESS, "kind").agg(F.count("*").alias("n"))
    return each.groupBy("wb", "kind").agg(F.sum("n").alias("n"), F.count("*").alias("cells"), F.min(F.struct("sheet", "row", "col")).alias("example"))


def unresolved(parsed_cells: DataFrame, names: DataFrame, declared: DataFrame) -> DataFrame:
    """Addresses of formulas whose dependencies are not fully known."""
    return _name_areas(parsed_cells, names, declared)[1]


def _bins(low: str, high: str) -> Column:
    return F.explode(F.sequence(F.floor(F.col(low) / ROW_BIN), F.floor(F.col(high) / ROW_BIN)))


def edges(intervals: DataFrame, cells: DataFrame) -> DataFrame:
    """Distinct edges from a populated cell to the formula that uses it: ``wb``, ``sheet``, ``row``, ``col`` and ``to_sheet``, ``to_row``, ``to_col``."""
    spans = intervals.select("wb", F.col("to_sheet").alias("sheet"), F.col("sheet").alias("_s"), F.col("row").alias("_r"), F.col("col").alias("_c"), "row1", "col1", "row2", "col2", _bins("row1", "row2").alias("bin"))
    points = cells.select(*ADDRESS, F.floor(F.col("row") / ROW_BIN).alias("bin"))
    found = points.join(spread(spans), [*SHEET, "bin"]).where("row between row1 and row2 and col between col1 and col2")
    return found.select(*ADDRESS, F.col("_s").alias("to_sheet"), F.col("_r").alias("to_row"), F.col("_c").alias("to_col")).distinct()


def self_loops(intervals: DataFrame) -> DataFrame:
    """Formulas inside a range that they use."""
    return intervals.where("sheet = to_sheet and row between row1 and row2 and col between col1 and col2").select(*ADDRESS).distinct()


def output_like(cells: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """Addresses of cells that look like outputs: by their sheet's name, a label up to three cells left or above, or many dependents."""
    by_sheet = F.lit(False)
    for word in OUTPUT_SHEETS:
        by_sheet = by_sheet | F.lower("sheet").contains(word)
    label = F.lit(False)
    for word in OUTPUT_LABELS:
        label = label | F.lower("str").contains(word)
    labels = cells.where((F.col("kind") == "s") & label).select(*SHEET, "row", "col", F.explode(F.array(*[F.lit(i) for i in range(1, 4)])).alias("_d"))
    near = labels.select(*SHEET, "row", (F.col("col") + F.col("_d")).alias("col")).union(labels.select(*SHEET, (F.col("row") + F.col("_d")).alias("row"), "col"))
    many = edge_rows.groupBy(*ADDRESS).count().where(F.col("count") >= MANY_DEPENDENTS).select(*ADDRESS)
    return cells.where(by_sheet).select(*ADDRESS).union(near).union(many).distinct().join(spread(cells.select(*ADDRESS)), ADDRESS, "left_semi")


_ROWS, _COLS = 1 << 21, 1 << 15  # more than a sheet has


def _nodes(frames: Sequence[tuple[pd.DataFrame, Sequence[str]]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(sheet names, distinct keys, the place in them of each row of each frame); a key is (sheet, row, column) as one number."""
    codes, sheets = pd.factorize(np.concatenate([f[of[0]].to_numpy(object) for f, of in frames]), sort=True)
    at = np.concatenate(([0], np.cumsum([len(f) for f, _ in frames])))
    keys = [(codes[at[k] : at[k + 1]].astype(np.int64) * _ROWS + f[of[1]].to_numpy(np.int64)) * _COLS + f[of[2]].to_numpy(np.int64) for k, (f, of) in enumerate(frames)]
    known, place = np.unique(np.concatenate(keys), return_inverse=True)
    return sheets, known, np.split(place, at[1:-1])


def _addresses(sheets: np.ndarray, keys: np.ndarray) -> list[tuple[str, str]]:
    """(sheet, cell as text) of each key."""
    letters: dict[int, str] = {}
    out = []
    for key in keys.tolist():
        above, col = divmod(key, _COLS)
        if col not in letters:
            letters[col] = column_letters(col)
        sheet, row = divmod(above, _ROWS)
        out.append((sheets[sheet], f"{letters[col]}{row}"))
    return out


#: Examples that :func:`impact` lists.
DIRECT_CELLS, OUTPUT_CELLS = 20, 10
_FROM, _TO = ("sheet", "row", "col"), ("to_sheet", "to_row", "to_col")
IMPACT = "wb string, sheet string, row int, col int, direct long, transitive long, sheets array<string>, outputs long, circular boolean, direct_cells array<string>, output_cells array<string>"


def impact(edge_rows: DataFrame, roots: DataFrame, outputs: DataFrame) -> DataFrame:
    """For each address in ``roots``: direct and transitive dependents, the sheets they are on, how many look like outputs, and if it is in a cycle.

    The first of its direct dependents and outputs, by sheet and address as text, are listed.
    """
    flagged = edge_rows.join(spread(outputs.select("wb", F.col("sheet").alias("to_sheet"), F.col("row").alias("to_row"), F.col("col").alias("to_col"), F.lit(True).alias("output"))), ["wb", *_TO], "left")

    def walk(key: tuple, edges: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in IMPACT.split(", ")]
        asked = asked.drop_duplicates()
        if not len(edges):
            return pd.DataFrame([(key[0], *r, 0, 0, [], 0, False, [], []) for r in asked[list(_FROM)].itertuples(index=False)], columns=columns)
        sheets, keys, (a, b, wanted) = _nodes(((edges, _FROM), (edges, _TO), (asked, _FROM)))
        graph = Graph(a, b, len(keys))
        outputs = np.zeros(len(keys), np.int64)
        outputs[b[edges["output"].eq(True).to_numpy()]] = 1
        names = _addresses(sheets, keys)
        rank = np.empty(len(keys), np.int64)
        order = sorted(range(len(keys)), key=names.__getitem__)
        rank[order] = np.arange(len(keys))
        reached, far = graph.counts((np.ones(len(keys), np.int64), outputs))
        on, first = graph.gathered(keys // (_ROWS * _COLS), np.where(outputs > 0, rank, -1), OUTPUT_CELLS)
        shown = lambda ranks: ["!".join(names[order[r]]) for r in ranks]
        named: dict[int, list[str]] = {}
        rows = []
        for r, v in zip(asked[list(_FROM)].itertuples(index=False), wanted.tolist(), strict=True):
            next_ = graph.to[graph.at[v] : graph.at[v + 1]]
            bits = on[v]
            if bits not in named:
                named[bits] = [sheets[k] for k in range(len(sheets)) if bits >> k & 1]
            rows.append((key[0], *r, len(next_), int(reached[v]), named[bits], int(far[v]), bool(graph.circular[v]), shown(np.sort(rank[next_])[:DIRECT_CELLS]), shown(first[v])))
        return pd.DataFrame(rows, columns=columns)

    # Both sides may stem from the same cells; new aliases keep their columns apart.
    left, right = flagged.select(*[F.col(c).alias(c) for c in flagged.columns]), roots.select(*[F.col(c).alias(c) for c in ADDRESS])
    return left.groupBy("wb").cogroup(right.groupBy("wb")).applyInPandas(walk, IMPACT)


_CYCLES = "wb string, cycle int, sheet string, row int, col int"


def _cycle_rows(wb: str, component: np.ndarray, sheets: np.ndarray, keys: np.ndarray) -> pd.DataFrame:
    """The cells (the first nodes) whose components hold two cells or more; cycles are numbered by their first cell."""
    component = component[: len(keys)]
    at = np.flatnonzero(np.bincount(component)[component] > 1)  # keys are in order of sheet, row and column
    found, first, number = np.unique(component[at], return_index=True, return_inverse=True)
    place = np.argsort(np.argsort(first))[number] if len(at) else number
    order = np.argsort(place, kind="stable")
    above, col = np.divmod(keys[at[order]], _COLS)
    return pd.DataFrame({"wb": wb, "cycle": place[order], "sheet": sheets[above // _ROWS], "row": above % _ROWS, "col": col})


def cycles(edge_rows: DataFrame) -> DataFrame:
    """Cells in cycles of two or more: ``wb``, ``cycle`` (a number), ``sheet``, ``row``, ``col``."""

    def walk(key: tuple, edges: pd.DataFrame) -> pd.DataFrame:
        sheets, keys, (a, b) = _nodes(((edges, _FROM), (edges, _TO)))
        return _cycle_rows(key[0], Graph(a, b, len(keys)).component, sheets, keys)

    return edge_rows.groupBy("wb").applyInPandas(walk, _CYCLES)


def _pieces(low: np.ndarray, high: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(which range, node) of the nodes of a binary tree over ``size`` leaves (a power of two) that make up the ranges from ``low`` to before ``high``; node 1 is the root, leaf i is ``size + i``."""
    of, nodes = [], []
    which, a, b = np.arange(len(low)), low + size, high + size
    while len(which):
        for take, node in (((a & 1) == 1, a), ((b & 1) == 1, b - 1)):
            take = take & (a < b)
            of.append(which[take])
            nodes.append(node[take])
        a, b = (a + 1) >> 1, b >> 1
        on = a < b
        which, a, b = which[on], a[on], b[on]
    return np.concatenate(of or [which]), np.concatenate(nodes or [a])


def interval_graph(sheets: np.ndarray, keys: np.ndarray, formula: np.ndarray, spans: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """(both ends of each edge, number of nodes) of formulas and what they use, through nodes that stand for runs of formulas in a column.

    ``formula`` is the node of each row of ``spans`` (``to_sheet``, ``row1`` to ``col2``).  Only formulas can be in a cycle, so runs count
    these alone; a range is some pieces of a binary tree over its columns' formulas, each reference costs their logarithm.
    """
    above, cols = np.divmod(keys, _COLS)
    rows, lines = above % _ROWS, (above // _ROWS) * _COLS + cols  # a line is a column of a sheet
    order = np.lexsort((rows, lines))
    known, first = np.unique(lines[order], return_index=True)
    ends = np.append(first[1:], len(order))
    number = {s: k for k, s in enumerate(sheets)}
    to = spans["to_sheet"].map(number).to_numpy(np.float64)
    a = np.searchsorted(known, np.where(np.isnan(to), 0, to) * _COLS + spans["col1"].to_numpy(np.int64))
    b = np.searchsorted(known, np.where(np.isnan(to), 0, to) * _COLS + spans["col2"].to_numpy(np.int64), side="right")
    sizes = np.where(np.isnan(to), 0, b - a).astype(np.int64)
    span = np.repeat(np.arange(len(spans)), sizes)
    line = np.repeat(a - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    low, high = spans["row1"].to_numpy(np.int64)[span], spans["row2"].to_numpy(np.int64)[span]
    source, target, nodes = [], [], len(keys)
    by_line = np.argsort(line, kind="stable")
    for k, held in zip(*_groups(line[by_line], by_line), strict=True):
        cells = order[first[k] : ends[k]]
        size = 1 << max(len(cells) - 1, 0).bit_length()
        # Leaves are the cells themselves; the tree's inner nodes get numbers of their own.
        node = np.concatenate((np.arange(nodes, nodes + size), cells, np.full(size - len(cells), -1)))
        nodes += size
        of, piece = _pieces(np.searchsorted(rows[cells], low[held]), np.searchsorted(rows[cells], high[held], side="right"), size)
        source.append(formula[span[held[of]]])
        target.append(node[piece])
        inner = np.repeat(np.arange(1, size), 2)
        below = np.arange(2, 2 * size)
        there = node[below] >= 0
        source.append(node[inner[there]])
        target.append(node[below[there]])
    return np.concatenate(source or [np.empty(0, np.int64)]), np.concatenate(target or [np.empty(0, np.int64)]), nodes


def _groups(sorted_keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    found, first = np.unique(sorted_keys, return_index=True)
    return found.tolist(), np.split(values, first[1:]) if len(found) else []


def interval_cycles(intervals: DataFrame) -> DataFrame:
    """What :func:`cycles` gives of all edges, from :func:`areas` alone: no range is taken apart into its cells."""

    def walk(key: tuple, spans: pd.DataFrame) -> pd.DataFrame:
        sheets, keys, (formula,) = _nodes(((spans, _FROM),))
        source, target, n = interval_graph(sheets, keys, formula, spans)
        own = source != target
        return _cycle_rows(key[0], Graph(source[own], target[own], n).component, sheets, keys)

    return intervals.select("wb", *_FROM, "to_sheet", "row1", "col1", "row2", "col2").groupBy("wb").applyInPandas(walk, _CYCLES)
