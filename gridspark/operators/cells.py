"""The cell relation and what it says line by line: blocks, tables, runs and gaps.

A cell is a row of :data:`CELLS`; sheets are keyed by (``wb``, ``sheet``).  Every operator partitions by these keys first, so that any
number of workbooks is one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridspark.functions import text
from gridspark.functions.formula import coordinate, matching_shift, parsed
from gridspark.operators.table import TRUTH, type_of

#: kind: n number, s text, b boolean, d date, e error literal; null for a formula without a saved value.
CELLS = "wb string, sheet string, sheet_no int, row int, col int, kind string, num double, str string, ts timestamp_ntz, formula string, number_format string, style string"
SHEET = ["wb", "sheet"]
ADDRESS = ["wb", "sheet", "row", "col"]

# Fixed values of table detection.
TOTALS = ("total", "subtotal", "grand total", "sum", "общо", "итого", "всичко", "сума", "общ")
TEXT_ROW = 0.6
MIN_BLOCK_ROWS, MIN_BODY_ROWS, HEADER_ROWS = 3, 2, 3
MIN_PATTERN, MIN_RUN = 3, 2


def with_formulas(cells: DataFrame) -> DataFrame:
    """``cells`` with the struct ``f`` of :data:`gridspark.functions.formula.PARSED`, null for constants; one pass over the cells."""
    read = cells.withColumn("f", parsed(F.col("formula"), F.col("row"), F.col("col")))
    return read.withColumn("f", F.when(F.col("formula").isNotNull(), F.col("f")))


def spread(df: DataFrame) -> DataFrame:
    """``df`` as the side of a join that grows with the cells: shuffled and never broadcast, as its compressed size, by which Spark would choose, hides how many rows the driver would hold."""
    return df.hint("merge")


def value_text(prefix: str = "") -> Column:
    """A cell's value as text, apart by kind, so that 1, "1" and true differ."""
    c = lambda name: F.col(prefix + name)
    return F.concat(c("kind"), F.lit(":"), F.coalesce(c("str"), c("num").cast("string"), c("ts").cast("string"), F.lit("")))


def islands(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """``df`` with ``island``: equal for rows of the same keys whose distinct positions follow each other without a gap."""
    return df.withColumn("island", F.col(position) - F.dense_rank().over(Window.partitionBy(*keys).orderBy(position)))


def blocks(cells: DataFrame) -> DataFrame:
    """Blocks of consecutive populated rows: ``wb``, ``sheet``, ``block``, ``first_row``, ``last_row``, ``first_col``, ``last_col``."""
    rows = cells.groupBy(*SHEET, "row").agg(F.min("col").alias("first_col"), F.max("col").alias("last_col"))
    found = islands(rows, SHEET, "row").groupBy(*SHEET, "island").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.min("first_col").alias("first_col"), F.max("last_col").alias("last_col"))
    return found.select(*SHEET, F.row_number().over(Window.partitionBy(*SHEET).orderBy("first_row")).alias("block"), "first_row", "last_row", "first_col", "last_col")


def _totals_word() -> Column:
    words = F.split(text.normalized(F.col("str")), " ")
    return (F.col("kind") == "s") & (F.get(words, F.lit(0)).isin(*TOTALS) | F.concat_ws(" ", F.slice(words, 1, 2)).isin(*TOTALS))


def _declared_tables(spans: DataFrame, declared: DataFrame) -> DataFrame:
    """Blocks inside a declared table that shares a column with them and has room for data; of several, the first on the sheet."""
    room = F.col("row2") - F.col("totals_rows") >= F.col("row1") + F.col("header_rows")
    inside = (F.col("row1") <= F.col("first_row")) & (F.col("last_row") <= F.col("row2")) & (F.col("col2") >= F.col("first_col")) & (F.col("col1") <= F.col("last_col"))
    first = Window.partitionBy(*SHEET, "block").orderBy("row1", "col1", "name")
    found = spans.join(declared, SHEET).where(room & inside).withColumn("_n", F.row_number().over(first)).where("_n = 1")
    totals = F.when(F.col("totals_rows") > 0, F.sequence(F.col("row2") - F.col("totals_rows") + 1, F.col("row2"))).otherwise(F.array().cast("array<int>"))
    return found.select(
        *SHEET, "block", F.col("col1").alias("first_col"), F.col("col2").alias("last_col"), F.col("row1").alias("header_row"), F.col("header_rows"), (F.col("row1") + F.col("header_rows")).alias("first_data"), F.col("row2").alias("last_data"),
        totals.alias("total_rows"), "first_row", "last_row", F.lit(True).alias("exact"),
    )


def tables(cells: DataFrame, declared: DataFrame | None = None) -> DataFrame:
    """Tables: the block's columns and rows, ``header_row``, ``header_rows``, ``first_data``, ``last_data``, ``total_rows`` and ``rows_total``.

    A block inside one of the ``declared`` tables (:data:`gridspark.operators.graph.DECLARED`) is what is declared (``exact``).  Elsewhere the
    header is the first of a block's first three rows with enough cells of which most are text; a second header row is one of
    texts that is followed by one of values.  Totals rows hold a cell that begins with a totals word.  Blocks of under three rows, or
    with fewer than two rows of data, are no tables.
    """
    keys = [*SHEET, "block"]
    spans = blocks(cells)
    exact = None if declared is None else _declared_tables(spans, declared)
    if exact is not None:
        spans = spans.join(exact.select(*keys), keys, "left_anti")
    spans = spans.where(F.col("last_row") - F.col("first_row") + 1 >= MIN_BLOCK_ROWS)
    is_text = (F.col("kind") == "s") & F.col("formula").isNull()
    rows = cells.groupBy(*SHEET, "row").agg(F.count("*").alias("n"), F.count_if(is_text).alias("n_text"), F.max(_totals_word()).alias("total"))
    inside = rows.join(spans, SHEET).where("row between first_row and last_row")
    order = Window.partitionBy(*SHEET, "block").orderBy("row")
    share = F.col("n_text") / F.col("n")
    seen = inside.select("*", share.alias("share"), F.lead(share).over(order).alias("next"), F.lead(share, 2).over(order).alias("after"))
    width = F.col("last_col") - F.col("first_col") + 1
    fits = (F.col("row") < F.col("first_row") + HEADER_ROWS) & (F.col("n") >= F.greatest(F.lit(2), F.floor(width / 2))) & (F.col("share") >= TEXT_ROW)
    double = (F.col("next") >= TEXT_ROW) & (F.col("after") < TEXT_ROW)
    header = seen.where(fits).groupBy(*keys).agg(F.min(F.struct("row", F.when(double, 2).otherwise(1).alias("rows"))).alias("h")).select(*keys, F.col("h.row").alias("header_row"), F.col("h.rows").alias("header_rows"))
    data = inside.join(header, keys).where(F.col("row") >= F.col("header_row") + F.col("header_rows"))
    found = data.groupBy(*keys, "first_col", "last_col", "header_row", "header_rows", "first_row", "last_row").agg(F.min("row").alias("first_data"), F.max("row").alias("last_data"), F.count("*").alias("_n"), F.array_sort(F.collect_list(F.when(F.col("total"), F.col("row")))).alias("total_rows"))
    found = found.where((F.col("_n") >= MIN_BODY_ROWS) & (F.col("_n") - F.size("total_rows") >= MIN_BODY_ROWS)).drop("_n").withColumn("exact", F.lit(False))
    both = found if exact is None else found.unionByName(exact)
    return both.withColumn("rows_total", F.col("last_data") - F.col("first_data") + 1)


#: Words in a header that make its column look like an identifier.
IDENTIFIERS = ("id", "no", "number", "номер", "код", "code")
SAMPLES, SAMPLE_CHARS = 3, 40


def shown_value() -> Column:
    """A cell's value as a reader sees it: whole numbers without decimals."""
    whole = (F.col("num") == F.floor("num")) & (F.abs("num") < 1e15)
    return F.coalesce("str", F.when(whole, F.col("num").cast("long").cast("string")).otherwise(F.col("num").cast("string")), F.col("ts").cast("string"))


def table_columns(cells: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each column of :func:`tables`: ``name``, ``type``, ``number_format``, ``currency``, ``n_present``, ``n_missing``, ``n_distinct``, ``samples`` and ``identifier``.

    Of number formats, the most frequent counts; ties go to the least hash.  ``samples`` are the first distinct values; a column is an
    identifier if its header says so and its values are all distinct, or numbers, or texts.
    """
    keys = [*SHEET, "block", "col"]
    inside = cells.join(found, SHEET).where("col between first_col and last_col and row between least(header_row, first_data) and last_data")
    heads = inside.where((F.col("row") < F.col("first_data")) & F.col("kind").isNotNull()).groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", shown_value().alias("name")))), lambda x: x["name"]), " / ").alias("name"))
    low, high = F.greatest("first_data", "first_row"), F.least("last_data", "last_row")
    body = inside.where((F.col("row") >= low) & (F.col("row") <= high) & ~F.array_contains("total_rows", F.col("row")) & F.col("kind").isNotNull())
    formats = body.groupBy(*keys, "number_format").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max_by("number_format", F.struct("n", F.hash("number_format"))).alias("number_format"))
    kind = F.col("kind")
    counts = body.groupBy(*keys).agg(
        F.count("*").alias("n_present"), F.count_distinct(value_text()).alias("n_distinct"), F.count_if(kind == "d").alias("_d"), F.count_if(kind == "n").alias("_n"),
        F.count_if((kind == "b") | ((kind == "s") & text.folded(F.col("str")).isin(*TRUTH))).alias("_b"), F.count_if(kind == "s").alias("_s"),
    )
    seen = body.groupBy(*keys, F.substring(shown_value(), 1, SAMPLE_CHARS).alias("_v")).agg(F.min("row").alias("_at"))
    seen = seen.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy("_at"))).where(F.col("_k") <= SAMPLES)
    samples = seen.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda x: x["_v"]).alias("samples"))
    totals = F.size(F.filter("total_rows", lambda r: (r >= low) & (r <= high)))
    sizes = found.select(*SHEET, "block", (high - low + 1 - totals).alias("_rows"))
    # Columns are those with a cell, and in a declared table all of it.
    listed = inside.select(*keys).union(found.where("exact").select(*SHEET, "block", F.explode(F.sequence("first_col", "last_col")))).distinct()
    out = listed.join(heads, keys, "left").join(counts, keys, "left").join(formats, keys, "left").join(samples, keys, "left").join(sizes, [*SHEET, "block"]).fillna(0, ["n_present", "n_distinct", "_d", "_n", "_b", "_s"])
    sort = type_of(F.col("n_present"), F.col("_d"), F.col("_n"), F.col("_b"), F.col("_s"), F.col("n_distinct"), F.col("number_format"))
    named = out.withColumns({"name": F.coalesce("name", F.concat(F.lit("Column "), F.regexp_extract(coordinate(F.lit(1), F.col("col")), "[A-Z]+", 0))), "type": sort})
    word = text.normalized(F.col("name"))
    says = F.arrays_overlap(F.split(word, " "), F.array(*map(F.lit, IDENTIFIERS))) | F.arrays_overlap(F.split(text.transliterated(word), " "), F.array(*[F.lit("".join(text.CYRILLIC.get(c, c) for c in w)) for w in IDENTIFIERS]))
    identifier = (F.col("n_present") >= 3) & says & ((F.col("n_distinct") == F.col("n_present")) | F.col("type").isin("number", "text"))
    currency = F.when(F.col("type") == "currency", text.currency(F.col("number_format"))).alias("currency")
    return named.select(*keys, "name", "type", "number_format", currency, "n_present", (F.col("_rows") - F.col("n_present")).alias("n_missing"), "n_distinct", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"), identifier.alias("identifier"))


def table_notes(found: DataFrame, sheets: DataFrame) -> DataFrame:
    """``wb``, ``sheet``, ``block`` (null for a whole sheet) and ``note``: declared tables, merged ranges over a table, sheets that are not visible."""
    merged = sheets.select(*SHEET, F.posexplode("merged").alias("_k", "_m")).select(*SHEET, "_k", "_m", F.regexp_extract("_m", r"^\$?[A-Z]+\$?(\d+)", 1).try_cast("int").alias("_a"), F.regexp_extract("_m", r"(\d+)$", 1).try_cast("int").alias("_b"))
    met = found.join(merged, SHEET).where("_b >= least(header_row, first_data) and _a <= last_data").groupBy(*SHEET, "block").agg(F.array_sort(F.collect_list(F.struct("_k", "_m"))).alias("_l"))
    named = F.array_join(F.transform(F.slice("_l", 1, 3), lambda x: x["_m"]), ", ")
    over = met.select(*SHEET, "block", F.concat(F.lit("Merged ranges overlap this table: "), named).alias("note"))
    exact = found.where("exact").select(*SHEET, "block", F.lit("Header and totals rows are as declared in the workbook").alias("note"))
    hidden = sheets.where("visibility <> 'visible'").select(*SHEET, F.lit(None).cast("int").alias("block"), F.concat(F.lit("The sheet is "), "visibility").alias("note"))
    return over.union(exact).union(hidden)


def runs(parsed_cells: DataFrame, along: str, across: str) -> DataFrame:
    """Runs of equal relative formulas: ``wb``, ``sheet``, ``across``, ``norm``, ``start``, ``end``; ``along`` is the axis that a run follows."""
    keys = [*SHEET, across, "norm"]
    formulas = parsed_cells.where("f.norm is not null").select(*SHEET, across, along, F.col("f.norm").alias("norm"))
    return islands(formulas, keys, along).groupBy(*keys, "island").agg(F.min(along).alias("start"), F.max(along).alias("end")).drop("island")


def _line_gaps(parsed_cells: DataFrame, along: str, across: str) -> DataFrame:
    """Cells between two runs of one form, down columns or along rows."""
    order = Window.partitionBy(*SHEET, across, "norm").orderBy("start")
    pair = runs(parsed_cells, along, across).select("*", F.lead("start").over(order).alias("next"), F.lead("end").over(order).alias("next_end"))
    before, after = F.col("end") - F.col("start") + 1, F.col("next_end") - F.col("next") + 1
    gap = pair.where((F.col("next") == F.col("end") + 2) & (before + after >= MIN_PATTERN) & (F.greatest(before, after) >= MIN_RUN))
    places = gap.select(*SHEET, F.col(across), (F.col("end") + 1).alias(along), F.col("norm").alias("expected"), before.alias("run_before"), after.alias("run_after"))
    lines = parsed_cells.select(*SHEET, along).distinct().withColumn("_there", F.lit(True))
    at = parsed_cells.select(*ADDRESS, "kind", "num", "formula", F.col("f.norm").alias("form"))
    # Gaps are few: they are hashed, and the cells stream past them unsorted.
    held = places.hint("shuffle_hash").join(at, ADDRESS, "left").hint("shuffle_hash").join(lines, [*SHEET, along], "left")
    numeric = F.col("formula").isNull() & (F.col("kind") == "n")
    form = F.col("form")
    # A blank in an altogether blank line is layout.
    sort = (
        F.when(F.col("kind").isNull() & F.col("formula").isNull(), F.when(F.col("_there"), "missing_formula")).when(numeric, "overwritten_constant")
        .when(F.col("formula").isNotNull() & (form.isNull() | (form != F.col("expected"))), "inconsistent_formula")
    )
    found = held.select(*ADDRESS, sort.alias("anomaly"), "expected", F.lit("column" if along == "row" else "row").alias("orientation"), "run_before", "run_after", "num", "formula")
    return found.where("anomaly is not null")


def pattern_gaps(parsed_cells: DataFrame) -> DataFrame:
    """Single cells that break a pattern of equal relative formulas: constants, other formulas and blanks; columns go before rows.

    ``shift`` tells by how many cells an other formula is off from the pattern, up to three.
    """
    both = _line_gaps(parsed_cells, "row", "col").unionByName(_line_gaps(parsed_cells, "col", "row"))
    first = both.withColumn("_n", F.row_number().over(Window.partitionBy(*ADDRESS).orderBy("orientation", "expected"))).where("_n = 1").drop("_n")
    wrong = first.where("anomaly = 'inconsistent_formula'").withColumn("shift", matching_shift(F.col("formula"), F.col("row"), F.col("col"), F.col("expected"), F.col("orientation") == "column"))
    return wrong.unionByName(first.where("anomaly <> 'inconsistent_formula'").withColumn("shift", F.lit(None).cast("int")))
