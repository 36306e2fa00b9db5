"""Queries over one table: filters, aggregates, groups, listings, periods and deadlines.

A table is any DataFrame.  Filters are AND-ed; nothing is filtered, grouped or aggregated outside one declarative plan.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

from gridspark.functions import text

OPERATORS = ("equals", "not_equals", "contains", "greater_than", "less_than", "greater_or_equal", "less_or_equal", "before", "after", "year_equals", "is_blank", "not_blank")
AGGREGATES = ("sum", "count", "distinct_count", "average", "minimum", "maximum", "median")
MAX_LISTED = 50
DEFAULT_HORIZON = 30


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str
    value: Any = None

    def __post_init__(self):
        if self.operator not in OPERATORS:
            raise ValueError(f"unknown operator {self.operator!r}")
        if self.value is None and self.operator not in ("is_blank", "not_blank"):
            raise ValueError(f"the filter on {self.column!r} is missing a value")

    def __str__(self) -> str:
        if self.operator == "year_equals":
            return f"year({self.column}) = {self.value}"
        words = {"is_blank": "is blank", "not_blank": "is not blank"}.get(self.operator)
        return f"{self.column} {words}" if words else f"{self.column} {self.operator.replace('_', ' ')} {self.value}"


def _column(df: DataFrame, name: str) -> Column:
    return df[f"`{name}`"]


def _literal_moment(value: Any) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def _literal_number(value: Any) -> Column:
    """A numeric literal, or one that a text names; null if it names none."""
    try:
        return F.lit(float(value))
    except (TypeError, ValueError):
        return F.lit(None).cast("double")


def condition(df: DataFrame, flt: Filter) -> Column:
    """The filter as a predicate that is never null.

    Numbers compare with numbers after coercion, dates with dates; values that cannot be coerced match nothing.  ``equals`` of a text
    ignores case and outer white space; ``not_equals`` is its complement and so keeps blanks; ``before`` and ``after`` are strict.
    Typed columns are compared as they are, which lets the predicate reach the scan.
    """
    c, kind, op = _column(df, flt.column), df.schema[flt.column].dataType, flt.operator
    if op in ("is_blank", "not_blank"):
        return text.blank(c, kind) if op == "is_blank" else ~text.blank(c, kind)
    if op in ("before", "after", "year_equals"):
        when = text.moment(c, kind)
        if op == "year_equals":
            year = int(flt.value)
            low, high = F.lit(f"{year:04d}-01-01").cast("timestamp_ntz"), F.lit(f"{year + 1:04d}-01-01").cast("timestamp_ntz")
            found = (when >= low) & (when < high)
        else:
            found = when < _literal_moment(flt.value) if op == "before" else when > _literal_moment(flt.value)
    elif op == "contains":
        found = text.folded(c).contains(text.fold(str(flt.value))) if isinstance(kind, StringType) else F.lit(False)
    elif op in ("equals", "not_equals"):
        if isinstance(kind, StringType) and isinstance(flt.value, str):
            found = text.folded(c) == text.fold(flt.value)
        elif isinstance(kind, BooleanType) and isinstance(flt.value, bool):
            found = c == flt.value
        elif isinstance(kind, DateType | TimestampType | TimestampNTZType):
            found = text.moment(c, kind) == F.lit(str(flt.value)).try_cast("timestamp_ntz")
        else:
            found = (c if isinstance(kind, NumericType) else text.numeric(c, kind)) == _literal_number(flt.value)
        if op == "not_equals":
            return ~F.coalesce(found, F.lit(False))
    else:
        number = c if isinstance(kind, NumericType) else text.numeric(c, kind)
        value = _literal_number(flt.value)
        found = {"greater_than": number > value, "less_than": number < value, "greater_or_equal": number >= value, "less_or_equal": number <= value}[op]
        if kind.typeName() in ("double", "float"):
            found = found & ~F.isnan(c)
    return found


def where(df: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """The rows that meet all filters, in the order given."""
    return reduce(lambda d, f: d.where(condition(d, f)), filters, df)


def unreadable(df: DataFrame, filters: Sequence[Filter]) -> list[Column]:
    """For each ``year_equals`` filter, a count of values that are there but are no date; to go along in an aggregate."""
    return [F.count_if(_column(df, f.column).isNotNull() & text.moment(_column(df, f.column), df.schema[f.column].dataType).isNull()) for f in filters if f.operator == "year_equals"]


def aggregate_column(df: DataFrame, function: str, column: str | None, only: Column | None = None) -> Column:
    """One aggregate; of no value at all it is null, and 0 for counts.  ``only`` restricts it to some rows."""
    if function not in AGGREGATES:
        raise ValueError(f"unknown aggregate {function!r}")
    if column is None:
        if function != "count":
            raise ValueError(f"{function} needs a column")
        return F.count(F.lit(1)) if only is None else F.count_if(only)
    c, kind = _column(df, column), df.schema[column].dataType
    value = F.when(~text.blank(c, kind), c) if function in ("count", "distinct_count") else text.numeric(c, kind)
    value = value if only is None else F.when(only, value)
    return {"sum": F.sum, "count": F.count, "distinct_count": F.count_distinct, "average": F.avg, "minimum": F.min, "maximum": F.max, "median": F.median}[function](value)


def blanks(df: DataFrame, function: str, column: str | None) -> Column:
    """Rows without a usable value: not numeric for numeric aggregates, blank for ``distinct_count``, none for ``count``."""
    if column is None or function == "count":
        return F.lit(0).cast("long")
    c, kind = _column(df, column), df.schema[column].dataType
    return F.count_if(text.blank(c, kind) if function == "distinct_count" else text.numeric(c, kind).isNull())


def group_key(df: DataFrame, column: str) -> Column:
    """Texts without outer white space, dates as year-month, all else as it is; null stays a group of its own."""
    c, kind = _column(df, column), df.schema[column].dataType
    if isinstance(kind, DateType | TimestampType | TimestampNTZType):
        return F.date_format(c, "yyyy-MM")
    return text.stripped(c) if isinstance(kind, StringType) else c


def aggregate(df: DataFrame, function: str, column: str | None = None, *, filters: Sequence[Filter] = (), group_by: Sequence[str] = ()) -> DataFrame:
    """``value``, ``n_rows`` and ``n_blank``, for each group if any: one pass with partial aggregation."""
    found = where(df, filters)
    out = [aggregate_column(found, function, column).alias("value"), F.count(F.lit(1)).alias("n_rows"), blanks(found, function, column).alias("n_blank")]
    return found.groupBy(*[group_key(found, g).alias(g) for g in group_by]).agg(*out) if group_by else found.agg(*out)


def in_key_order(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups in the order of their keys as text: texts in quotes, null as None, so that numbers sort as text."""

    def shown(name: str) -> Column:
        c, kind = _column(groups, name), groups.schema[name].dataType
        if isinstance(kind, StringType):
            mark = F.when(c.contains("'") & ~c.contains('"'), '"').otherwise("'")
            c = F.concat(mark, c, mark)
        return F.coalesce(c.cast("string"), F.lit("None"))

    return groups.orderBy(*[shown(k) for k in sorted(keys)])


def list_rows(df: DataFrame, order_by: Sequence[str | Column], *, filters: Sequence[Filter] = (), limit: int | None = None) -> DataFrame:
    """The first ``limit`` (``MAX_LISTED`` at most) rows that match; how many there are is :func:`aggregate`'s count."""
    return where(df, filters).orderBy(*order_by).limit(min(limit or MAX_LISTED, MAX_LISTED))


def compare_periods(df: DataFrame, date_column: str, first: int, second: int, function: str, column: str | None = None, *, filters: Sequence[Filter] = ()) -> DataFrame:
    """One aggregate over two calendar years in one pass: ``first``, ``second``, ``change``, ``percent`` (null if the first is 0 or null) and ``n_rows``."""
    found = where(df, filters)
    year = F.year(text.moment(_column(found, date_column), found.schema[date_column].dataType))
    both = found.agg(aggregate_column(found, function, column, year == first).alias("first"), aggregate_column(found, function, column, year == second).alias("second"), F.count(F.lit(1)).alias("n_rows"))
    change = F.col("second") - F.col("first")
    return both.select("first", "second", change.alias("change"), F.when(F.col("first") != 0, F.round(change / F.col("first") * 100, 2)).alias("percent"), "n_rows")


def next_deadline(df: DataFrame, date_column: str, reference: date | datetime, order_by: Sequence[str], *, filters: Sequence[Filter] = ()) -> DataFrame:
    """The row with the least date from ``reference`` on; ties go to the first in order."""
    found = where(df, filters)
    when = text.moment(_column(found, date_column), found.schema[date_column].dataType)
    return found.where(when >= _literal_moment(reference)).orderBy(when, *order_by).limit(1)


def due_within(df: DataFrame, date_column: str, reference: date | datetime, days: int | None = None, *, filters: Sequence[Filter] = ()) -> DataFrame:
    """The rows due from ``reference`` to so many days later, both included; 0 days counts as the default."""
    found = where(df, filters)
    when = text.moment(_column(found, date_column), found.schema[date_column].dataType)
    return found.where((when >= _literal_moment(reference)) & (when <= _literal_moment(reference + timedelta(days=days or DEFAULT_HORIZON))))


def overdue(df: DataFrame, date_column: str, reference: date | datetime, *, filters: Sequence[Filter] = ()) -> DataFrame:
    found = where(df, filters)
    return found.where(text.moment(_column(found, date_column), found.schema[date_column].dataType) < _literal_moment(reference))


# Fixed values of column typing.
TRUTH = ("да", "не", "yes", "no", "true", "false", "y", "n")
TYPE_SHARE, TEXT_SHARE, MAX_CATEGORIES, CATEGORY_SHARE = 0.7, 0.5, 24, 0.6


def type_of(n, dates, numbers, booleans, texts, distinct, number_format) -> Column:
    """A column's logical type from its counts: dates first, then booleans, numbers by their format, categories and text."""
    formatted = F.coalesce(number_format, F.lit(""))
    number = F.when(formatted.contains("%"), "percentage").when(text.currency(formatted).isNotNull(), "currency").otherwise("number")
    return (
        F.when(n == 0, "empty").when(dates >= TYPE_SHARE * n, "date").when(booleans >= TYPE_SHARE * n, "boolean").when(numbers >= TYPE_SHARE * n, number)
        .when((texts >= TEXT_SHARE * n) & (distinct <= MAX_CATEGORIES) & (distinct <= CATEGORY_SHARE * n), "categorical").otherwise("text")
    )


def profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """A row for each column: ``column``, ``n_present``, ``n_missing``, ``n_distinct`` and ``type``.

    All columns are counted in one pass: the table is unpivoted to (column, text, kind) and grouped, with partial sums.
    """
    names = list(columns or df.columns)
    cells = []
    for name in names:
        c, kind = _column(df, name), df.schema[name].dataType
        sort = "d" if isinstance(kind, DateType | TimestampType | TimestampNTZType) else "b" if isinstance(kind, BooleanType) else "n" if isinstance(kind, NumericType) else "s"
        cells.append(F.struct(F.lit(name).alias("column"), F.when(~text.blank(c, kind), c.cast("string")).alias("text"), F.lit(sort).alias("sort")))
    long = df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*")
    truth = text.folded(F.col("text")).isin(*TRUTH)
    sort = F.col("sort")
    present = F.col("text").isNotNull()
    counts = long.groupBy("column").agg(
        F.count("text").alias("n_present"), F.count_if(~present).alias("n_missing"), F.count_distinct("text").alias("n_distinct"),
        F.count_if(present & (sort == "d")).alias("_d"), F.count_if(present & (sort == "n")).alias("_n"), F.count_if(present & ((sort == "b") | truth)).alias("_b"), F.count_if(present & (sort == "s")).alias("_s"),
    )
    kind = type_of(F.col("n_present"), F.col("_d"), F.col("_n"), F.col("_b"), F.col("_s"), F.col("n_distinct"), F.lit(None).cast("string"))
    return counts.select("column", "n_present", "n_missing", "n_distinct", kind.alias("type"))
