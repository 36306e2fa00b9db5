"""Which columns questions mean, for any number of questions and workbooks at once: by name, else by concept.

``columns`` has a row for each column of a table, as :func:`gridspark.operators.cells.table_columns` gives them (``wb``, ``sheet``, ``block``,
``col``, ``name``, ``type``).  Several columns that fit are all given: nothing is picked silently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.functions import concepts

NUMERIC = ("number", "currency", "percentage")
PLACE = ["sheet", "block", "col"]


def fits(overlap: Column, numeric: Column) -> Column:
    """Whether a column answers for the concepts that it shares with a question: amounts are held by numbers alone."""
    return (F.size(overlap) > 0) & (numeric | ~F.arrays_overlap(overlap, F.array(*map(F.lit, concepts.MONETARY))))


def by_name(questions: DataFrame, columns: DataFrame) -> DataFrame:
    """``ask``, ``wb``, the column's place, ``name`` and ``type``: columns that share a folded form with the question's ``text``."""
    asked = questions.select("ask", "wb", F.explode(concepts.forms(F.col("text"))).alias("form"))
    named = columns.select("wb", *PLACE, "name", "type", F.explode(concepts.forms(F.col("name"))).alias("form"))
    return asked.join(named, ["wb", "form"]).select("ask", "wb", *PLACE, "name", "type").distinct()


def by_concept(questions: DataFrame, columns: DataFrame) -> DataFrame:
    """The same for columns that share a concept with the question, and ``concepts``, those that they share."""
    asked = questions.select("ask", "wb", F.explode(concepts.wanted(F.col("text"))).alias("concept"))
    named = columns.select("wb", *PLACE, "name", "type", F.explode(concepts.of_name(F.col("name"))).alias("concept"))
    shared = asked.join(named, ["wb", "concept"]).groupBy("ask", "wb", *PLACE, "name", "type").agg(F.array_sort(F.collect_set("concept")).alias("concepts"))
    return shared.where(fits(F.col("concepts"), F.col("type").isin(*NUMERIC)))


def resolved(questions: DataFrame, columns: DataFrame, names_first: bool = True) -> DataFrame:
    """A row for each question (``ask``, ``wb``, ``text``): ``status`` (``resolved``, ``ambiguous`` or ``not_found``), ``how`` (``exact``, ``alias`` or null) and ``matches``.

    Names go before concepts, or after them; what comes second counts only for questions for which the first has no column.  ``matches`` are structs of
    sheet, block, column, name and type in that order; of a column that comes twice one stays.  A question that is null or says nothing is not found.
    """
    match = F.struct(*PLACE, "name", "type").alias("match")
    exact, alias = by_name(questions, columns).select("ask", "wb", F.lit("exact").alias("how"), match), by_concept(questions, columns).select("ask", "wb", F.lit("alias").alias("how"), match)
    first = "exact" if names_first else "alias"
    lists = exact.unionByName(alias).groupBy("ask", "wb").agg(*[F.array_sort(F.collect_set(F.when(F.col("how") == h, F.col("match")))).alias(h) for h in ("exact", "alias")])
    second = {"exact": "alias", "alias": "exact"}[first]
    how = F.when(F.size(first) > 0, first).when(F.size(second) > 0, second)
    picked = lists.select("ask", "wb", how.alias("how"), F.when(F.size(first) > 0, F.col(first)).otherwise(F.col(second)).alias("matches"))
    out = questions.select("ask", "wb", "text").join(picked, ["ask", "wb"], "left")
    status = F.when(F.col("how").isNull(), "not_found").when(F.size("matches") == 1, "resolved").otherwise("ambiguous")
    return out.select("ask", "wb", "text", status.alias("status"), "how", F.coalesce("matches", F.array().cast(picked.schema["matches"].dataType)).alias("matches"))


def deadlines(columns: DataFrame) -> DataFrame:
    """The column that questions of deadlines read, for each table with dates: the only date, else the only one that speaks of a due date; ``col`` is null where neither is so.

    Returns ``wb``, ``sheet``, ``block``, ``status``, ``col``, ``name`` and ``n_dates``.
    """
    due = F.array_contains(concepts.of_name(F.col("name")), "due_date")
    dates = columns.where("type = 'date'").select("wb", *PLACE, "name", due.alias("due"))
    found = dates.groupBy("wb", "sheet", "block").agg(F.count("*").alias("n_dates"), F.count_if("due").alias("n_due"), F.min_by(F.struct("col", "name"), F.struct(~F.col("due"), F.col("col"))).alias("first"))
    sure = (F.col("n_dates") == 1) | (F.col("n_due") == 1)
    return found.select("wb", "sheet", "block", F.when(sure, "resolved").otherwise("ambiguous").alias("status"), F.when(sure, F.col("first.col")).alias("col"), F.when(sure, F.col("first.name")).alias("name"), "n_dates")
