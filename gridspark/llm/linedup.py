"""Line dedup with a fixed-depth log-template tree, in DataFrame functions only.

A line's tokens are what lies between spaces; a token with a digit is a variable field.  The tree's path is the
token count and the first ``DEPTH`` tokens.  In each leaf, a position's constant is the token that most of the leaf's distinct
lines have there, if at least ``AGREE`` of them do, else a variable field.  A line that agrees with at least ``SIMILAR`` of
a leaf's positions generalises to the leaf's template; any other line is its own template, with its variable fields masked.

A template is recurring when at least ``MIN_DOCS`` documents hold it (or ``LONG_MIN_DOCS``, for templates of
``LONG_TOKENS`` or more tokens).  Its lines are dropped everywhere but in the document with the least id that holds it.
Templates of fewer than ``MIN_TOKENS`` tokens are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm._shared import saved

DEPTH = 3
AGREE = 0.6
SIMILAR = 0.8
MIN_TOKENS = 3
MIN_DOCS = 3
LONG_TOKENS = 50
LONG_MIN_DOCS = 2
FIELD = "<*>"
#: Shared leaves are sent to all tasks up to so many (some 50 bytes each); beyond, lines are shuffled to them.
BROADCAST_LEAVES = 1_000_000
#: A template that many documents hold is joined in so many parts.
SALTS = 16


_BLANKS = "[ \\t\\r]+"
_VARIABLE = "[^ ]*[0-9][^ ]*"


def _spaced(line: Column) -> Column:
    """The line with single spaces; most lines are that already and no pattern is run on them."""
    return F.trim(F.when(line.contains("  ") | line.contains("\t") | line.contains("\r"), F.regexp_replace(line, _BLANKS, " ")).otherwise(line))


def _fields(spaced: Column) -> Column:
    """Every token that has an ASCII digit replaced by the variable field."""
    return F.when(spaced.rlike("[0-9]"), F.regexp_replace(spaced, _VARIABLE, FIELD)).otherwise(spaced)


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each line of ``MIN_TOKENS`` or more tokens: ``_id``, ``_h`` (the text's hash), ``_no``, ``_line`` (single spaces), ``_n`` (tokens) and ``_leaf``."""
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_h"), F.split(F.col(text_col), "\n").alias("_lines")).where("_lines is not null")
    line = rows.select("_id", "_h", F.posexplode("_lines").alias("_no", "_raw")).select("_id", "_h", "_no", _spaced(F.col("_raw")).alias("_line"))
    counted = line.withColumn("_n", F.octet_length("_line") - F.octet_length(F.replace("_line", F.lit(" "), F.lit(""))) + 1)
    return counted.where(F.col("_n") >= MIN_TOKENS).withColumn("_leaf", F.xxhash64(_fields(F.substring_index("_line", " ", DEPTH))))


def _keyed(lines: DataFrame) -> DataFrame:
    """``lines`` with ``_masked`` and the 128 bits ``_a``, ``_b`` that stand for it in shuffles."""
    return lines.withColumn("_masked", _fields(F.col("_line"))).withColumns({"_a": F.xxhash64("_masked"), "_b": F.xxhash64(F.lit("template"), "_masked")})


def leaf_templates(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """``_a``, ``_b`` and the ``template`` that it generalises to, of every distinct line in the leaves (``_n``, ``_leaf``) that ``shared`` names."""
    leaf = ["_n", "_leaf"]
    distinct = saved(_keyed(lines.select(*leaf, "_line").join(shared, leaf)).select(*leaf, "_a", "_b", "_masked").dropDuplicates(["_a", "_b"]), "line-leaves")
    sizes = distinct.groupBy(*leaf).agg(F.count("*").alias("_of"))
    positions = distinct.select(*leaf, F.posexplode(F.split("_masked", " ")).alias("_at", "_token"))
    votes = positions.groupBy(*leaf, "_at", "_token").agg(F.count("*").alias("_votes"))
    best = votes.groupBy(*leaf, "_at").agg(F.max(F.struct("_votes", "_token")).alias("_best")).join(sizes, leaf)
    constant = F.when(F.col("_best._votes") >= AGREE * F.col("_of"), F.col("_best._token")).otherwise(F.lit(FIELD))
    ordered = F.array_sort(F.collect_list(F.struct("_at", constant.alias("_token"))))
    leaves = best.groupBy(*leaf).agg(F.transform(ordered, lambda x: x["_token"]).alias("_template"))
    # The leaf's template holds for lines that agree with it in enough places.
    same = F.aggregate(F.zip_with(F.split("_masked", " "), F.col("_template"), lambda a, b: (a == b).cast("int")), F.lit(0), lambda s, x: s + x)
    general = F.when(same >= SIMILAR * F.col("_n"), F.concat_ws(" ", "_template")).otherwise(F.col("_masked"))
    return distinct.join(leaves, leaf).select("_a", "_b", general.alias("template"))


def dropped_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id``, ``_h`` (text hash) and ``_drop`` (sorted numbers of the lines to drop) of documents that lose any.

    Lines stand as 128-bit keys in one narrow table; the texts of lines are wanted only in leaves that several distinct lines share.
    """
    lines = _lines(docs, id_col, text_col)
    narrow = saved(_keyed(lines).select("_id", "_h", "_no", "_a", "_b", "_n", "_leaf"), "line-keys")
    # A document counts once for a template; counting is done on keys, hot ones included, with partial sums.
    key, template = ["_a", "_b"], ["_ta", "_tb"]
    per_doc = narrow.select(*key, "_n", "_leaf", "_id").distinct()
    per_key = saved(per_doc.groupBy(*key, "_n", "_leaf").agg(F.count("*").alias("_docs"), F.min("_id").alias("_first")), "line-counts")
    shared = saved(per_key.groupBy("_n", "_leaf").agg(F.count("*").alias("_of")).where("_of > 1").select("_n", "_leaf"), "line-shared")
    if shared.count() <= BROADCAST_LEAVES:
        shared = F.broadcast(shared)
    tree = leaf_templates(lines, shared).select(*key, F.xxhash64("template").alias("_ta"), F.xxhash64(F.lit("template"), "template").alias("_tb"))
    spread = saved(per_key.join(tree, key, "left").select(*key, "_n", "_docs", "_first", F.coalesce("_ta", "_a").alias("_ta"), F.coalesce("_tb", "_b").alias("_tb")), "line-templates")
    total = spread.groupBy(*template).agg(F.sum("_docs").alias("_sum"), F.count("*").alias("_forms"), F.min("_first").alias("_keep"), F.max("_n").alias("_n"))
    # With one form, its documents; with several, a document may hold more than one form and is counted once.
    several = spread.join(total.where("_forms > 1").select(*template), template, "left_semi").select(*key, *template)
    salt = F.pmod(F.xxhash64("_id"), F.lit(SALTS)).cast("int")
    salts = F.explode(F.array([F.lit(i) for i in range(SALTS)])).alias("_salt")
    held = per_doc.select(*key, "_id", salt.alias("_salt")).join(several.select("*", salts), [*key, "_salt"]).select(*template, "_id").distinct()
    exact = held.groupBy(*template).agg(F.count("*").alias("_docs"))
    counted = total.join(exact, template, "left").withColumn("_docs", F.coalesce("_docs", "_sum"))
    recurring = counted.where((F.col("_docs") >= MIN_DOCS) | ((F.col("_n") >= LONG_TOKENS) & (F.col("_docs") >= LONG_MIN_DOCS)))
    doomed = spread.join(recurring.select(*template, "_keep"), template).select(*key, "_keep")
    hit = narrow.select("_id", "_h", "_no", *key, salt.alias("_salt")).join(doomed.select("*", salts), [*key, "_salt"]).where(~F.col("_id").eqNullSafe(F.col("_keep")))
    return hit.groupBy("_id", "_h").agg(F.sort_array(F.collect_set("_no")).alias("_drop"))


def _marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_row`` (all columns of ``docs``, whatever their names), ``_doc``, ``_text``, ``_lines``, and what :func:`dropped_lines` says, null where a document loses no line.

    The drops are a row at most for a document and a fraction of its size; they are hashed, so that texts need no sort.
    """
    drop = dropped_lines(docs, id_col=id_col, text_col=text_col).hint("shuffle_hash")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    found = rows.join(drop, F.col("_doc").eqNullSafe(F.col("_id")) & (F.xxhash64("_text") == F.col("_h")), "left").drop("_id", "_h")
    return found.withColumn("_lines", F.split("_text", "\n"))


def _without(text: Column) -> Column:
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_drop"))
    return F.when(F.col("_drop").isNull(), text).otherwise(F.concat_ws("\n", F.transform(kept, lambda i: F.get("_lines", i))))


def line_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_lines``, ``n_dropped`` and the ``text`` that remains.

    A null text has no lines and stays null; an empty one has one empty line.  Rows with equal ids are one document,
    rows with a null id together as well.  Ties of a position's votes go to the greater token.  An empty table gives no rows.
    Extra columns are ignored, whatever their names.  Texts are read whole; a text's lines are rows, and meet again in its one row.
    """
    found = _marked(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "id", "text")
    return found.select(
        F.col("_doc").alias("doc_id"),
        F.when(F.col("_text").isNull(), 0).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"),
        _without(F.col("_text")).alias("text"),
    )


def dedupe_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs`` without the dropped lines, with all columns; ``chars_col``, if there, is counted anew where lines went.

    Documents of which no word remains go; those that lost nothing stay as they are, null texts too.  Repeated rows are treated alike; an
    empty table gives no rows; columns may have any names.
    """
    found = _marked(docs, id_col, text_col).withColumn("_new", _without(F.col("_text")))
    found = found.where(F.col("_drop").isNull() | F.col("_new").rlike("[^ \\t\\r\\n]"))

    def column(name: str) -> Column:
        was = F.col("_row").getField(name)
        if name == text_col:
            return F.col("_new").alias(name)
        if name == chars_col:
            return F.when(F.col("_drop").isNull(), was).otherwise(F.length("_new")).cast(docs.schema[name].dataType).alias(name)
        return was.alias(name)

    return found.select(*[column(c) for c in docs.columns])


ORACLE = f"""
WITH rows_ AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, text, i - 1 AS no, regexp_replace(trim(regexp_replace(ls[i], '[ \\t\\r]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '{FIELD}', 'g') AS m
  FROM (SELECT doc_id, text, ls, unnest(range(1, len(ls) + 1)) AS i FROM rows_)),
long_ AS (SELECT doc_id, text, no, m, string_split(m, ' ') AS t FROM lines WHERE len(string_split(m, ' ')) >= {MIN_TOKENS}),
forms AS (SELECT DISTINCT m, t, len(t) AS n, t[1:{DEPTH}] AS head_ FROM long_),
shared AS (SELECT n, head_, count(*) AS of_ FROM forms GROUP BY ALL HAVING count(*) > 1),
positions AS (SELECT n, head_, of_, pos_, t[pos_] AS token FROM (SELECT n, head_, of_, t, unnest(range(1, n + 1)) AS pos_ FROM forms JOIN shared USING (n, head_))),
votes AS (SELECT n, head_, of_, pos_, token, count(*) AS votes FROM positions GROUP BY ALL),
best AS (SELECT n, head_, pos_, CASE WHEN votes >= {AGREE} * of_ THEN token ELSE '{FIELD}' END AS token
  FROM (SELECT *, row_number() OVER (PARTITION BY n, head_, pos_ ORDER BY votes DESC, token DESC) AS r FROM votes) WHERE r = 1),
leaves AS (SELECT n, head_, list(token ORDER BY pos_) AS tmpl FROM best GROUP BY ALL),
tree AS (SELECT m, n, CASE WHEN tmpl IS NOT NULL AND len(list_filter(range(1, n + 1), lambda i: t[i] = tmpl[i])) >= {SIMILAR} * n THEN array_to_string(tmpl, ' ') ELSE m END AS template
  FROM forms LEFT JOIN leaves USING (n, head_)),
held AS (SELECT DISTINCT template, n, doc_id FROM long_ JOIN tree USING (m)),
recurring AS (SELECT template, min(doc_id) AS keep FROM held GROUP BY template
  HAVING count(*) >= {MIN_DOCS} OR (max(n) >= {LONG_TOKENS} AND count(*) >= {LONG_MIN_DOCS})),
dropped AS (SELECT doc_id, text, list(DISTINCT no) AS gone FROM long_ JOIN tree USING (m) JOIN recurring USING (template) WHERE doc_id <> keep GROUP BY ALL)
SELECT r.doc_id, CAST(coalesce(len(r.ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(d.gone), 0) AS BIGINT) AS n_dropped,
  sha256(CASE WHEN d.gone IS NULL THEN r.text ELSE array_to_string(list_transform(list_filter(range(0, len(r.ls)), lambda i: NOT list_contains(d.gone, i)), lambda i: r.ls[i + 1]), chr(10)) END) AS text_sha256
FROM rows_ r LEFT JOIN dropped d ON r.doc_id = d.doc_id AND r.text = d.text
"""
