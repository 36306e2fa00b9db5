"""Vector code compression: product codes by weighted Lloyd rounds over distinct integer parts.

Vectors become integers and are cut into equal parts.  Equal parts of a position are one weighted row, so that what repeats is
assigned once; the rounds run over these rows only.  Codes and errors then go back to the vectors by a join, hot parts by broadcast.
A codebook is ``entries`` rows for each position, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm._lookup import looked_up
from gridspark.llm._shared import saved
from gridspark.llm._worker import tidy

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
_BLOCK = 2048
_MOST = (1 << 63) - 1


def _distances(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of all points to all entries: floats where every step stays below 2**53, else integers of any size."""
    most = max(float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (points, book))
    if most * most * 4 * points.shape[1] < 2.0**52:
        p, c = points.astype(np.float64), book.astype(np.float64)
        return (p * p).sum(1)[:, None] - 2 * (p @ c.T) + (c * c).sum(1)[None, :]
    p, c = points.astype(object), book.astype(object)
    return np.stack([((p - entry) ** 2).sum(1) for entry in c], 1)


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """The index of each point's nearest entry, the lower of equal ones, and its squared distance."""
    index, error = np.empty(len(points), np.int64), []
    for a in range(0, len(points), _BLOCK):
        d = _distances(points[a : a + _BLOCK], book)
        at = np.array([min(range(len(r)), key=r.__getitem__) for r in d], np.int64) if d.dtype == object else d.argmin(1)
        index[a : a + _BLOCK] = at
        error += [int(x) for x in d[np.arange(len(at)), at]]
    return index, error


def _sums(points: np.ndarray, weights: np.ndarray, index: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """(weighted sums as integers of any size, weights) of each entry's points."""
    counts = np.zeros(entries, np.int64)
    np.add.at(counts, index, weights)
    wide = float(np.abs(points.astype(np.float64)).max(initial=0)) * float(weights.sum()) >= 2.0**62
    sums = np.zeros((entries, points.shape[1]), object if wide else np.int64)
    np.add.at(sums, index, points.astype(sums.dtype) * weights.astype(sums.dtype)[:, None])
    return sums.astype(object), counts


def _points(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, points, weights) of rows of distinct parts."""
    pos = batch.column("pos").to_numpy()
    return pos, batch.column("part").flatten().to_numpy().reshape(len(pos), -1), batch.column("times").to_numpy()


def _improved(distinct: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round.  A task gives a row for each used entry at most, and so do all of them to the driver."""
    size = books[0].shape[1]
    sent = distinct.sparkSession.sparkContext.broadcast(books)  # PARTS * ENTRIES entries
    number = pa.decimal128(38, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(b.shape, object), np.zeros(len(b), np.int64)) for b in sent.value]
        for batch in batches:
            pos, points, weights = _points(batch)
            for k in np.unique(pos):
                own = pos == k
                book = sent.value[k]
                sums, counts = _sums(points[own], weights[own], nearest(points[own], book)[0], len(book))
                held[k][0][:] += sums
                held[k][1][:] += counts
        used = [(k, e) for k, (_, counts) in enumerate(held) for e in np.flatnonzero(counts).tolist()]
        totals = pa.array([[Decimal(int(x)) for x in held[k][0][e]] for k, e in used], pa.list_(number))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in used], pa.int32()), pa.array([e for _, e in used], pa.int32()), pa.array([int(held[k][1][e]) for k, e in used], pa.int64()), totals], ["pos", "entry", "n", "sums"])

    each = [F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(size)]
    rows = distinct.mapInArrow(tidy(run), "pos int, entry int, n long, sums array<decimal(38,0)>").groupBy("pos", "entry").agg(F.sum("n").alias("n"), *each).collect()
    out = [b.copy() for b in books]
    for r in rows:
        out[r["pos"]][r["entry"]] = [int(r[f"s{j}"]) // r["n"] for j in range(size)]
    return out


def _assigned(distinct: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``distinct`` with ``index`` and ``error``."""
    sent = distinct.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, points, _ = _points(batch)
            index, error = np.empty(len(pos), np.int32), np.empty(len(pos), np.int64)
            for k in np.unique(pos):
                own = pos == k
                at, far = nearest(points[own], sent.value[k])
                index[own], error[own] = at, [min(x, _MOST) for x in far]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index), pa.array(error)], [*batch.schema.names, "index", "error"])

    return distinct.mapInArrow(tidy(run), "pos int, part array<bigint>, times long, index int, error long")


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(int(x)) for b in books for entry in b for x in entry).encode()).hexdigest()


def coded(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """``id_col``, ``code`` (two hex digits for each part), ``error``, ``label_error`` and ``codebooks_sha256`` of every vector.

    A component is ``floor(scale * x)``, held to 64 bits.  Codebooks start as the parts of the ``entries`` least ids (ties by components,
    null ids last); fewer vectors give fewer entries.  A null vector, and one with a null or non-finite component, gives no row.  All vectors
    must be as long as the least id's, in ``parts`` equal parts; one that is not, or is empty, gets null codes and errors and counts nowhere.
    Rows that repeat give a row each.  Null labels count as one label.  Errors beyond 64 bits end there.  An empty table gives no rows;
    extra columns are ignored.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col).cast("array<double>")
    finite = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    whole = F.transform(v, lambda x: F.floor(x * float(scale)))
    rows = saved(vectors.where(finite).select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), whole.alias("_v")), "vectors")
    first = rows.orderBy(F.col("_id").asc_nulls_last(), "_v").limit(entries).select("_v").collect()  # as many rows as a codebook has entries
    size = len(first[0]["_v"]) if first else 0
    fits = (F.size("_v") == size) if size and size % parts == 0 else F.lit(False)
    start = [r["_v"] for r in first if len(r["_v"]) == size]
    odd = rows.where(~fits).select(F.col("_id").alias(id_col), F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("long").alias("label_error"), F.lit(None).cast("string").alias("codebooks_sha256"))
    if not size or size % parts:
        return odd
    step = size // parts
    books = [np.array([x[k * step : (k + 1) * step] for x in start], np.int64) for k in range(parts)]
    cut = rows.where(fits).select("_row", "_id", "_label", F.posexplode(F.array(*[F.slice("_v", k * step + 1, step) for k in range(parts)])).alias("pos", "part"))
    distinct = saved(cut.groupBy("pos", "part").agg(F.count("*").alias("times")), "vector-parts")
    for _ in range(rounds):
        books = _improved(distinct, books)
    total = distinct.agg(F.sum("times")).first()[0]
    found = looked_up(cut, saved(_assigned(distinct, books), "part-codes"), ["pos", "part"], "times", total)
    clipped = lambda c: F.least(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(_MOST).cast("decimal(38,0)")).cast("long")
    digits = F.transform(F.array_sort(F.collect_list(F.struct("pos", "index"))), lambda x: F.lower(F.lpad(F.hex(x["index"]), 2, "0")))
    each = found.groupBy("_row").agg(F.first("_id").alias("_id"), F.struct(F.first("_label").alias("x")).alias("_label"), F.array_join(digits, "").alias("code"), clipped("error").alias("error"))
    each = saved(each, "vector-codes")
    by_label = each.groupBy("_label").agg(F.count("*").alias("times"), clipped("error").alias("label_error"))
    out = looked_up(each, by_label, ["_label"], "times", total // parts)
    return out.select(F.col("_id").alias(id_col), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256")).unionByName(odd)


def _oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """The same in SQL: one row for each component, and the rounds one after another."""
    steps = [f"""
kept AS (SELECT row_number() OVER () AS r, vec_id, label, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND isfinite(list_sum(embedding::DOUBLE[]))),
flat AS (SELECT r, vec_id, unnest(range(len(e))) AS i, CAST(floor(unnest(e)::DOUBLE * {scale}) AS BIGINT) AS x, len(e) // {parts} AS d FROM kept),
points AS MATERIALIZED (SELECT r, i // d AS part, i % d AS j, x FROM flat),
started AS (SELECT r, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY row_number() OVER (ORDER BY vec_id) <= {entries}),
book0 AS MATERIALIZED (SELECT part, entry, j, x FROM points JOIN started USING (r))"""]
    for k in range(rounds + 1):
        steps.append(f"""
far{k} AS (SELECT p.r, p.part, b.entry, sum((p.x - b.x) * (p.x - b.x))::BIGINT AS d FROM points p JOIN book{k} b ON p.part = b.part AND p.j = b.j GROUP BY ALL),
near{k} AS MATERIALIZED (SELECT r, part, min(struct_pack(d := d, entry := entry)) AS b FROM far{k} GROUP BY ALL)""")
        if k < rounds:
            steps.append(f"""
mean{k} AS (SELECT n.part, n.b.entry AS entry, p.j, CAST(floor(sum(p.x)::DOUBLE / count(*)) AS BIGINT) AS x FROM near{k} n JOIN points p ON n.r = p.r AND n.part = p.part GROUP BY ALL),
book{k + 1} AS MATERIALIZED (SELECT part, entry, j, coalesce(m.x, o.x) AS x FROM book{k} o LEFT JOIN mean{k} m USING (part, entry, j))""")
    return "WITH " + ",".join(steps) + f""",
codes AS (SELECT r, string_agg(lower(lpad(to_hex(b.entry), 2, '0')), '' ORDER BY part) AS code, sum(b.d)::BIGINT AS error FROM near{rounds} GROUP BY r),
books AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, j)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM codes JOIN kept USING (r), books"""


ORACLE = _oracle()
