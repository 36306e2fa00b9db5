"""Near-duplicate documents by DartMinHash signatures, banded joining and exact verification.

A document is a weighted set of its shingles (runs of five words; fewer words are one shingle).  A shingle that occurs c times
weighs ``1 + REPEAT_WEIGHT * log2 c``.  Each unit of an element's weight is a region of (weight, rank) space into which hashed
darts fall as a Poisson process; a document sees the darts under its weights, and for each coordinate of the signature keeps the
earliest.  Two documents agree in a coordinate with the probability of their weighted Jaccard similarity.  Darts are thrown in
doubling intervals of rank until every coordinate has one, so that a signature takes time linear in the text.

Rows of ``ROWS`` coordinates make ``BANDS`` band keys.  A document with repeated shingles has the keys of its plain set as well, so
that two similar sets meet however often either repeats its shingles.  Documents that share a key are candidates, and are linked if the Jaccard
similarity of their sets of shingles, computed from the texts, is ``SIMILARITY`` or more.  Classes are the components of links.

Exact copies fall together before anything is joined.  In a bucket of documents with equal band keys, members are held against the
bucket's leader, so that a bucket of n gives n - 1 pairs.  The leader is the member that meets the most others over all its
buckets: in a group of edited copies that is their source, or what is nearest to it.  Each member first tries the leader that it
meets most often, which settles nearly all; only buckets that still hold several classes go on, to all leaders and then to a second
leader, from outside the first one's class, which is held against everyone.  Then whatever is left is compared across
classes, pair by pair in buckets of up to ``SMALL`` members, and in larger ones in blocks: two parts of a bucket meet in one task,
which counts the common shingles of all their members at once.  A link is lost only if its two texts share no band.

All functions take nulls, empty and very long texts (a text is a block of its own, however long) and columns with any names beside the two they read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm._shared import saved
from gridspark.llm._text import SPACE_WORDS, Words, blocks, encoded, mix
from gridspark.llm._worker import tidy

SHINGLE = 5
SIMILARITY = 0.8
ROWS, BANDS = 6, 32
REPEAT_WEIGHT = 0.1
SMALL = 64
#: A larger bucket is dealt into parts of about so many members, or of so many shingles in all.
PART, PART_SHINGLES = 128, 1 << 19
#: Shares that a group of exact copies is dealt over.
DEAL = 64
#: Shingles that a block counts at once.
WIDE = 1 << 13
#: Texts that throw their darts together; each throws some thousands, however short it is.
MOST_TEXTS = 256
_UNIT = 2.0**-53
_ODD = np.uint64(0xD6E8FEB86659FD93)
_FIRST_INTERVAL = 0.25


def _uniform(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * _UNIT


_counts: dict[float, np.ndarray] = {}


def _poisson(mean: float) -> np.ndarray:
    """The distribution function of Poisson(mean) at 0, 1, 2, ..., up to where it is 1."""
    if mean not in _counts:
        top = int(mean + 12 * np.sqrt(mean) + 24)
        logs = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, top + 1)))))
        _counts[mean] = np.cumsum(np.exp(np.arange(top + 1) * np.log(mean) - mean - logs))
    return _counts[mean]


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """[document, coordinate] -> the earliest dart of the weighted sets given as (document, hashed element, weight > 0).

    Documents without elements have zeros.
    """
    whole = np.ceil(weight).astype(np.int64)
    of = np.repeat(np.arange(len(doc)), whole)
    unit = np.arange(len(of)) - np.repeat(np.cumsum(whole) - whole, whole)
    with np.errstate(over="ignore"):
        cell = mix(element[of] + unit.astype(np.uint64) * _ODD)
    room = weight[of] - unit  # at least 1 but in an element's last unit
    cell_doc = doc[of]
    out, best = np.zeros(n * k, np.uint64), np.full(n * k, np.inf)
    empty = np.zeros(n, np.int64)
    empty[np.unique(cell_doc)] = k
    start, length, interval = 0.0, _FIRST_INTERVAL, 0
    while len(cell):
        interval += 1
        with np.errstate(over="ignore"):
            seed = mix(cell ^ mix(np.full(1, interval, np.uint64)))
            darts = np.searchsorted(_poisson(length), _uniform(seed), side="right")
            thrown = np.repeat(np.arange(len(cell)), darts)
            nth = np.arange(len(thrown)) - np.repeat(np.cumsum(darts) - darts, darts)
            dart = mix(seed[thrown] + (nth.astype(np.uint64) + np.uint64(1)) * _ODD)
        part = room[thrown] < 1
        if part.any():
            inside = ~part
            inside[part] = _uniform(mix(dart[part] ^ np.uint64(0xA5A5A5A5A5A5A5A5))) < room[thrown[part]]
            thrown, dart = thrown[inside], dart[inside]
        slot = cell_doc[thrown] * k + ((dart >> np.uint64(32)) * np.uint64(k) >> np.uint64(32)).astype(np.int64)
        new = best[slot] >= start  # an earlier interval's dart stays
        slot, dart = slot[new], dart[new]
        rank = start + length * _uniform(mix(dart))
        np.minimum.at(best, slot, rank)
        first = rank == best[slot]
        out[slot[first]] = dart[first]
        empty = np.where(empty > 0, np.isinf(best.reshape(n, k)).sum(1), 0)
        start, length = start + length, max(start + length, _FIRST_INTERVAL)
        live = empty[cell_doc] > 0
        if not live.all():
            cell, room, cell_doc = cell[live], room[live], cell_doc[live]
    return out.reshape(n, k)


def shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, hash, count) of the distinct shingles of each text, sorted by text and hash."""
    words = Words(texts, SPACE_WORDS, False)
    at, hashes = words.windows(size)
    doc = words.doc[at]
    few = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(few):
        own = np.zeros(len(few), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(size - 1):
                some = words.counts[few] > j
                own[some] = mix(own[some] + words.hash[words.first[few[some]] + j] + np.uint64(j + 1))
        doc, hashes = np.concatenate((doc, few)), np.concatenate((hashes, mix(own ^ _ODD)))
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    if not len(doc):
        return doc, hashes, np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1]))))
    return doc[new], hashes[new], np.diff(np.append(new, len(doc)))


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """[document, band] -> a 64-bit key of the band's coordinates."""
    parts = signatures.reshape(len(signatures), -1, rows)
    out = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=np.uint64), parts.shape[:2]).copy()
    with np.errstate(over="ignore"):
        for j in range(rows):
            out = mix(out * _ODD + parts[:, :, j])
    return out


def sketches(docs: DataFrame, *, id_col: str, text_col: str, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """``id``, ``a``, ``b`` (128 bits of the weighted set), ``n`` (distinct shingles) and ``bands`` of each row that has a word."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("_text")).where("id is not null and _text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, held in blocks(encoded(batch.column(1)), most=MOST_TEXTS):
                doc, h, count = shingles(held)
                n = len(held)
                sizes = np.bincount(doc, minlength=n)
                keys = band_keys(dart_signatures(doc, h, 1 + REPEAT_WEIGHT * np.log2(count), n, rows * bands), rows)
                own = np.concatenate((np.ones(keys.shape, bool), np.zeros(keys.shape, bool)), 1)
                keys = np.concatenate((keys, keys), 1)
                again = np.unique(doc[count > 1])
                if len(again):
                    inside = np.isin(doc, again)
                    plain = np.searchsorted(again, doc[inside])
                    keys[again, bands:] = band_keys(dart_signatures(plain, h[inside], np.ones(len(plain)), len(again), rows * bands), rows)
                    own[again, bands:] = keys[again, bands:] != keys[again, :bands]
                ends = np.concatenate(([0], np.cumsum(sizes)))
                with np.errstate(over="ignore"):
                    one = mix(h ^ mix(count.astype(np.uint64)))
                    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64))) for x in (one, mix(one + _ODD))]
                    a, b = (s[ends[1:]] - s[ends[:-1]] for s in sums)
                some = np.flatnonzero(sizes)
                starts = np.concatenate(([0], np.cumsum(own[some].sum(1)))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(keys[some][own[some]].view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n).take(pa.array(some)), pa.array(a[some].view(np.int64)), pa.array(b[some].view(np.int64)), pa.array(sizes[some].astype(np.int64)), lists], ["id", "a", "b", "n", "bands"])

    return slim.mapInArrow(tidy(run), f"id {slim.schema['id'].dataType.simpleString()}, a long, b long, n long, bands array<long>")


def _similar(u: Column, v: Column) -> Column:
    """Sets of so many shingles can be similar enough."""
    return F.least(u, v) >= F.lit(SIMILARITY) * F.greatest(u, v)


def candidates_texts(docs: DataFrame, ids: DataFrame, *, id_col: str, text_col: str, repeated: bool = False) -> DataFrame:
    """``id`` and ``t`` of the rows that ``ids`` names: the one place where the corpus is shuffled.

    Where rows are ``repeated``, each text of an id is there once: a pair of ids meets in all pairs of their texts.
    """
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).where("t is not null").join(ids, "id", "left_semi")
    return saved(texts.dropDuplicates(["id", "t"]) if repeated else texts, "near-texts")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (``u``, ``v``) whose texts' sets of shingles have the similarity."""
    both = pairs.join(texts.toDF("u", "tu"), "u").join(texts.toDF("v", "tv"), "v").select("u", "v", "tu", "tv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = encoded(batch.column(2)), encoded(batch.column(3))
            size = np.cumsum([len(x) + len(y) for x, y in zip(left, right, strict=True)]) // (1 << 20)
            edges = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(left)] if left else [0]
            for a, b in zip(edges, edges[1:], strict=False):
                du, hu, _ = shingles(left[a:b])
                dv, hv, _ = shingles(right[a:b])
                # A shingle that both sides have is there twice in the sorted union of the distinct ones.
                d, h = np.concatenate((du, dv)), np.concatenate((hu, hv))
                order = np.lexsort((h, d))
                d, h = d[order], h[order]
                common = np.bincount(d[1:][(d[1:] == d[:-1]) & (h[1:] == h[:-1])], minlength=b - a)
                total = np.bincount(d, minlength=b - a) - common
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns[:2]], ["u", "v"]).filter(pa.array(common >= SIMILARITY * total))

    kind = pairs.schema["u"].dataType.simpleString()
    return both.mapInArrow(tidy(run), f"u {kind}, v {kind}").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the least node of its component) of every node of ``edges`` (``u``, ``v``) but the roots.

    Every node hooks on to its least smaller neighbour, pointers are doubled until they end at roots, and edges
    between the trees go on; each of these rounds at least halves what is left of a path.
    """
    rest = saved(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u <> v").distinct(), "near-edges")
    total = None
    while True:
        tree = rest.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("root"))
        while True:
            above = tree.toDF("root", "above")
            tree = saved(tree.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "near-tree")
            if tree.where("moved").isEmpty():
                break
            tree = tree.drop("moved")
        tree = tree.drop("moved")
        if total is None:
            total = tree
        else:
            moved = total.join(tree.toDF("root", "above"), "root", "left").select("node", F.coalesce("above", "root").alias("root"))
            total = saved(moved.union(tree.join(total, "node", "left_anti")), "near-roots")
        to = tree.toDF("x", "r")
        mapped = rest.join(to, rest["u"] == to["x"], "left").select(F.coalesce("r", "u").alias("u"), "v")
        mapped = mapped.join(to, mapped["v"] == to["x"], "left").select("u", F.coalesce("r", "v").alias("v"))
        rest = saved(mapped.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "near-edges")
        if rest.isEmpty():
            return total


def _classes(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """``members`` with the class ``c`` of each ``id``."""
    if roots is None:
        return members.withColumn("c", F.col("id"))
    return members.join(roots.toDF("id", "_root"), "id", "left").select("*", F.coalesce("_root", "id").alias("c")).drop("_root")


def _mixed(members: DataFrame) -> DataFrame:
    """The members of buckets that hold several classes, with the bucket's ``size`` and ``leader`` {w, id, n, c}."""
    buckets = members.groupBy("key").agg(F.max(F.struct("w", "id", "n", "c")).alias("leader"), F.count("*").alias("size"), F.min("c").alias("_low"), F.max("c").alias("_high")).where("_low <> _high").select("key", "leader", "size")
    return members.join(buckets, "key")


def _to_leader(mixed: DataFrame, leader: str = "leader") -> DataFrame:
    """Pairs of members and the leader of another class; the greater id comes first."""
    other = mixed.where((F.col("c") != F.col(f"{leader}.c")) & _similar(F.col("n"), F.col(f"{leader}.n")))
    return other.select(F.greatest("id", f"{leader}.id").alias("u"), F.least("id", f"{leader}.id").alias("v"))


def _to_second(mixed: DataFrame) -> DataFrame:
    """Pairs of all members and a second leader from outside the first one's class."""
    second = mixed.where(F.col("c") != F.col("leader.c")).groupBy("key").agg(F.max(F.struct("w", "id", "n", "c")).alias("second"))
    return _to_leader(mixed.join(second, "key"), "second")


def _across(mixed: DataFrame) -> DataFrame:
    """Pairs of members of different classes in buckets of up to ``SMALL``, each in the least of these buckets that both are in."""
    small = mixed.where(F.col("size") <= SMALL).select("key", "id", "n", "c")
    small = small.join(small.groupBy("id").agg(F.collect_list("key").alias("b")).toDF("_id", "b"), F.col("id") == F.col("_id")).select("id", "key", "n", "c", "b")
    other = small.toDF("v", "key", "vn", "vc", "vb")
    least = F.array_min(F.array_intersect("b", "vb"))
    pairs = small.join(other, (small["key"] == other["key"]) & (F.col("id") > F.col("v")) & (F.col("c") != F.col("vc")) & _similar(F.col("n"), F.col("vn")) & (least == small["key"]))
    return pairs.select(F.col("id").alias("u"), "v")


def _parts(mixed: DataFrame) -> DataFrame:
    """``key``, ``i``, ``j``, ``id`` and ``c``: the blocks of two parts (or one) in which the members of buckets beyond ``SMALL`` meet.

    The members of a bucket's largest class have parts of their own, which need not meet each other.
    """
    large = mixed.where(F.col("size") > SMALL).select("key", "id", "n", "c")
    sizes = large.groupBy("key", "c").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    top = sizes.groupBy("key").agg(F.max(F.struct("k", "c", "s")).alias("top"), F.sum("k").alias("k"), F.sum("s").alias("s"))
    number = lambda k, s: F.ceil(F.greatest(k / F.lit(PART), s / F.lit(PART_SHINGLES))).cast("long")
    top = top.select("key", F.col("top.c").alias("_c"), number(F.col("top.k"), F.col("top.s")).alias("_p"), number(F.col("k") - F.col("top.k"), F.col("s") - F.col("top.s")).alias("_q"))
    inner = F.col("c") == F.col("_c")
    own = F.when(inner, F.col("_q") + F.pmod(F.xxhash64("id"), "_p")).otherwise(F.pmod(F.xxhash64("id"), "_q"))
    met = F.explode(F.sequence(F.lit(0).cast("long"), F.when(inner, F.col("_q") - 1).otherwise(F.col("_q") + F.col("_p") - 1)))
    dealt = large.join(top, "key").select("key", "id", "c", own.alias("_own"), met.alias("_met"))
    return dealt.select("key", F.least("_own", "_met").alias("i"), F.greatest("_own", "_met").alias("j"), "id", "c")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """``id`` and ``h``, the hashes of the distinct shingles, of ``texts`` (``id``, ``t``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, held in blocks(encoded(batch.column(1))):
                doc, h, _ = shingles(held)
                ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(held)))))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(held)), lists], ["id", "h"])

    return texts.select("id", "t").mapInArrow(tidy(run), f"id {texts.schema['id'].dataType.simpleString()}, h array<long>")


def _common(sets: pa.ListArray) -> np.ndarray:
    """[row, row] -> how many elements both lists of distinct values have."""
    row = np.repeat(np.arange(len(sets)), np.asarray(sets.value_lengths()))
    _, column, times = np.unique(np.asarray(sets.flatten()), return_inverse=True, return_counts=True)
    twice = times[column] > 1
    number = np.cumsum(times > 1) - 1
    row, column = row[twice], number[column[twice]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, WIDE):
        a, b = np.searchsorted(column, (first, first + WIDE))
        has = np.zeros((len(sets), WIDE), np.float32)
        has[row[a:b], column[a:b] - first] = 1
        out += has @ has.T
    return out


def compared(parts: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (``u``, ``v``) between members of different classes that meet in a block: each linked one and the first that links lead to."""
    kind = sets.schema["id"].dataType.simpleString()

    def run(table):
        sets = table["h"].combine_chunks()
        n, c = np.asarray(sets.value_lengths()).astype(np.int64), np.asarray(table["c"].combine_chunks().dictionary_encode().indices)
        common = _common(sets)
        linked = (common >= SIMILARITY * (n[:, None] + n[None, :] - common)) & (c[:, None] != c[None, :])
        to = np.arange(len(n))
        while True:
            less = np.minimum(to, np.where(linked, to[None, :], len(n)).min(1))
            if (less == to).all():
                break
            to = less
        moved = np.flatnonzero(to != np.arange(len(n)))
        return pa.table({"u": table["id"].take(pa.array(moved)), "v": table["id"].take(pa.array(to[moved]))})

    return parts.join(sets, "id").groupBy("key", "i", "j").applyInArrow(run, f"u {kind}, v {kind}").distinct()


def _copies(sketch: DataFrame) -> DataFrame:
    """``id`` and ``first`` (the least id of its exact copies) of every row of ``sketch``.

    A group of copies is dealt over ``DEAL`` shares by its ids, each of which is told the group's first, so that no task holds a whole large group.
    """
    dealt = sketch.select("id", "a", "b", F.pmod(F.xxhash64("id"), F.lit(DEAL)).alias("_share"))
    shares = dealt.groupBy("a", "b", "_share").agg(F.min("id").alias("_least"), F.count("*").alias("_rows"))
    groups = shares.groupBy("a", "b").agg(F.min("_least").alias("first"), F.sum("_rows").alias("_rows"), F.collect_list("_share").alias("_shares")).where("_rows > 1")
    told = groups.select("a", "b", F.explode("_shares").alias("_share"), "first")
    return dealt.join(told, ["a", "b", "_share"], "left").select("id", F.coalesce("first", "id").alias("first"))


def _joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """``roots`` after further links between members."""
    if roots is None:
        return components(links)
    old = links.join(roots.toDF("u", "_u"), "u", "left").join(roots.toDF("v", "_v"), "v", "left").select(F.coalesce("_u", "u").alias("u"), F.coalesce("_v", "v").alias("v"))
    new = components(old)
    moved = roots.join(new.toDF("root", "_to"), "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    return saved(moved.union(new.join(roots, "node", "left_anti")), "near-roots")


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``class_id`` (the least id of its class) of every row of ``docs``.

    A class is a component of links of similarity ``SIMILARITY`` or more.  Null, empty and wordless texts, and rows with a null id, are
    alone (the null id has a null class).  Rows with equal ids are one document and share a class.  An empty table gives no rows.
    """
    sketch = saved(sketches(docs, id_col=id_col, text_col=text_col), "near-sketches")
    same = sketch.groupBy("a", "b").agg(F.min("id").alias("id"))
    own = saved(_copies(sketch).groupBy("id").agg(F.min("first").alias("first"), F.max("first").alias("_last"), F.collect_set("first").alias("_all"), F.count("*").alias("_rows")), "near-copies")
    # An id that has several texts joins their classes.
    twice = own.where("first <> _last").select(F.explode("_all").alias("u"), F.col("first").alias("v")).where("u <> v")
    # Of each group of exact copies, the first one's band keys go on; only keys that two of them share do.
    first = sketch.join(same, ["a", "b", "id"], "left_semi").dropDuplicates(["id", "a", "b"]).select("id", "n", "bands")
    bands = first.select("id", "n", F.explode("bands").alias("key"))
    shared = bands.groupBy("key").agg(F.min("id").alias("_low"), F.max("id").alias("_high"), F.count("*").alias("_size")).where("_low <> _high").select("key", "_size")
    met = saved(bands.join(shared, "key"), "near-members")
    weight = met.groupBy("id").agg(F.sum("_size").alias("w"))
    members = met.join(weight, "id").select("key", "id", "n", "w")
    repeated = not own.where(F.col("_rows") > F.size("_all")).isEmpty()  # an id has a text more than once
    texts = candidates_texts(docs, weight.select("id"), id_col=id_col, text_col=text_col, repeated=repeated)
    roots, done = (None if twice.isEmpty() else components(twice)), None
    # First each member and the leader that it meets in the most buckets, then all leaders, a second one, and small buckets.
    for step in range(4):
        mixed = saved(_mixed(_classes(members, roots)), "near-mixed")
        if step == 0:
            votes = _to_leader(mixed).groupBy("u", "v").agg(F.count("*").alias("_n"))
            pairs = votes.groupBy("u").agg(F.max_by("v", F.struct("_n", "v")).alias("v")).select("u", "v")
        else:
            pairs = _to_leader(mixed) if step == 1 else _to_second(mixed) if step == 2 else _across(mixed)
            pairs = pairs.distinct().join(done, ["u", "v"], "left_anti")
        pairs = saved(pairs, "near-pairs")
        if not pairs.isEmpty():
            links = saved(verified(pairs, texts), "near-links")
            if not links.isEmpty():
                roots = _joined(roots, links)
        done = pairs if done is None else done.union(pairs)
        members = mixed.select("key", "id", "n", "w")  # buckets of one class are settled
    # Then all pairs that large buckets still hold.
    parts = saved(_parts(_mixed(_classes(members, roots))), "near-parts")
    if not parts.isEmpty():
        sets = saved(shingle_sets(texts.join(parts.select("id").distinct(), "id", "left_semi")), "near-sets")
        links = saved(compared(parts, sets), "near-links")
        if not links.isEmpty():
            roots = _joined(roots, links)
    rows = docs.select(F.col(id_col).alias("id")).join(own.select("id", "first"), "id", "left").select("id", F.coalesce("first", "id").alias("first"))
    if roots is None:
        return rows.select("id", F.col("first").alias("class_id"))
    return rows.join(roots.toDF("first", "_root"), "first", "left").select("id", F.coalesce("_root", "first").alias("class_id"))


def _repeated(docs: DataFrame, id_col: str) -> DataFrame:
    """The ids, of rows in any number, that more than one row has."""
    return saved(docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.count("*").alias("_rows")).where("_rows > 1").select("id"), "near-repeated")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``class_id`` and ``kept`` of every row of ``docs``: the first of its class is kept, and what is alone.

    Of rows with equal ids one alone is kept; such rows differ here in nothing but ``kept``.  :func:`first_of_class`, which gives whole rows, keeps that with the least text.
    """
    found = classes(docs, id_col=id_col, text_col=text_col)
    kept = F.coalesce(F.col("id") == F.col("class_id"), F.lit(True))
    twice = _repeated(docs, id_col)
    if twice.isEmpty():
        return found.select(F.col("id").alias("doc_id"), "class_id", kept.alias("kept"))
    rows = saved(found.withColumn("_row", F.monotonically_increasing_id()), "near-rows")
    first = rows.join(twice, "id", "left_semi").groupBy("id").agg(F.min("_row").alias("_first"))
    again = F.coalesce(F.col("_row") != F.col("_first"), F.lit(False))
    return rows.join(first, "id", "left").select(F.col("id").alias("doc_id"), "class_id", (kept & ~again).alias("kept"))


def _former(docs: DataFrame, more: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` and ``t``: those texts in ``more`` of documents in ``docs`` that ``docs`` itself does not have.  Hashes alone are compared."""
    hashed = lambda df: df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("_h"))
    own = hashed(docs)
    changed = saved(hashed(more).join(own, ["id", "_h"], "left_anti").join(own.select("id"), "id", "left_semi").distinct(), "near-changed")
    return more.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("_h"), F.col(text_col).cast("string").alias("t")).join(changed, ["id", "_h"], "left_semi").select("id", "t")


def first_of_class(docs: DataFrame, *, more: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns; of rows with equal ids one (that with the first text) stays.

    ``more`` holds further texts of the same documents, by id, such as they were before something was cut out of them: two documents are linked
    if any of their texts are.  Then the document with the longest text of its class in ``docs`` stays (the first of equals), else the first.
    Rows with a null id, null texts and texts without a word stay; an empty table gives no rows.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    texts = narrow if more is None else saved(narrow.union(_former(docs, more, id_col, text_col)), "near-all-texts")
    found = classes(texts, id_col="id", text_col="t")
    if more is None:
        gone = saved(found.where("id <> class_id").select("id").distinct(), "near-gone")
    else:
        several = saved(found.where("id <> class_id").distinct(), "near-several")
        members = several.union(several.select("class_id", "class_id").distinct())
        lengths = narrow.select("id", F.coalesce(F.length("t"), F.lit(0)).alias("_long")).join(members, "id")
        best = lengths.groupBy("class_id").agg(F.min_by("id", F.struct(-F.col("_long"), F.col("id"))).alias("_best"))
        gone = saved(members.join(best, "class_id").where("id <> _best").select("id").distinct(), "near-gone")
    left = docs.join(gone.withColumnRenamed("id", id_col), id_col, "left_anti").select(*docs.columns)
    twice = _repeated(docs, id_col)
    if twice.isEmpty():
        return left
    again = left.join(twice.withColumnRenamed("id", id_col), id_col, "left_semi").select(*docs.columns)
    whole = F.struct(*docs.columns)
    one = again.groupBy(id_col).agg(F.min_by(whole, F.struct(F.col(text_col), F.to_json(whole))).alias("_one")).select("_one.*")
    return left.join(twice.withColumnRenamed("id", id_col), id_col, "left_anti").select(*docs.columns).unionByName(one)
