"""Phrase collocation mining by hierarchical pair naming.

Texts become blocks of word numbers.  A phrase of k words is a pair of adjacent, overlapping phrases of k-1 words, of which only frequent
ones have a name; pairs are counted over all blocks, frequent ones get an id, and a join brings the ids back to the blocks, whose
sequences then hold these.  The two ids of a pair are the phrase without its last and without its first word: by them a phrase
inherits the counts of all its beginnings and ends, which cuts need, and finds what contains it.

What is shuffled are the distinct pairs of each block with their number, and the blocks' packed sequences; texts never are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridspark.llm._lookup import looked_up
from gridspark.llm._shared import saved
from gridspark.llm._text import LOWER, table
from gridspark.llm._worker import tidy

MIN_COUNT, LONGEST, TOP, CONTAINED, SCALE = 30, 4, 2000, 80, 2_000_000
#: Bytes of text in a block; it bounds the memory of a task together with the longest piece of a text.
BLOCK = 8 << 20
#: Up to so many names, a level's table of names is broadcast; beyond that, blocks' pairs and names meet by a shuffle.
SENT = 1_000_000
#: Shares of a language's candidates, each of which gives its own first ``TOP``.
SHARES = 64
_MARKS = b".,;:!?\n\x0b\x0c\r"
_MARK = ~table(_MARKS)
_WORD = table(b" \t" + _MARKS)


def _cut(text: bytes, limit: int) -> Iterator[bytes]:
    """A text in parts of about ``limit`` bytes that end at marks, so that no piece is cut."""
    at = 0
    while len(text) - at > limit:
        end = max(text.rfind(bytes([m]), at, at + limit) for m in _MARKS)
        if end < 0:  # one long piece
            end = min((x for m in _MARKS if (x := text.find(bytes([m]), at + limit)) >= 0), default=len(text))
        yield text[at : end + 1]
        at = end + 1
    if at < len(text) or not text:
        yield text[at:]


def _blocks(texts: Iterator[tuple[str, bytes]], limit: int) -> Iterator[tuple[list[str], list[bytes]]]:
    langs, held, size = [], [], 0
    for lang, whole in texts:
        for part in _cut(whole, limit):
            if held and size + len(part) > limit:
                yield langs, held
                langs, held, size = [], [], 0
            langs.append(lang)
            held.append(part)
            size += len(part) + 1
    if held:
        yield langs, held


def scanned(langs: list[str], texts: list[bytes]) -> tuple[np.ndarray, list[str], list[bytes], np.ndarray]:
    """(sequence of numbers of distinct words, -1 between pieces; the language, word and count of each number).

    After the words comes an empty one for each language, which counts all of its words.
    """
    buf = LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]  # the line break between texts ends a piece
    inside = _WORD[buf]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.int32), [], [], np.empty(0, np.int64)
    offsets = np.concatenate(([0], np.cumsum(ends - starts)))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(buf[inside])]).dictionary_encode()
    known, lang_of = np.unique(np.array(langs, object), return_inverse=True)
    of_text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, side="right")
    n = len(words.dictionary)
    distinct, number, counts = np.unique(lang_of[of_text] * n + words.indices.to_numpy(), return_inverse=True, return_counts=True)
    piece = np.cumsum(_MARK[buf], dtype=np.int64)[starts]
    sequence = np.insert(number.astype(np.int32), np.flatnonzero(np.diff(piece)) + 1, -1)
    all_words = np.bincount(distinct // n, weights=counts, minlength=len(known)).astype(np.int64)
    return sequence, [*known[distinct // n], *known], [*words.dictionary.take(pa.array(distinct % n)).to_pylist(), *[b""] * len(known)], np.append(counts, all_words)


def paired(sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence of numbers of distinct pairs, -1 where there is none; both ids and the count of each number) of a sequence of ids or -1."""
    at = np.flatnonzero((sequence[:-1] >= 0) & (sequence[1:] >= 0))
    ids, place = np.unique(sequence, return_inverse=True)
    distinct, number, counts = np.unique(place[at] * len(ids) + place[at + 1], return_inverse=True, return_counts=True)
    out = np.full(len(sequence), -1, np.int64)
    out[at] = number
    return out, ids[distinct // max(len(ids), 1)], ids[distinct % max(len(ids), 1)], counts


def _packed(sequence: np.ndarray) -> bytes:
    return len(sequence).to_bytes(8, "little") + pa.Codec("zstd").compress(sequence.astype(np.int64).tobytes(), asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.Codec("zstd").decompress(data[8:], 8 * n), np.int64)


_SEQUENCES = pa.schema([("block", pa.int64()), ("seq", pa.binary())])
#: A block is a row with ``seq``; the distinct words or pairs in it are rows without.
_WORDS = pa.schema([*_SEQUENCES, ("no", pa.int32()), ("lang", pa.string()), ("word", pa.string()), ("n", pa.int64())])
_PAIRS = pa.schema([*_SEQUENCES, ("no", pa.int32()), ("left", pa.int64()), ("right", pa.int64()), ("n", pa.int64())])
_ROWS = 50_000


def _sequence_row(block: int, sequence: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([_packed(sequence)], pa.binary())], schema=_SEQUENCES)


def _distinct_rows(schema: pa.Schema, block: int, first, second, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    n = len(counts)
    columns = [pa.array(np.full(n, block)), pa.nulls(n, pa.binary()), pa.array(np.arange(n, dtype=np.int32)), pa.array(first, schema.field(3).type), pa.array(second).cast(schema.field(4).type), pa.array(counts.astype(np.int64))]
    batch = pa.RecordBatch.from_arrays(columns, schema=schema)
    for a in range(0, n, _ROWS):
        yield batch.slice(a, _ROWS)


def _tagged(schema: pa.Schema, block: int, found: tuple) -> Iterator[pa.RecordBatch]:
    row = _sequence_row(block, found[0])
    yield pa.RecordBatch.from_arrays([*row.columns, *[pa.nulls(1, f.type) for f in list(schema)[2:]]], schema=schema)
    yield from _distinct_rows(schema, block, *found[1:])


class _Level:
    """What is read block by block: the words of texts, or the pairs of a table of sequences."""

    schema: pa.Schema
    ddl: str
    keys: list[str]
    always = "false"  # what is kept however rare

    def __init__(self, source: DataFrame):
        self.source = source

    def __getstate__(self) -> dict:  # tasks read blocks; the source stays with the driver
        return {k: v for k, v in self.__dict__.items() if k != "source"}

    def blocks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        raise NotImplementedError

    def lookup(self, first, second, names: tuple) -> np.ndarray:
        """The ids of distinct words or pairs by a table of names that was sent, -1 where there is none."""
        raise NotImplementedError

    def sendable(self, names: DataFrame) -> tuple:
        raise NotImplementedError

    def _each(self, give, ddl: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block, found in self.blocks(batches):
                yield from give(block, found)

        return self.source.mapInArrow(tidy(run), ddl)

    def counted(self, least: int) -> DataFrame:
        """The keys, ``id``, ``f`` and ``times`` (blocks) of all that is frequent."""
        local = self._each(lambda block, found: (b.select([*self.keys, "n"]) for b in _distinct_rows(self.schema, block, *found[1:])), ", ".join(self.ddl.split(", ")[3:]))
        found = local.groupBy(*self.keys).agg(F.sum("n").alias("f"), F.count("*").alias("times")).where(f"f >= {int(least)} or {self.always}")
        return saved(found.withColumn("id", F.monotonically_increasing_id()), "phrase-names")

    def named(self, names: DataFrame) -> DataFrame:
        """Sequences of ids."""
        if names.count() > SENT:
            return self._named_by_shuffle(names)
        sent = self.source.sparkSession.sparkContext.broadcast(self.sendable(names))  # at most SENT names

        def give(block: int, found: tuple) -> Iterator[pa.RecordBatch]:
            yield _sequence_row(block, np.append(self.lookup(found[1], found[2], sent.value), -1)[found[0]])

        return saved(self._each(give, "block long, seq binary"), "phrase-sequences")

    def _named_by_shuffle(self, names: DataFrame) -> DataFrame:
        rows = saved(self._each(lambda block, found: _tagged(self.schema, block, found), self.ddl), "phrase-blocks")
        local = rows.where("seq is null").select("block", "no", *self.keys)
        ids = looked_up(local, names.select(*self.keys, "id", "times"), self.keys, "times", local.count()).select(F.col("block").alias("block"), "no", "id")
        blocks = rows.where("seq is not null").select(F.col("block").alias("block"), "seq")  # new aliases keep both sides' columns apart

        def run(key: tuple, held: pa.Table, found: pa.Table) -> pa.Table:
            sequence = _unpacked(held.column("seq")[0].as_py())
            no = found.column("no").to_numpy()
            to = np.full(max(int(sequence.max(initial=-1)), int(no.max(initial=-1))) + 2, -1, np.int64)  # the last one is for -1
            to[no] = found.column("id").to_numpy()
            return pa.Table.from_batches([_sequence_row(key[0].as_py(), to[sequence])])

        return saved(blocks.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(run, "block long, seq binary"), "phrase-sequences")


class _Words(_Level):
    schema, keys, ddl = _WORDS, ["lang", "word"], "block long, seq binary, no int, lang string, word string, n long"
    always = "word = ''"

    def __init__(self, docs: DataFrame, text_col: str, lang_col: str, size: int):
        super().__init__(docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
        self.size = size

    def blocks(self, batches):
        task = TaskContext.get().partitionId()
        texts = ((lang, text) for b in batches for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True))
        for k, (langs, held) in enumerate(_blocks(texts, self.size)):
            yield (task << 32) + k, scanned(langs, held)

    @staticmethod
    def _joined(langs, words) -> pa.Array:
        return pc.binary_join_element_wise(pa.array(langs, pa.string()).cast(pa.large_binary()), pa.array(words).cast(pa.large_binary()), pa.scalar(b"\t", pa.large_binary()))  # no word has a tab

    def sendable(self, names):
        found = names.select("lang", "word", "id").toArrow()
        return self._joined(found.column("lang").combine_chunks(), found.column("word").combine_chunks()), found.column("id").to_numpy()

    def lookup(self, first, second, names):
        at = pc.index_in(self._joined(first, second), value_set=names[0]).fill_null(-1).to_numpy()
        return np.append(names[1], -1)[at]


class _Pairs(_Level):
    schema, keys, ddl = _PAIRS, ["left", "right"], "block long, seq binary, no int, left long, right long, n long"

    def blocks(self, batches):
        for batch in batches:
            for block, seq in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield block, paired(_unpacked(seq.as_py()))

    def sendable(self, names):
        found = names.select("left", "right", "id").toPandas().to_numpy(np.int64).reshape(-1, 3)
        left, right = np.unique(found[:, 0]), np.unique(found[:, 1])
        keys = np.searchsorted(left, found[:, 0]) * len(right) + np.searchsorted(right, found[:, 1])
        order = np.argsort(keys)
        return left, right, keys[order], found[order, 2]

    def lookup(self, first, second, names):
        left, right, keys, ids = names
        if not len(ids):
            return np.full(len(first), -1, np.int64)
        a, b = np.minimum(np.searchsorted(left, first), len(left) - 1), np.minimum(np.searchsorted(right, second), len(right) - 1)
        wanted = a * len(right) + b
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where((left[a] == first) & (right[b] == second) & (keys[at] == wanted), ids[at], -1)


def _inherited(names: DataFrame, shorter: DataFrame, n_names: int) -> DataFrame:
    """Phrases of a level: ``id``, ``left``, ``right``, ``lang``, ``phrase``, ``last`` (word), ``f``, and the counts of its beginnings (``heads``) and ends (``tails``), by length."""

    def parent(df: DataFrame, side: str, columns: dict[str, str]) -> DataFrame:
        children = df.groupBy(side).agg(F.count("*").alias("times"))
        known = shorter.select(F.col("id").alias(side), *[F.col(c).alias(to) for c, to in columns.items()]).join(children, side)
        return looked_up(df, known, [side], "times", n_names)

    both = parent(parent(names.select("id", "left", "right", "f"), "left", {"lang": "lang", "phrase": "_head", "heads": "_heads"}), "right", {"last": "last", "tails": "_tails"})
    own = F.array("f")
    return both.select("id", "left", "right", "lang", F.concat_ws(" ", "_head", "last").alias("phrase"), "last", "f", F.concat("_heads", own).alias("heads"), F.concat("_tails", own).alias("tails"))


def _scored(level: DataFrame, k: int, longer: DataFrame | None, contained: int) -> DataFrame:
    """Candidates of ``k`` words, with their lowest-scoring cut, that no longer one holds."""
    if longer is not None:
        inside = longer.select(F.col("left").alias("id"), "f").union(longer.select(F.col("right").alias("id"), "f")).groupBy("id").agg(F.max("f").alias("_f"))
        level = level.join(inside, "id", "left").where(F.col("_f").isNull() | (100 * F.col("_f").cast("decimal(38,0)") < contained * F.col("f").cast("decimal(38,0)"))).drop("_f")
    cuts = []
    for c in range(1, k):
        left, right = F.col("heads")[c - 1], F.col("tails")[k - c - 1]
        score = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * F.col("f").cast("decimal(20,0)"), left.cast("decimal(20,0)") + right.cast("decimal(20,0)"))
        cuts.append(F.struct(score.cast("long").alias("score"), F.lit(c).alias("c"), left.alias("l"), right.alias("r")))
    return level.withColumn("_b", F.array_min(F.array(*cuts))).select("lang", "phrase", F.col("f").alias("a"), "_b.l", "_b.r", "_b.score")


def _first(candidates: DataFrame, top: int) -> DataFrame:
    """Each language's first ``top`` with their ``rank``; shares of a language give theirs first, so that no task orders a whole language."""
    from pyspark.sql import Window

    order = (F.desc("score"), F.desc("a"), "phrase")
    shared = candidates.withColumn("_s", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    few = shared.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_s").orderBy(*order))).where(F.col("rank") <= top).drop("_s", "rank")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def collocations(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = MIN_COUNT, top: int = TOP, contained: int = CONTAINED, block: int = BLOCK) -> DataFrame:
    """Each language's ``top`` phrases of 2 to 4 words: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score``.

    Words are cut at blanks and tabs, pieces at marks and line breaks, A-Z are lower-cased; no phrase goes beyond a piece.  ``a``, ``l``
    and ``r`` count all occurrences of the phrase (``least`` or more) and of both sides of its lowest-scoring cut, ``n`` all
    words of the language.  A phrase is left out if a longer one with at least ``contained`` percent of its occurrences holds it.  A null
    text has no words; a null language is ``und``.  Rows that repeat count as often as they are there.  An empty table, and a language
    without candidates, gives no rows; extra columns are ignored.  Texts are read whole, long ones in parts that end at marks.
    """
    level: _Level = _Words(docs, text_col, lang_col, block)
    names = level.counted(least)
    own = F.array("f")
    total, names = names.where("word = ''").select("lang", F.col("f").alias("n")), names.where("word <> ''")
    levels = [names.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "f", own.alias("heads"), own.alias("tails"))]
    for _ in range(2, LONGEST + 1):
        level = _Pairs(level.named(names))
        names = level.counted(least)
        levels.append(saved(_inherited(names, levels[-1], names.count()), "phrases"))
    found = None
    for k in range(2, LONGEST + 1):
        part = _scored(levels[k - 1], k, levels[k] if k < LONGEST else None, contained)
        found = part if found is None else found.unionByName(part)
    return _first(found, top).join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _oracle(least: int = MIN_COUNT, top: int = TOP, contained: int = CONTAINED) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS k, w[i:i + {k - 1}] AS p FROM (SELECT lang, w, unnest(range(1, len(w) - {k - 2})) AS i FROM words)" for k in range(1, LONGEST + 1))
    return f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
counted AS MATERIALIZED (SELECT lang, k, p, count(*) AS f FROM ({grams}) GROUP BY ALL HAVING k = 1 OR count(*) >= {least}),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang),
parts AS (SELECT lang, k, p, f, unnest(range(1, k)) AS c FROM counted WHERE k > 1),
cuts AS (SELECT q.lang, q.k, q.p, q.f AS a, q.c, x.f AS l, y.f AS r, ((2000000::HUGEINT * q.f) // (x.f + y.f))::BIGINT AS score
 FROM parts q JOIN counted x ON x.lang = q.lang AND x.p = q.p[1:q.c] JOIN counted y ON y.lang = q.lang AND y.p = q.p[q.c + 1:q.k]),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, c) = 1),
inner_ AS (SELECT lang, f, p[s:s + m - 1] AS p FROM (SELECT lang, k, p, f, m, unnest(range(1, k - m + 2)) AS s FROM (SELECT lang, k, p, f, unnest(range(2, k)) AS m FROM counted WHERE k > 2))),
held AS (SELECT lang, p, max(f) AS longer FROM inner_ GROUP BY ALL),
ranked AS (SELECT b.*, array_to_string(b.p, ' ') AS phrase FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.p = b.p WHERE h.longer IS NULL OR 100::HUGEINT * h.longer < {contained}::HUGEINT * b.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) QUALIFY rank <= {top}"""


ORACLE = _oracle()
