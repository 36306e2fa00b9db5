"""Benchmark decontamination with an FM-index over each training shard.

A shard is one block of documents.  Its words are reduced to a sequence over the benchmark's vocabulary:
a word that no benchmark item has can be in no occurrence, so runs of known words shorter than the shortest
window are left out and all else becomes a separator.  The Burrows-Wheeler transform of the sequence is kept
in a wavelet tree; every test window is found by backward search over its ranks, and its occurrences are
located by walking back to sampled suffix positions.  Occurrences mark words, and marked runs merge into
removal spans.  Documents are never shuffled.

The benchmark is sent to the tasks in parts of some ``PART_CHARS`` characters.  A larger benchmark takes one pass over the
documents for each part: a pass adds its hits to those of the passes before it, read from the shared folder, so that
neither the driver nor a task ever holds more than one part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridspark.llm._shared import saved
from gridspark.llm._text import ALNUM_WORDS, Words, blocks, encoded
from gridspark.llm._worker import tidy

WINDOW = 10
PART_CHARS = 8_000_000  # a window of ten words takes 40 bytes; some 60 MB in all
SHARD = 1 << 20
SAMPLE_RATE = 8
_RANK_BLOCK = 64


class Patterns:
    """The distinct windows of benchmark items as rows of vocabulary numbers, by length."""

    def __init__(self, items: list[tuple[str, str]]):
        self.names, texts = [i for i, _ in items], [(t or "").encode() for _, t in items]
        words = Words(texts, ALNUM_WORDS, True)
        self.vocabulary = np.unique(words.hash)
        code = (np.searchsorted(self.vocabulary, words.hash) + 1).astype(np.int32)
        first = np.asarray(words.first, np.int64)
        size = np.diff(first)
        length = np.minimum(size, WINDOW)
        count = np.where(size > 0, size - length + 1, 0)
        item = np.repeat(np.arange(len(items)), count)
        at = first[item] + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        self.n_windows = 0
        self.by_length: dict[int, tuple[int, np.ndarray]] = {}
        owners = [np.empty((0, 2), np.int64)]
        for n in np.unique(length[item]).tolist():
            own = length[item] == n
            rows, window = np.unique(code[at[own][:, None] + np.arange(n)], axis=0, return_inverse=True)
            owners.append(np.column_stack((self.n_windows + window.reshape(-1), item[own])))
            self.by_length[n] = self.n_windows, rows
            self.n_windows += len(rows)
        pairs = np.unique(np.concatenate(owners), axis=0)
        self.owner = pairs[:, 1]
        self.owned = np.searchsorted(pairs[:, 0], np.arange(self.n_windows + 1))
        self.shortest = min(self.by_length, default=0)
        self.filter = np.zeros(1 << 16, bool)
        self.filter[(self.vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True

    def items(self, window: int) -> list[str]:
        """The items that have a window."""
        return [self.names[i] for i in self.owner[self.owned[window] : self.owned[window + 1]]]

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary number of each word, 0 for words that the benchmark lacks."""
        out = np.zeros(len(hashes), np.int64)
        if not len(self.vocabulary):
            return out
        maybe = np.flatnonzero(self.filter[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), len(self.vocabulary) - 1)
        same = self.vocabulary[at] == hashes[maybe]
        out[maybe[same]] = at[same] + 1
        return out


class WaveletTree:
    """Ranks of symbols in a sequence, level by level from the highest bit; zeros go left."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.bits, self.n = bits, len(sequence)
        self.levels = []
        rest = sequence
        for b in range(bits - 1, -1, -1):
            one = (rest >> b) & 1
            ranks = np.concatenate(([0], np.cumsum(one)))
            self.levels.append((b, np.append(one, 0).astype(np.uint8), ranks[::_RANK_BLOCK], self._words(one), self.n - int(ranks[-1])))
            rest = rest[np.argsort(one, kind="stable")]

    @staticmethod
    def _words(bits: np.ndarray) -> np.ndarray:
        """64 bits to a word, first bit lowest."""
        packed = np.packbits(bits.astype(np.uint8), bitorder="little")
        return np.frombuffer(packed.tobytes() + b"\0" * (8 - len(packed) % 8), np.uint64)

    @staticmethod
    def _ones(ranks: np.ndarray, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        block, rest = at // _RANK_BLOCK, (at % _RANK_BLOCK).astype(np.uint64)
        return ranks[block] + np.bitwise_count(words[block] & ((np.uint64(1) << rest) - np.uint64(1))).astype(np.int64)

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` is among the first ``at``."""
        low, high = np.zeros_like(at), at.copy()
        for b, _, ranks, words, zeros in self.levels:
            one = ((symbol >> b) & 1).astype(bool)
            l1, h1 = self._ones(ranks, words, low), self._ones(ranks, words, high)
            low, high = np.where(one, zeros + l1, low - l1), np.where(one, zeros + h1, high - h1)
        return high - low

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and its rank there."""
        symbol, low, here = np.zeros_like(at), np.zeros_like(at), at.copy()
        for b, bit, ranks, words, zeros in self.levels:
            one = bit[here].astype(bool)
            l1, h1 = self._ones(ranks, words, low), self._ones(ranks, words, here)
            low, here = np.where(one, zeros + l1, low - l1), np.where(one, zeros + h1, here - h1)
            symbol |= one.astype(np.int64) << b
        return symbol, here - low


class FMIndex:
    """Finds rows of symbols in ``sequence``, whose symbols are 0 (separator) to ``top``."""

    def __init__(self, sequence: np.ndarray, top: int):
        text = np.append(sequence + 1, 0)  # 0 ends the text and is the smallest
        self.suffixes = _suffix_array(text)
        bwt = text[self.suffixes - 1]
        self.tree = WaveletTree(bwt, max(1, int(top + 1).bit_length()))
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 2))))
        keep = self.suffixes % SAMPLE_RATE == 0
        self.marked, self.rank = keep, np.cumsum(keep) - 1
        self.samples = self.suffixes[keep]
        del self.suffixes

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each row."""
        n = len(patterns)
        low, high = np.zeros(n, np.int64), np.full(n, self.tree.n, np.int64)
        live = np.arange(n)
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k].astype(np.int64) + 1
            low[live] = self.before[c] + self.tree.rank(c, low[live])
            high[live] = self.before[c] + self.tree.rank(c, high[live])
            live = live[high[live] > low[live]]
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of suffixes."""
        out, steps, here, left = np.zeros(len(rows), np.int64), 0, rows.copy(), np.arange(len(rows))
        while len(left):
            done = self.marked[here]
            out[left[done]] = self.samples[self.rank[here[done]]] + steps
            left, here = left[~done], here[~done]
            if len(left):
                symbol, rank = self.tree.access(here)
                here = self.before[symbol] + rank
                steps += 1
        return out


def _suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling; stops as soon as all suffixes differ."""
    n = len(text)
    rank = text.astype(np.int64)
    step = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + int(text.max(initial=0)) + 2) + second
        order = np.argsort(key, kind="stable")
        change = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = change
        if n == 0 or change[-1] == n - 1 or step >= n:
            return order
        step *= 2


def hits(words: Words, patterns: Patterns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words are inside an occurrence, and (text, window) of all occurrences."""
    hit = np.zeros(len(words), bool)
    none = np.empty(0, np.int64)
    if not len(words) or not patterns.n_windows:
        return hit, none, none
    code = patterns.codes(words.hash)
    # Runs of known words inside one text.
    known = code > 0
    new = np.concatenate(([True], (words.doc[1:] != words.doc[:-1]) | (known[1:] != known[:-1])))
    run = np.cumsum(new) - 1
    size = np.bincount(run)
    keep = np.flatnonzero(known & (size[run] >= patterns.shortest))
    if not len(keep):
        return hit, none, none
    gap = np.concatenate(([True], run[keep][1:] != run[keep][:-1]))
    place = np.arange(len(keep)) + np.cumsum(gap)  # a separator before each run
    sequence = np.zeros(place[-1] + 1, np.int64)
    sequence[place] = code[keep]
    origin = np.full(len(sequence), -1, np.int64)
    origin[place] = keep
    index = FMIndex(sequence, len(patterns.vocabulary))
    cover = np.zeros(len(words) + 1, np.int64)
    docs, windows = [], []
    for n, (number, rows) in patterns.by_length.items():
        low, high = index.search(rows)
        found = np.flatnonzero(high > low)
        count = (high - low)[found]
        if not len(found):
            continue
        suffix = np.repeat(low[found] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        at = origin[index.locate(suffix)]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + n, -1)
        docs.append(words.doc[at])
        windows.append(np.repeat(number + found, count))
    if not docs:
        return hit, none, none
    return np.cumsum(cover)[:-1] > 0, np.concatenate(docs), np.concatenate(windows)


def _parts(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Patterns]:
    """The benchmark in bounded parts, each made when its pass begins; equal rows count once."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t")).where("i is not null and t is not null").distinct()
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    n = -(-total // PART_CHARS)
    for k in range(max(1, n)):
        own = rows if n <= 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield Patterns([(r["i"], r["t"]) for r in own.collect()])


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and end of every run of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).astype(np.int8)))
    return list(zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True))


_FOUND = "struct<n_words: long, n_hit: long, items: array<string>, spans: array<struct<start: long, end: long>>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _searched(rows: DataFrame, part: Broadcast, text_col: str, found_col: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``rows`` and ``found_col``: what an earlier pass found, if there was one, and what ``part`` adds."""
    names, earlier = rows.columns, found_col in rows.columns
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"`{found_col}` {_FOUND}"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, held in blocks(encoded(batch.column(names.index(text_col))), SHARD):
                some = batch.slice(first, len(held))
                words = Words(held, ALNUM_WORDS, True)
                hit, doc, window = hits(words, part.value)
                items: list[set[str]] = [set() for _ in held]
                for d, w in {*zip(doc.tolist(), window.tolist(), strict=True)}:
                    items[d].update(part.value.items(w))
                for d, old in enumerate(some.column(names.index(found_col)).to_pylist() if earlier else []):
                    items[d].update(old["items"])
                    for span in old["spans"]:  # all words from a span's first to its last are hit
                        a, b = np.searchsorted(words.starts, [words.at[d] + span["start"], words.at[d] + span["end"]])
                        hit[a:b] = True
                spans = [[] for _ in held]
                for a, b in _runs(hit):
                    while a < b:  # a run may go on in the next text
                        d = int(words.doc[a])
                        end = min(b, int(words.first[d + 1]))
                        spans[d].append({"start": int(words.starts[a] - words.at[d]), "end": int(words.ends[end - 1] - words.at[d])})
                        a = end
                found = pa.StructArray.from_arrays(
                    [pa.array(words.counts.astype(np.int64)), pa.array(np.bincount(words.doc[hit], minlength=len(held)).astype(np.int64)), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(spans, _SPANS)],
                    ["n_words", "n_hit", "items", "spans"],
                )
                yield pa.RecordBatch.from_arrays([*(some.column(names.index(c)) for c in keep), found], [*keep, found_col])

    return rows.mapInArrow(tidy(run), schema)


def _passes(rows: DataFrame, parts: Iterator[Patterns], text_col: str, found_col: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``found_col`` after one pass for each part; all but the last are written to the shared folder."""
    context = rows.sparkSession.sparkContext
    part = next(parts)
    for following in parts:
        sent = context.broadcast(part)
        rows = saved(_searched(rows, sent, text_col, found_col, [c for c in rows.columns if c != found_col]), "decontamination-pass")
        sent.destroy()
        part = following
    return _searched(rows, context.broadcast(part), text_col, found_col, keep)


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_words``, ``n_hit``, ``items`` (sorted strings) and ``spans``.

    A span is {start, end} in bytes of the UTF-8 text, from the first to the last word of a merged run of hit words.
    A null or empty text has no words; rows of the benchmark with a null id or a null text are no items, so their windows hit nothing; an item with fewer than ten words is one window;
    an empty benchmark hits nothing; equal rows give equal results each.  A very long text is one block of its own, never cut.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    return _passes(rows, _parts(benchmark, item_col, item_text_col), "_text", "_found", ["_id"]).select(F.col("_id").alias("doc_id"), "_found.*")


def cut(text: bytes, patterns: Patterns) -> bytes:
    """``text`` without any occurrence; cutting goes on until none is left across a cut either."""
    while True:
        words = Words([text], ALNUM_WORDS, True)
        hit = hits(words, patterns)[0]
        if not hit.any():
            return text
        pieces, last = [], 0
        for a, b in _runs(hit):
            pieces.append(text[last : words.starts[a]])
            last = words.ends[b - 1]
        text = b"".join([*pieces, text[last:]])


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """All rows of ``docs`` with the removal spans cut out of their texts and ``chars_col``, if there, counted anew.

    Spans of all items are cut together, and cutting goes on until no window is left across a cut either, with one part as with several.
    A document that is nothing but benchmark text (no word is left) goes; others stay, null and empty texts too.  Repeated rows are cut alike and all stay, extra
    columns of any name as they are, an empty table gives no rows, and a very long text is cut whole.
    """
    parts = _parts(benchmark, item_col, item_text_col)
    part, following = next(parts), next(parts, None)
    if following is not None:
        return _cut_in_turns(docs, benchmark, chain([part, following], parts), text_col, chars_col, item_col, item_text_col)
    sent = docs.sparkSession.sparkContext.broadcast(part)
    at, chars = docs.columns.index(text_col), docs.columns.index(chars_col) if chars_col in docs.columns else None
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = encoded(batch.column(at))
            for first, held in blocks(texts, SHARD):
                words = Words(held, ALNUM_WORDS, True)
                dirty = set(hits(words, sent.value)[1].tolist())
                some = batch.slice(first, len(held))
                if not dirty:
                    yield some
                    continue
                new = {d: cut(held[d], sent.value) for d in dirty}
                gone = {d for d, t in new.items() if not len(Words([t], ALNUM_WORDS, True))}
                old = some.column(at).to_pylist()
                columns = list(some.columns)
                columns[at] = pa.array([new[d].decode() if d in new else t for d, t in enumerate(old)], some.schema.field(at).type)
                if chars is not None:
                    counts = some.column(chars).to_pylist()
                    columns[chars] = pa.array([len(new[d].decode()) if d in new else c for d, c in enumerate(counts)], some.schema.field(chars).type)
                yield pa.RecordBatch.from_arrays(columns, schema=some.schema).filter(pa.array([d not in gone for d in range(len(held))]))

    return docs.mapInArrow(tidy(run), schema)


def _without_spans(text: Column, spans: Column) -> Column:
    """``text`` without ``spans``, whose bounds are bytes."""
    held = F.encode(text, "UTF-8")

    def piece(i: Column) -> Column:
        start = F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"]).cast("int")
        end = F.when(i == F.size(spans), F.octet_length(text)).otherwise(F.get(spans, i)["start"]).cast("int")
        return F.decode(F.substring(held, start + 1, end - start), "UTF-8")

    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(spans)), piece), "")


def _cut_in_turns(docs: DataFrame, benchmark: DataFrame, parts: Iterator[Patterns], text_col: str, chars_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """:func:`decontaminated` for a benchmark of several parts: all their spans first, then the cut; what was cut is searched again."""
    found_col = "_found"
    while found_col in docs.columns:
        found_col = f"_{found_col}"
    spans, todo, done = F.col(f"`{found_col}`.spans"), docs, []
    while True:
        found = saved(_passes(todo, parts, text_col, found_col, docs.columns), "decontamination-round")
        done.append(found.where(F.size(spans) == 0).select(*docs.columns))
        if found.where(F.size(spans) > 0).isEmpty():
            break
        text = F.col(f"`{text_col}`")
        shorter = found.where(F.size(spans) > 0).withColumn(text_col, _without_spans(text, spans)).where(text.rlike("[0-9A-Za-z\\x{80}-\\x{10FFFF}]"))
        if chars_col in docs.columns:
            shorter = shorter.withColumn(chars_col, F.length(text).cast(docs.schema[chars_col].dataType))
        todo, parts = saved(shorter.select(*docs.columns), "decontamination-cut"), _parts(benchmark, item_col, item_text_col)
    return reduce(DataFrame.unionByName, done)
