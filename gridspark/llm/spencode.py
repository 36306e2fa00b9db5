"""SentencePiece encoding and decoding for merge-type vocabularies.

The merges are done here, by an agenda of adjacent symbol pairs ordered by score and then by place: the best
pair whose concatenation is a piece is joined, until none is left.  Symbols that are no piece fall back to bytes.
No piece holds a space mark after another character, so a text falls apart into chunks that merge on their own; each
chunk is encoded once while it stays in a bounded cache, and every chunk that is encoded is checked, an Arrow
batch's worth at a time, against the sentencepiece library: its ids by ``encode``, what they decode to by ``decode``.

Nulls count as empty; a text is encoded whole, however long; columns other than the two that are read are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import batched, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gridspark.llm._text import slices
from gridspark.llm._worker import kept

MARK = "▁"
#: Characters of chunks and of their ids kept in each of the cache's two generations; some 60,000 chunks, with what Python adds 20 MB.
CACHE = 1_500_000
#: Chunks of more characters use a heap; others merge side by side, so many at once.
LONG = 64
ROWS = 16_384
#: Bytes of text that are encoded together; their chunks, held apart, take some ten times as much.
GROUP = 1 << 20
#: Chunks that the library checks as one text.
TOGETHER = 64
_NONE = np.int32(2**31 - 1)


class Vocabulary:
    """Pieces and scores read through the library; the encoder and the decoder work on them alone."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, int] = {}
        scores: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        self.text: list[bytes] = []  # what each id decodes to
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:-1], 16)] = i
                self.text.append(bytes([int(piece[3:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.text.append(b" \xe2\x81\x87 " if sp.is_unknown(i) else b"")
            else:
                self.pieces[piece] = i
                scores[piece] = sp.get_score(i)
                self.text.append(piece.replace(MARK, " ").encode())
        order = {s: i for i, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in scores.items()}  # 0 is the best score
        self._tables()
        self.unknown, self.end = sp.unk_id(), sp.eos_id()
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece joins words; chunks would not merge on their own")
        # Characters that are in no longer piece end a chunk as well.
        joined = set("".join(p for p in self.pieces if len(p) > 1))
        self.splits = "".join(c for c in "\n\t\r" if c not in joined)
        apart = re.escape(self.splits)
        self.chunks = re.compile(f" +[^ {apart}]*|[{apart}]|[^ {apart}]+" if apart else " +[^ ]*|[^ ]+")
        if sp.normalize("a  b\tc\n ﬁ") != MARK + "a  b\tc\n ﬁ".replace(" ", MARK):
            raise ValueError("the model rewrites texts before it encodes them")

    def split(self, text: str) -> list[str]:
        """The chunks of a text with the leading space that the model adds; none of an empty text."""
        if not text:
            return []
        text = " " + text.replace(MARK, " ")
        if "  " in text or "\0" in text or any(c in text for c in self.splits if c != "\n"):
            return self.chunks.findall(text)
        # The same without the pattern: chunks begin at spaces, and at and after line breaks.
        text = text.replace(" ", "\0 ")
        return list(filter(None, (text.replace("\n", "\0\n\0") if "\n" in self.splits else text).split("\0")))

    def merge(self, chunk: str) -> list[int]:
        """The ids of one chunk: joins the agenda's best pair, the leftmost among equals, until no pair is a piece."""
        symbols = list(chunk.replace(" ", MARK))
        out: list[int] = []
        for s in self._merge_heap(symbols):
            if (found := self.pieces.get(s)) is not None:
                out.append(found)
            elif self.bytes:
                out += [self.bytes[b] for b in s.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def _tables(self) -> None:
        """Symbols (pieces and the characters in them) as numbers; the pairs of symbols that make a piece, sorted."""
        names = sorted(self.pieces.keys() | set("".join(self.pieces)))
        number = {s: i for i, s in enumerate(names)}
        self.symbols = names
        self.char = np.full(0x110000, -1, np.int32)
        for s in names:
            if len(s) == 1:
                self.char[ord(s)] = number[s]
        self.char[ord(" ")] = number.get(MARK, -1)
        pairs = {}
        for piece, rank in self.rank.items():
            for k in range(1, len(piece)):
                if piece[:k] in number and piece[k:] in number:
                    pairs[number[piece[:k]] * len(names) + number[piece[k:]]] = rank, number[piece]
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k][0] for k in self.pair_keys.tolist()], np.int32)
        self.pair_made = np.array([pairs[k][1] for k in self.pair_keys.tolist()], np.int32)
        ids = [self._fallback(s) for s in names]
        self.n_ids = np.fromiter(map(len, ids), np.int64, len(ids))
        self.ids_at, self.ids = np.cumsum(self.n_ids) - self.n_ids, np.fromiter(chain.from_iterable(ids), np.int32)

    def _fallback(self, symbol: str) -> list[int]:
        if (found := self.pieces.get(symbol)) is not None:
            return [found]
        return [self.bytes[b] for b in symbol.encode()] if self.bytes else [self.unknown]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the piece that two symbols make; _NONE if they make none."""
        key = left.astype(np.int64) * len(self.symbols) + right
        key[(left < 0) | (right < 0)] = -1
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], _NONE)

    def merge_all(self, chunks: list[str]) -> list[list[int]]:
        """The ids of many chunks.

        Short ones whose characters are all symbols merge side by side: in each round every chunk joins the best pair
        of its own agenda, one row of ranks.
        """
        out: list[list[int] | None] = [None] * len(chunks)
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        if len(self.pair_keys):
            low = 0
            for high in (4, 8, 12, 16, 24, 40, LONG):
                at = np.flatnonzero((lengths > low) & (lengths <= high))
                low = high
                for k in range(0, len(at), ROWS):
                    self._merge_rows(chunks, lengths, at[k : k + ROWS], high, out)
        return [self.merge(c) if ids is None else ids for c, ids in zip(chunks, out, strict=True)]

    def _merge_rows(self, chunks: list[str], lengths: np.ndarray, at: np.ndarray, width: int, out: list) -> None:
        points = np.frombuffer("".join([chunks[i].ljust(width, "\0") for i in at]).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.char[points].reshape(len(at), width)
        symbols[np.arange(width) >= lengths[at][:, None]] = -2
        known = ~(symbols == -1).any(1)  # other chunks hold characters that no piece has, and are merged one by one
        at, symbols = at[known], symbols[known]
        if not len(at):
            return
        symbols = np.concatenate((symbols, np.full((len(at), 1), -2, np.int32)), 1)
        ranks = self._ranks(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(len(at), width)
        column = np.arange(width + 1)
        while len(at):
            place = ranks.argmin(1)
            row = np.arange(len(at))
            best = ranks[row, place]
            done = best == _NONE
            if done.any():
                own = symbols[done]
                inside = own >= 0
                flat = own[inside]
                sizes = self.n_ids[flat]
                ends = np.cumsum(sizes)
                ids = self.ids[np.repeat(self.ids_at[flat] - (ends - sizes), sizes) + np.arange(ends[-1])].tolist()
                ends = ends[np.cumsum(inside.sum(1)) - 1].tolist()
                for i, a, b in zip(at[done].tolist(), [0, *ends[:-1]], ends, strict=True):
                    out[i] = ids[a:b]
                left = ~done
                at, symbols, ranks, place = at[left], symbols[left], ranks[left], place[left]
                row = np.arange(len(at))
            behind = column[None, 1:] > place[:, None]
            made = self.pair_made[np.searchsorted(self.pair_keys, symbols[row, place].astype(np.int64) * len(self.symbols) + symbols[row, place + 1])]
            symbols[:, :-1] = np.where(np.concatenate((np.zeros((len(at), 1), bool), behind[:, :-1]), 1), symbols[:, 1:], symbols[:, :-1])
            symbols[:, -1] = -2
            ranks[:, :-1] = np.where(behind[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = _NONE
            symbols[row, place] = made
            ranks[row, place] = self._ranks(symbols[row, place], symbols[row, place + 1])
            some = np.flatnonzero(place > 0)
            before = place[some] - 1
            ranks[some, before] = self._ranks(symbols[some, before], symbols[some, before + 1])

    def _merge_heap(self, start: list[str]) -> list[str]:
        """The agenda as a heap of (rank, place, pair), whose stale entries are passed over."""
        symbols: list[str | None] = list(start)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank
        agenda = [(rank[p], i, p) for i in range(n - 1) if (p := start[i] + start[i + 1]) in rank]
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] is None or j >= n or symbols[i] + symbols[j] != pair:
                continue
            symbols[i], symbols[j] = pair, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (new := pair + symbols[k]) in rank:
                    heapq.heappush(agenda, (rank[new], i, new))
            if (h := before[i]) >= 0 and (new := symbols[h] + pair) in rank:
                heapq.heappush(agenda, (rank[new], h, new))
        return [s for s in symbols if s is not None]

    def decoded(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.text.__getitem__, ids))

    def checked(self, chunks: dict[str, list[int]]) -> None:
        """Raises unless the library agrees on every chunk, both ways.

        A line break that ends chunks keeps them apart, so that many are encoded and decoded as one text; where a text differs, its chunks are looked at one by one.
        """
        if "\n" not in self.splits:
            return self._checked_apart(chunks)
        start = self.library.encode("\n")
        for some in batched(chunks.items(), TOGETHER):
            ids = [start[0], *chain.from_iterable(start[1:] + own for _, own in some)]
            theirs = self.library.encode("".join(["\n" + c for c, _ in some]))
            if theirs != ids or self.library.decode(theirs) != self.finish(self.decoded(ids)):
                self._checked_apart(dict(some))

    def _checked_apart(self, chunks: dict[str, list[int]]) -> None:
        """The same for one chunk at a time; a line break before it keeps it from being a text's start."""
        theirs = self.library.encode(["\n" + c for c in chunks], num_threads=1)
        for (chunk, own), ids in zip(chunks.items(), theirs, strict=True):
            if own != ids[2:]:
                raise ValueError(f"the library encodes {chunk!r} as {ids[2:]}, not {own}")
        for (chunk, own), text in zip(chunks.items(), self.library.decode(theirs, num_threads=1), strict=True):
            if text != "\n" + self.decoded(own).decode("utf-8", "replace"):
                raise ValueError(f"the library decodes {own} as {text[1:]!r}")

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids, as the library gives it: the first space mark, which encoding added, goes."""
        return self.finish(self.decoded(ids))

    @staticmethod
    def finish(raw: bytes) -> str:
        out = raw.decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


class Encoder:
    """Encodes texts chunk by chunk with a cache of bounded size: chunk -> its ids as text; ``odd`` holds what those chunks decode to that do not decode to themselves."""

    def __init__(self, path: str, check: bool = True):
        self.vocabulary = Vocabulary(path)
        self.check = check
        self.new: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.odd: dict[str, bytes] = {}
        self.held = 0
        self.names = [str(i) for i in range(len(self.vocabulary.text))]

    def learn(self, texts: list[list[str]]) -> dict[str, str]:
        """All chunks of ``texts``; the older of the cache's two generations goes when the newer is full.  Chunks over ``LONG`` are not kept."""
        if self.held > CACHE:
            self.old, self.new, self.held = self.new, {}, 0
            self.odd = {c: raw for c, raw in self.odd.items() if c in self.old}
        cache, v, name = self.new, self.vocabulary, self.names.__getitem__
        missing = set().union(*texts) - cache.keys()
        for chunk in missing & self.old.keys():
            cache[chunk] = entry = self.old[chunk]
            self.held += len(chunk) + len(entry)
        missing, long = list(missing - cache.keys()), {}
        gc.disable()  # so many new lists and no cycle among them
        try:
            found = v.merge_all(missing)
            if self.check and missing:
                v.checked(dict(zip(missing, found, strict=True)))
            for chunk, ids in zip(missing, found, strict=True):
                entry = " ".join(map(name, ids))
                (cache if len(chunk) <= LONG else long)[chunk] = entry
                self.held += len(chunk) + len(entry)
                if (raw := v.decoded(ids)) != chunk.encode():
                    self.odd[chunk] = raw
        finally:
            gc.enable()
        return cache | long if long else cache

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text with the end id; null counts as empty."""
        end = str(self.vocabulary.end)
        split = [self.vocabulary.split(t or "") for t in texts]
        cache = self.learn(split)
        for chunks in split:
            yield np.array(" ".join([*map(cache.__getitem__, chunks), end]).split(" "), np.int32)

    def digests(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, SHA-256 of the ids as text, SHA-256 of the decoded text) of each text."""
        end = str(self.vocabulary.end)
        split = [self.vocabulary.split(t or "") for t in texts]
        cache = self.learn(split)
        for chunks in split:
            joined = " ".join([*map(cache.__getitem__, chunks), end])
            if self.odd.keys().isdisjoint(chunks):
                decoded = "".join(chunks).encode()
            else:
                decoded = b"".join([self.odd[c] if c in self.odd else c.encode() for c in chunks])
            yield joined.count(" ") + 1, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(self.vocabulary.finish(decoded).encode()).hexdigest()


def encoder(path: str, check: bool = True) -> Encoder:
    """The worker's encoder for a model; it outlives a task."""
    return kept(("sentencepiece", path, check), lambda: Encoder(path, check))


def encode_documents(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``ids`` (with the end id) of every row; a null or empty text has the end id alone.

    ``model_path`` is a file that every executor has.  A very long text is encoded whole.  Rows with equal or null ids give a row each; an empty table
    none.  Extra columns are ignored.
    """
    rows = docs.select(id_col, text_col).toDF("_id", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model_path)
        for batch in batches:
            for part in slices(batch, 1, GROUP):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(e.encode(part.column(1).to_pylist())), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['_id'].dataType.simpleString()}, ids array<int>")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id`` and ``text`` of rows of ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = encoder(model_path).vocabulary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else v.decode(x) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digest_documents(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every row in one pass: ``doc_id``, ``n_tokens`` (all ids), ``ids_sha256`` and ``decoded_sha256``.

    A null or empty text has the end id alone and decodes to nothing; a very long one is encoded whole.  Rows with equal or null ids give a row each;
    an empty table none.  Extra columns are ignored.
    """
    rows = docs.select(id_col, text_col).toDF("_id", "_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(model_path)
        for batch in batches:
            for part in slices(batch, 1, GROUP):
                got = list(e.digests(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got]), pa.array([g[2] for g in got])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
