"""Vectorised word scanning over UTF-8 bytes, shared by the operators that read whole texts.

Word classes that are defined by ASCII separators alone can be scanned byte by byte: every byte of
a multi-byte character is 0x80 or more and so belongs to a word.  Texts are joined into blocks of
about ``BLOCK`` bytes (a longer text is a block of its own), which bounds a task's memory by the
block and by the longest text, never by the partition.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

BLOCK = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)  # odd, hence invertible modulo 2**64
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    key = str(base)
    have = _powers.get(key)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        with np.errstate(over="ignore"):
            have = np.cumprod(steps, dtype=np.uint64)
        if size <= 4 * BLOCK:  # a single huge text must not stay in memory as powers
            _powers[key] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(texts: Iterable[bytes], limit: int = BLOCK, most: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts) with about ``limit`` bytes and at most ``most`` texts in each block."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        if held and (size + len(text) > limit or len(held) >= most):
            yield first, held
            first, held, size = i, [], 0
        held.append(text)
        size += len(text) + 1
    if held:
        yield first, held


def table(separators: Iterable[int]) -> np.ndarray:
    """Byte -> is it part of a word."""
    out = np.ones(256, bool)
    out[list(separators)] = False
    return out


#: Words are what lies between ASCII white space.
SPACE_WORDS = table([0x20, *range(0x09, 0x0E)])
#: Words are runs of digits, lower-case ASCII letters and all non-ASCII characters.
ALNUM_WORDS = table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Words:
    """The words of a block of texts.

    ``starts``/``ends`` are byte offsets in ``buf``, ``doc`` the text of each word, ``hash`` a
    64-bit hash of its bytes, ``first`` the index of each text's first word (one more at the end).
    """

    def __init__(self, texts: list[bytes], words: np.ndarray, lower: bool):
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        self.raw, self.buf = raw, LOWER[raw] if lower else raw
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.at = np.concatenate(([0], np.cumsum(lengths)))
        inside = words[self.buf]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate(([0], edge))
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.starts, self.at)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(texts)), self.counts)
        with np.errstate(over="ignore"):
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((self.buf.astype(np.uint64) + np.uint64(1)) * _power(_P, len(raw)), dtype=np.uint64)))
            self.hash = mix((sums[self.ends] - sums[self.starts]) * _power(_P_INV, len(raw) + 1)[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def __len__(self) -> int:
        return len(self.starts)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every run of ``size`` words inside one text."""
        n = len(self) - size + 1
        if n <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        out = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size):
                out = out * _P + self.hash[k : k + n]
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        return at, mix(out[at])


def encoded(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null counts as empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch, column: int, limit: int) -> Iterator:
    """An Arrow batch in parts of about ``limit`` bytes of the given text column."""
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    part = np.cumsum(sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)] if len(sizes) else [0]
    for a, b in zip(edges, edges[1:], strict=False):
        yield batch.slice(a, b - a)
