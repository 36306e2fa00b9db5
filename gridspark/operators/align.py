"""Rows of two versions of a sheet aligned: longest common blocks first, as ``difflib`` finds them, then the gaps by similarity.

Equal rows in a row are one run, so a million blank rows cost what one does.  Where runs of equal rows meet too often, the longest
block is found with a suffix automaton instead, in a time that is linear in the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Pairs of equal runs that are looked at one by one.
MOST_PAIRS = 1_000_000
# Fixed values of pairing.
MAX_REGION = 10_000
EMPTY_PAIR, LEAST_PAIR = 0.05, 0.01

Block = tuple[int, int, int]


def _runs(rows: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """(value, start, length) of runs of equal rows."""
    first = np.flatnonzero(np.diff(rows, prepend=rows[0] - 1)) if len(rows) else np.empty(0, np.int64)
    return rows[first].tolist(), first.tolist(), np.diff(np.append(first, len(rows))).tolist()


def _by_runs(a: tuple, b: tuple, places: dict[int, list[int]]) -> Block:
    """The longest common block, the earliest in ``a``, then in ``b``: from the end on, each pair of equal runs goes on with the pair after it if they are of equal length."""
    best = (0, 0, 0)  # (length, -start in a, -start in b)
    after: dict[int, int] = {}
    for value, start, size in zip(*(x[::-1] for x in a), strict=True):
        now: dict[int, int] = {}
        for q in places.get(value, ()):
            other = b[2][q]
            shared = size if size < other else other
            more = after.get(q + 1, 0)
            now[q] = shared + more if size == other else shared
            if shared + more >= best[0]:
                # What goes on must end with both runs; what does not starts with them.
                found = (shared + more, shared - size - start, shared - other - b[1][q]) if more else (shared, -start, -b[1][q])
                if found > best:
                    best = found
        after = now
    return -best[1], -best[2], best[0]


def _by_automaton(a: list[int], b: list[int]) -> Block:
    """The same by the suffix automaton of ``b``."""
    edges: list[dict[int, int]] = [{}]
    link, length, ends = [-1], [0], [-1]
    last = 0
    for j, x in enumerate(b):
        new = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        ends.append(j)
        link.append(0)
        p = last
        while p >= 0 and x not in edges[p]:
            edges[p][x] = new
            p = link[p]
        if p >= 0:
            q = edges[p][x]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                ends.append(ends[q])
                link.append(link[q])
                while p >= 0 and edges[p].get(x) == q:
                    edges[p][x] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    state = size = 0
    best = (0, 0, 0)
    for i, x in enumerate(a):
        while state and x not in edges[state]:
            state = link[state]
            size = length[state]
        if x in edges[state]:
            state, size = edges[state][x], size + 1
            if size > best[2]:
                best = i + 1 - size, ends[state] + 1 - size, size
    return best


def _longest(a: np.ndarray, b: np.ndarray) -> Block:
    if len(a) == len(b) and (a == b).all():
        return 0, 0, len(a)
    left, right = _runs(a), _runs(b)
    places: dict[int, list[int]] = {}
    for q, value in enumerate(right[0]):
        places.setdefault(value, []).append(q)
    if sum(len(places.get(v, ())) for v in left[0]) <= MOST_PAIRS:
        return _by_runs(left, right, places)
    return _by_automaton(a.tolist(), b.tolist())


def blocks(a: np.ndarray, b: np.ndarray) -> list[Block]:
    """Common blocks (start in ``a``, start in ``b``, length) in order: the longest, then the same before and after it."""
    out, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        i1, i2, j1, j2 = open_.pop()
        if i1 == i2 or j1 == j2:
            continue
        i, j, n = _longest(a[i1:i2], b[j1:j2])
        if n:
            out.append((i1 + i, j1 + j, n))
            open_ += [(i1, i1 + i, j1, j1 + j), (i1 + i + n, i2, j1 + j + n, j2)]
    return sorted(out)


def similarities(old: Sequence[dict[int, int]], new: Sequence[dict[int, int]]) -> np.ndarray:
    """The share of equal cells among the columns that either row has, for each pair of rows."""
    columns = {c: k for k, c in enumerate(sorted({c for row in (*old, *new) for c in row}))}
    sides = []
    for rows in (old, new):
        there, value = np.zeros((len(rows), len(columns)), bool), np.zeros((len(rows), len(columns)), np.int64)
        for k, row in enumerate(rows):
            at = [columns[c] for c in row]
            there[k, at], value[k, at] = True, list(row.values())
        sides.append((there, value))
    (p, x), (q, y) = sides
    equal, both = np.zeros((len(old), len(new)), np.int64), np.zeros((len(old), len(new)), np.int64)
    for k in range(len(columns)):
        together = p[:, k, None] & q[None, :, k]
        both += together
        equal += together & (x[:, k, None] == y[None, :, k])
    filled = p.sum(1)[:, None], q.sum(1)[None, :]
    either = filled[0] + filled[1] - both
    share = np.maximum(equal / np.maximum(either, 1), LEAST_PAIR)
    blank = filled[0] == 0, filled[1] == 0
    return np.where(blank[0] & blank[1], 1.0, np.where(blank[0] | blank[1], EMPTY_PAIR, share))


_PAIR, _REMOVE, _INSERT = range(3)


def paired(score: np.ndarray) -> Iterator[tuple[int | None, int | None]]:
    """The monotone pairing with the greatest total score, from its end on; of equal ones, that which pairs, then removes, at the end.

    Totals of prefixes are filled in along anti-diagonals; what was chosen at each place is kept, and followed back.
    """
    n, m = score.shape
    choice = np.full((n + 1, m + 1), _INSERT, np.int8)
    choice[1:, 0] = _REMOVE
    choice[0, 0] = _PAIR
    before, last = np.zeros(n + 1), np.zeros(n + 1)  # of the last two anti-diagonals, by row
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        options = np.stack((before[i - 1] + score[i - 1, d - i - 1], last[i - 1], last[i]))
        now = np.zeros(n + 1)
        now[i] = options.max(0)
        choice[i, d - i] = options.argmax(0)
        before, last = last, now
    i, j = n, m
    while i or j:
        step = choice[i, j]
        i, j = i - (step != _INSERT), j - (step != _REMOVE)
        yield (None if step == _INSERT else i), (None if step == _REMOVE else j)


def region(old: Sequence[dict[int, int]], new: Sequence[dict[int, int]]) -> list[tuple[int | None, int | None]]:
    """Pairs of two runs of rows that have no common block; by place where they are large."""
    n, m = len(old), len(new)
    if n * m > MAX_REGION:
        return [(i if i < n else None, i if i < m else None) for i in range(max(n, m))]
    return list(paired(similarities(old, new)))[::-1]
