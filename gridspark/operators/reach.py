"""What can be reached in one workbook's graph, for all of its nodes in passes that are linear but for the sets themselves.

Strongly connected components come out of one depth-first search with all that they reach before them, so a component's descendants
are mostly one run of numbers.  Reached sets are kept as runs; where a graph is too tangled for that, sets are counted by bits, some
thousands of targets at a time, in a memory that does not grow with the sets.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np

#: Runs of all components together, beyond which targets are counted by bits.
MOST_RUNS = 5_000_000
#: Bytes of bits that are held at a time.
BITS_BYTES = 64 << 20


class Graph:
    """Edges from ``source`` to ``target`` among ``n`` nodes, with their strongly connected components.

    ``component`` numbers them so that edges lead to equal or lower numbers; ``first[c]`` is the lowest number that the search gave out
    below ``c``: all from there to ``c`` can be reached.
    """

    def __init__(self, source: np.ndarray, target: np.ndarray, n: int):
        order = np.argsort(source, kind="stable")
        self.n, self.to, self.at = n, target[order], np.searchsorted(source[order], np.arange(n + 1))
        self._search()
        loops = np.zeros(n, bool)
        loops[source[source == target]] = True
        self.sizes = np.bincount(self.component, minlength=len(self.first))
        self.circular = loops | (self.sizes[self.component] > 1)

    def _search(self) -> None:
        to, at = self.to.tolist(), self.at.tolist()
        seen, low, component, begun = [0] * self.n, [0] * self.n, [-1] * self.n, [0] * self.n
        upto, first, open_, clock = at[:-1], [], [], 0
        for root in range(self.n):
            if seen[root]:
                continue
            path = [root]
            while path:
                v = path[-1]
                if not seen[v]:
                    clock += 1
                    seen[v] = low[v] = clock
                    begun[v] = len(first)
                    open_.append(v)
                while upto[v] < at[v + 1]:
                    w = to[upto[v]]
                    if not seen[w]:
                        path.append(w)
                        break
                    upto[v] += 1
                    if component[w] < 0 and low[w] < low[v]:
                        low[v] = low[w]
                else:
                    path.pop()
                    if low[v] == seen[v]:
                        while True:
                            w = open_.pop()
                            component[w] = len(first)
                            if w == v:
                                break
                        first.append(begun[v])
        self.component, self.first = np.array(component, np.int64), np.array(first, np.int64)

    def between(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct edges between components, by their source: (targets, index of each source's first one)."""
        a, b = np.repeat(self.component, np.diff(self.at)), self.component[self.to]
        keys = np.unique(a[a != b] * (len(self.first) + 1) + b[a != b])
        return keys % (len(self.first) + 1), np.searchsorted(keys // (len(self.first) + 1), np.arange(len(self.first) + 1))

    def counts(self, weights: Sequence[np.ndarray]) -> list[np.ndarray]:
        """For each weighting of the nodes, what each node reaches by an edge or more."""
        per = [np.bincount(self.component, weights=w, minlength=len(self.first)).astype(np.int64) for w in weights]
        edges = self.between()
        within = self._by_runs(edges, per)
        if within is None:
            within = self._by_bits(edges, per)
        return [(all_ - np.where(self.circular, 0, own[self.component])) for all_, own in zip((x[self.component] for x in within), per, strict=True)]

    def _by_runs(self, edges: tuple[np.ndarray, np.ndarray], per: list[np.ndarray]) -> list[np.ndarray] | None:
        """What each component reaches, with itself, as sums over runs of numbers; None if there are too many runs."""
        to, at, first = edges[0].tolist(), edges[1].tolist(), self.first.tolist()
        sums = [np.concatenate(([0], np.cumsum(w))).tolist() for w in per]
        out = [[0] * len(first) for _ in per]
        runs: list[list[tuple[int, int]]] = []
        held = 0
        for c, low in enumerate(first):
            more = {r for s in to[at[c] : at[c + 1]] for r in runs[s]}
            merged: list[tuple[int, int]] = []
            for a, b in [*sorted(more), (low, c)]:
                if merged and a <= merged[-1][1] + 1:
                    if b > merged[-1][1]:
                        merged[-1] = merged[-1][0], b
                else:
                    merged.append((a, b))
            runs.append(merged)
            held += len(merged)
            if held > MOST_RUNS:
                return None
            for k, total in enumerate(sums):
                out[k][c] = sum(total[b + 1] - total[a] for a, b in merged)
        return [np.array(x, np.int64) for x in out]

    def _by_bits(self, edges: tuple[np.ndarray, np.ndarray], per: list[np.ndarray]) -> list[np.ndarray]:
        """The same by sets of bits, for a block of targets at a time; components of equal depth are done together."""
        to, at = edges
        n = len(self.first)
        depth = np.zeros(n, np.int64)
        for c in range(n):
            own = to[at[c] : at[c + 1]]
            depth[c] = depth[own].max() + 1 if len(own) else 0
        order = np.argsort(depth, kind="stable")
        out = [np.zeros(n, np.int64) for _ in per]
        words = max(1, min(64, BITS_BYTES // (8 * max(n, 1))))
        for t in range(0, n, 64 * words):
            # Lower numbers reach none of these targets.
            bits = np.zeros((n - t + 1, words), np.uint64)  # the last row stays empty, for nodes without successors
            targets = np.arange(min(64 * words, n - t))
            bits[targets, targets // 64] = np.uint64(1) << (targets % 64).astype(np.uint64)
            later = order[order >= t]
            for same in np.split(later, np.flatnonzero(np.diff(depth[later])) + 1):
                sizes = at[same + 1] - at[same]
                same, sizes = same[sizes > 0], sizes[sizes > 0]
                if len(same):
                    ends = np.cumsum(sizes)
                    next_ = to[np.repeat(at[same] - (ends - sizes), sizes) + np.arange(ends[-1])]
                    bits[same - t] |= np.bitwise_or.reduceat(bits[np.where(next_ >= t, next_ - t, n - t)], ends - sizes, axis=0)
            for k, w in enumerate(per):
                block = w[t : t + len(targets)]
                ones = np.zeros(words, np.uint64)
                np.bitwise_or.at(ones, targets // 64, np.where(block > 0, np.uint64(1) << (targets % 64).astype(np.uint64), np.uint64(0)))
                out[k][t:] += np.bitwise_count(bits[:-1] & ones).sum(1).astype(np.int64)
                for j in np.flatnonzero(block > 1):  # components of several nodes
                    out[k][t:] += np.where(bits[:-1, j // 64] >> np.uint64(j % 64) & np.uint64(1), block[j] - 1, 0)
        return out

    def gathered(self, marks: np.ndarray, ranks: np.ndarray, most: int) -> tuple[list[int], list[list[int]]]:
        """What each node reaches by an edge or more: all bits of ``marks`` (one number for each node), and the ``most`` lowest ``ranks`` (-1: none)."""
        to, at = (x.tolist() for x in self.between())
        n = len(self.first)
        bits, low = [0] * n, [[] for _ in range(n)]
        for node, c in enumerate(self.component.tolist()):
            bits[c] |= 1 << int(marks[node])
            if ranks[node] >= 0:
                low[c].append(int(ranks[node]))
        beyond_bits, beyond_low = [0] * n, [[]] * n
        for c in range(n):
            for s in to[at[c] : at[c + 1]]:
                beyond_bits[c] |= bits[s]
            more = {r for s in to[at[c] : at[c + 1]] for r in low[s]}
            beyond_low[c] = heapq.nsmallest(most, more)
            bits[c] |= beyond_bits[c]
            low[c] = heapq.nsmallest(most, more.union(low[c])) if low[c] else beyond_low[c]
        around = self.circular.tolist()
        component = self.component.tolist()
        return [(bits if on else beyond_bits)[c] for c, on in zip(component, around, strict=True)], [(low if on else beyond_low)[c] for c, on in zip(component, around, strict=True)]
