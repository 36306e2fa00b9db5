import random
import time

import numpy as np
import pandas as pd
import pytest

from gridspark.operators import graph, reach

random.seed(9)


def walked(n, edges):
    after = [set() for _ in range(n)]
    for a, b in edges:
        after[a].add(b)
    out = []
    for root in range(n):
        seen, front = set(), [root]
        while front:
            front = [w for v in front for w in after[v] if w not in seen and not seen.add(w)]
        out.append(seen)
    return out


def made(n, m, loops=True):
    return sorted({(a, b) for a, b in ((random.randrange(n), random.randrange(n)) for _ in range(m)) if loops or a < b})


@pytest.mark.parametrize("by_bits", [False, True])
def test_random_graphs_equal_a_plain_walk(monkeypatch, by_bits):
    if by_bits:
        monkeypatch.setattr(reach, "MOST_RUNS", 0)
        monkeypatch.setattr(reach, "BITS_BYTES", 4000)  # several blocks of targets
    for trial in range(60):
        n = random.randrange(1, 300 if trial % 10 == 0 else 40)
        edges = made(n, random.randrange(0, 3 * n), trial % 2)
        g = reach.Graph(*(np.array([e[k] for e in edges], np.int64) for k in (0, 1)), n)
        want = walked(n, edges)
        marks, flags = np.array([random.randrange(5) for _ in range(n)]), np.array([random.randrange(2) for _ in range(n)])
        counts, outputs = g.counts((np.ones(n, np.int64), flags))
        bits, low = g.gathered(marks, np.where(flags, np.arange(n), -1), 3)
        for v in range(n):
            assert (counts[v], outputs[v], g.circular[v]) == (len(want[v]), sum(flags[w] for w in want[v]), v in want[v])
            assert bits[v] == sum(1 << m for m in {int(marks[w]) for w in want[v]}) and low[v] == sorted(w for w in want[v] if flags[w])[:3]
        for a, b in edges:
            assert g.component[a] >= g.component[b]
            assert (g.component[a] == g.component[b]) == (a == b or (b in want[a] and a in want[b]))


def test_a_running_balance_takes_seconds(monkeypatch):
    n = 100_000  # inputs, then balances
    source, target = np.concatenate((np.arange(n), np.arange(n, 2 * n - 1))), np.concatenate((np.arange(n, 2 * n), np.arange(n + 1, 2 * n)))
    began = time.perf_counter()
    g = reach.Graph(source, target, 2 * n)
    counts = g.counts((np.ones(2 * n, np.int64),))[0]
    assert counts[:n].tolist() == list(range(n, 0, -1)) and not g.circular.any()
    assert time.perf_counter() - began < 30


def test_intervals_give_the_cycles_of_all_edges():
    for _ in range(40):
        cells = sorted({(random.choice("ST"), random.randrange(1, 9), random.randrange(1, 4)) for _ in range(random.randrange(1, 25))})
        spans = []
        for c in cells:
            for _ in range(random.randrange(1, 3)):
                r, k = sorted(random.randrange(1, 9) for _ in range(2)), sorted(random.randrange(1, 4) for _ in range(2))
                spans.append((*c, random.choice("STU"), r[0], k[0], random.choice((r[0], r[1])), k[1] if random.random() < 0.3 else k[0]))
        frame = pd.DataFrame(spans, columns=["sheet", "row", "col", "to_sheet", "row1", "col1", "row2", "col2"])
        number = {c: i for i, c in enumerate(cells)}
        edges = {(number[s[:3]], number[t]) for s in spans for t in cells if t[0] == s[3] and s[4] <= t[1] <= s[6] and s[5] <= t[2] <= s[7] and t != s[:3]}
        want = walked(len(cells), edges)
        cycles = {frozenset(w for w in range(len(cells)) if w in want[v] and v in want[w]) for v in range(len(cells)) if v in want[v]}
        sheets, keys, (formula,) = graph._nodes(((frame, ("sheet", "row", "col")),))
        source, target, n = graph.interval_graph(sheets, keys, formula, frame)
        own = source != target
        got = graph._cycle_rows("w", reach.Graph(source[own], target[own], n).component, sheets, keys)
        found = {frozenset(number[tuple(r)] for r in part[["sheet", "row", "col"]].itertuples(index=False)) for _, part in got.groupby("cycle")}
        assert found == cycles


def test_cumulative_sums_cost_their_logarithm():
    n = 10_000  # each of a column's formulas adds up the column beside it, whose formulas use single cells
    rows = [("S", r, 2, "S", 1, 3, 1, 3) for r in range(1, n + 1)] + [("S", r, 1, "S", 1, 2, r, 2) for r in range(1, n + 1)]
    frame = pd.DataFrame(rows, columns=["sheet", "row", "col", "to_sheet", "row1", "col1", "row2", "col2"])
    sheets, keys, (formula,) = graph._nodes(((frame, ("sheet", "row", "col")),))
    source, target, nodes = graph.interval_graph(sheets, keys, formula, frame)
    assert len(source) < 40 * n and nodes < 6 * n
    assert len(graph._cycle_rows("w", reach.Graph(source, target, nodes).component, sheets, keys)) == 0
