import random
import time
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pytest

from gridspark.operators import align, diff

random.seed(5)


def wanted(a, b):
    found = SequenceMatcher(a=a, b=b, autojunk=False).get_matching_blocks()
    return [(i + k, j + k) for i, j, n in found for k in range(n)]


def pairs(a, b):
    return [(i + k, j + k) for i, j, n in align.blocks(np.array(a, np.int64), np.array(b, np.int64)) for k in range(n)]


@pytest.mark.parametrize("most", [align.MOST_PAIRS, 0])
def test_blocks_equal_difflib(monkeypatch, most):
    monkeypatch.setattr(align, "MOST_PAIRS", most)
    for trial in range(400):
        values = random.choice((1, 2, 3, 8, 50))
        a = [random.randrange(values) for _ in range(random.randrange(0, 40))]
        if trial % 2:
            b = list(a)
            for _ in range(random.randrange(0, 5)):
                at = random.randrange(len(b) + 1)
                b[at : at + random.randrange(3)] = [random.randrange(values)] * random.randrange(4)
        else:
            b = [random.randrange(values) for _ in range(random.randrange(0, 40))]
        if trial % 3 == 0:
            a, b = ([x for x in s for _ in range(random.choice((1, 1, 5)))] for s in (a, b))
        assert pairs(a, b) == wanted(a, b), (a, b)


def best(score):
    """The greatest total and the pairing by the rule, by trying all from the end."""
    n, m = score.shape
    total = np.zeros((n + 1, m + 1))
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            total[i, j] = max(total[i - 1, j - 1] + score[i - 1, j - 1], total[i - 1, j], total[i, j - 1])
    out = []

    def back(i, j):
        if i and j and total[i, j] == total[i - 1, j - 1] + score[i - 1, j - 1]:
            out.append((i - 1, j - 1))
            return back(i - 1, j - 1)
        if i and (not j or total[i, j] == total[i - 1, j]):
            out.append((i - 1, None))
            return back(i - 1, j)
        if j:
            out.append((None, j - 1))
            return back(i, j - 1)
        return None

    back(n, m)
    return out


def test_regions_pair_by_similarity():
    for _ in range(150):
        rows = [[{c: random.randrange(3) for c in random.sample(range(4), random.randrange(0, 4))} for _ in range(random.randrange(0, 7))] for _ in range(2)]
        score = align.similarities(*rows)
        for i, a in enumerate(rows[0]):
            for j, b in enumerate(rows[1]):
                either = set(a) | set(b)
                want = (1.0 if not a and not b else 0.05) if not a or not b else max(sum(a.get(c) == b.get(c) for c in either) / len(either), 0.01)
                assert score[i, j] == want
        assert list(align.paired(score)) == best(score)


def sheet(rows):
    return pd.DataFrame([(r, [{"col": c, "sig": v} for c, v in cells.items()]) for r, cells in rows.items()], columns=["row", "cells"])


def test_a_stray_cell_far_below_takes_no_time():
    old = {r: {1: r, 2: r * r} for r in range(1, 7)} | {1_048_576: {1: 9}}
    new = {(r if r < 4 else r + 1): c for r, c in old.items() if r < 1_048_576} | {4: {1: 77}, 1_048_576: {1: 9}}
    began = time.perf_counter()
    o, n = diff._aligned(sheet(old), sheet(old))
    assert list(zip(o, n, strict=True)) == [(r, r) for r in old]
    o, n = diff._aligned(sheet(old), sheet(new))
    assert [(a, b) for a, b in zip(o, n, strict=True) if a and b and a < 7] == [(1, 1), (2, 2), (3, 3), (4, 5), (5, 6), (6, 7)]
    assert time.perf_counter() - began < 3


@pytest.mark.parametrize("values", [1, 2, 300])
def test_many_repeated_rows_take_seconds(values):
    n = 100_000
    old = {r: {1: r * 7919 % values} for r in range(1, n + 1)}
    new = {r + (r > 50_000): c for r, c in old.items()} | {50_001: {1: -5}}
    began = time.perf_counter()
    o, k = diff._aligned(sheet(old), sheet(new))
    assert [(a, b) for a, b in zip(o, k, strict=True) if not a or not b] == [(0, 50_001)]
    assert time.perf_counter() - began < 30
