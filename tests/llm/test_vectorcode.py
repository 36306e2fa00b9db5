import hashlib
import math
import random

import numpy as np

from gridspark.llm import vectorcode as v

SCHEMA = "vec_id long, embedding array<float>, label int, pos int, part string, times long, _row long, code string, _hit boolean, index int"


def brute(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [math.floor(1024 * np.float64(np.float32(x))) for x in e], label) for i, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    d = len(kept[0][1]) // parts
    cut = [[tuple(e[k * d : (k + 1) * d]) for k in range(parts)] for _, e, _ in kept]
    books = [[cut[i][k] for i in range(min(entries, len(cut)))] for k in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(book))

    for _ in range(rounds):
        for k in range(parts):
            members = {}
            for c in cut:
                members.setdefault(near(c[k], books[k])[1], []).append(c[k])
            for j, m in members.items():
                books[k][j] = tuple(sum(col) // len(m) for col in zip(*m, strict=True))
    sha = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, by_label = [], {}
    for (i, _, label), c in zip(kept, cut, strict=True):
        found = [near(c[k], books[k]) for k in range(parts)]
        error = sum(f[0] for f in found)
        by_label[label] = by_label.get(label, 0) + error
        out.append((i, "".join(f"{f[1]:02x}" for f in found), error, label))
    return sorted([(i, code, error, by_label[label], sha) for i, code, error, label in out], key=str)


def got(df, **how):
    return sorted((tuple(r) for r in v.coded(df, **how).collect()), key=str)


def test_equals_brute_force_with_ties_nulls_and_repeats(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice((-0.25, 0.1, 0.30001, 0.5)) for _ in range(8)], rng.choice((None, 1, 2))) for i in range(120)]
    rows += [rows[5], rows[5], (None, rows[7][1], 1), (500, None, 1), (501, [None] * 8, 1), (502, [float("nan")] * 8, None), (503, [float("inf")] * 8, 2)]
    df = spark.createDataFrame([(*r, 1, "x", 2, 3, "c", True, 4) for r in rows], SCHEMA).repartition(3)
    assert got(df, entries=16) == brute(rows, entries=16)
    assert got(df, entries=2) == brute(rows, entries=2)


def test_large_components_stay_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.choice((0, 3, 5)) for _ in range(4)], 1) for i in range(30)]
    assert got(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), entries=4) == brute(rows, entries=4)
    far = [(i, [s * 3e38] * 4, None) for i, s in enumerate((1.0, -1.0, 0.0))]
    # The mean of both ends of 64 bits and 0 is -1.
    assert sorted(r[2] for r in got(spark.createDataFrame(far, "vec_id long, embedding array<float>, label int"), entries=1)) == [4, v._MOST, v._MOST]


def test_hot_parts_go_by_broadcast(spark, monkeypatch):
    from gridspark.llm import _lookup

    rng = random.Random(5)
    rows = [(i, [0.5] * 8 if i % 3 == 0 else [rng.random() for _ in range(8)], i % 2) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    want = brute(rows, entries=8)
    for shares in (1, 10, 1000):
        monkeypatch.setattr(_lookup, "SHARES", shares)
        assert got(df, entries=8) == want


def test_odd_lengths_and_empty_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert got(spark.createDataFrame([], schema)) == []
    assert got(spark.createDataFrame([(1, [], 1), (2, None, 1)], schema)) == [(1, None, None, None, None)]
    mixed = got(spark.createDataFrame([(1, [0.1] * 4, 1), (2, [0.1] * 8, 1), (3, [0.1] * 3, 1)], schema))
    assert [(r[0], r[1]) for r in mixed] == [(1, "00000000"), (2, None), (3, None)]


def test_query_of_the_table(spark, tiny):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{tiny}/embeddings.parquet").collect()]
    assert got(spark.read.parquet(f"{tiny}/embeddings.parquet")) == brute(rows)
