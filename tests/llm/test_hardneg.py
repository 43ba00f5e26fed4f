"""Hard negatives against all pairs, with odd rows and every tie."""

import random

import pytest
from pyspark.sql import functions as F

from shutterloom.llm import hardneg

SCHEMA = "VEC_ID2 string, vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=10):
    best = {}
    for _, i, v, y in rows:
        if i is None or v is None or y is None or any(x is None or x != x or abs(x) == float("inf") for x in v):
            continue
        x = tuple(int(256 * a // 1) for a in v)
        best[i] = min(best.get(i, (y, x)), (y, x))
    out = set()
    for a, (ya, xa) in best.items():
        if a % 100:
            continue
        scores = sorted(((-sum(p * q for p, q in zip(xa, x)), i, y) for i, (y, x) in best.items() if i != a))
        for s, p, _ in [t for t in scores if t[2] == ya][:positives]:
            fits = [(n, i) for n, i, y in scores if y != ya and 30 * -s <= 100 * -n <= 90 * -s][:negatives]
            out |= {(a, p, k, i, -s, -n) for k, (n, i) in enumerate(fits, 1)}
    return out


def rows_of(seed, n=700, dims=6, copies=250):
    rng = random.Random(seed)
    vector = lambda: [rng.choice([-1.0, -0.5, -0.25, 0.0, 0.25, 0.5, 1.0]) for _ in range(dims)]
    rows = [("x", i, vector(), rng.randrange(4)) for i in range(n)]
    rows += [("x", n + i, [0.5] * dims, 1) for i in range(copies)]
    rows += [("x", None, [1.0] * dims, 1), ("x", 5000, None, 1), ("x", 5100, [1.0] * dims, None), ("x", 5200, [1.0, None] + [0.0] * (dims - 2), 1), ("x", 5300, [float("nan")] * dims, 1), ("x", 5400, [float("inf")] * dims, 0)]
    return rows + [rows[3], rows[100], ("x", 200, [0.25] * dims, 0), ("x", 6000, [0.0] * dims, 2)]


@pytest.mark.parametrize("seed,block", [(1, 64), (2, 2048), (3, 16)])
def test_equals_all_pairs(spark, monkeypatch, seed, block):
    monkeypatch.setattr(hardneg, "BLOCK", block)
    monkeypatch.setattr(hardneg, "GROUP", 4)
    monkeypatch.setattr(hardneg, "FIRST", 2)
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {tuple(r) for r in hardneg.hard_negatives(df.drop("VEC_ID2"), F.col("id") % 100 == 0).collect()}
    assert got == brute(rows) and got


def test_empty_and_large(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hardneg.hard_negatives(empty, F.col("id") % 100 == 0).collect() == []
    alone = spark.createDataFrame([(1, [0.5], 1)], "vec_id long, embedding array<float>, label int")
    assert hardneg.hard_negatives(alone, F.col("id") % 100 == 0).collect() == []
    with pytest.raises(ValueError):
        hardneg.hard_negatives(spark.createDataFrame([(0, [1e30], 1)], "vec_id long, embedding array<float>, label int"), F.col("id") % 100 == 0)
    # nearly equal vectors of norms near the largest, whose distances are all rounding
    big = [("x", i, [float(i * 9001 % 40000), float(i * 77 % 1000)], i % 3) for i in range(300)] + [("x", 1000 + i, [120_000.0 + i / 128, 110_000.0], i % 2) for i in range(120)]
    df = spark.createDataFrame(big, SCHEMA)
    assert {tuple(r) for r in hardneg.hard_negatives(df, F.col("id") % 100 == 0).collect()} == brute(big)


def test_far_blocks_are_not_read(spark, monkeypatch):
    """In clustered rows the radius leaves most blocks unread."""
    monkeypatch.setattr(hardneg, "BLOCK", 32)
    monkeypatch.setattr(hardneg, "FIRST", 1)
    seen, own = [], hardneg._scanned
    monkeypatch.setattr(hardneg, "_scanned", lambda todo, *a: (seen.append(todo.select("group", "block").count()), own(todo, *a))[1])
    rng = random.Random(5)
    rows = []
    for i in range(2000):
        at = [0.0] * 8
        at[i % 8] = 1.0
        rows.append(("x", i, [a + rng.uniform(-0.02, 0.02) for a in at], i // 8 % 2))
    df = spark.createDataFrame(rows, SCHEMA)
    rows_out = hardneg.hard_negatives(df, F.col("id") == 100, low=95, high=100, negatives=3, positives=3).collect()
    blocks = 2000 // 32
    assert len(rows_out) == 9 and sum(seen) < blocks
