import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import hard_negatives as H


def brute(rows, positives, negatives, percent):
    """rows: (id, label, vector) as they stand in the table."""
    able = {}
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            able[i, label, tuple(math.floor(256 * float(x)) for x in v)] = 1
    able, out = list(able), []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for a, label, v in able:
        if a % 10:
            continue
        scored = [(-dot(v, w), i, other) for i, other, w in able]
        goals = sorted((s, i) for s, i, other in scored if other == label and i != a)[:positives]
        for s, p in goals:
            fit = sorted((t, i) for t, i, other in scored if other != label and percent * -s <= 100 * -t <= 100 * -s)
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(fit[:negatives])]
    return sorted(out)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 7, "x", 0) for r in rows], "vec_id long, label int, embedding array<float>, id int, print string, v int")
    return sorted(map(tuple, H.hard_negatives(df, F.col("id") % 10 == 0, **kw).collect()))


def as_float32(v):
    return None if v is None else [None if x is None else float(np.float32(x)) for x in v]


def test_equals_brute_force_across_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "ROWS", 64)
    monkeypatch.setattr(H, "ANCHORS", 7)
    monkeypatch.setattr(H, "HELD", 2_000)
    rng = random.Random(3)
    near = [[rng.gauss(0, 0.2) for _ in range(12)] for _ in range(4)]
    rows = [(i, rng.randrange(3), as_float32([x + rng.gauss(0, 0.05) for x in rng.choice(near)])) for i in range(600)]
    rows += [(600 + i, rng.randrange(3), as_float32([round(rng.uniform(-1, 1), 1) for _ in range(12)])) for i in range(200)]  # many ties
    want = brute(rows, 5, 5, 80)
    assert len(want) > 500
    assert run(spark, rows) == want


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [
        (0, 1, [0.5, 0.5]), (1, 1, [0.5, 0.4]), (2, 2, [0.5, 0.39]), (2, 2, [0.5, 0.39]), (3, None, [0.5, 0.5]), (4, 2, None), (5, 2, [None, 0.5]), (6, 2, [inf, 0.5]), (7, 2, [nan, 0.5]), (8, 2, [-inf, 0.1]), (None, 2, [0.5, 0.4]),
        (9, 2, []), (10, 3, []), (11, 3, []), (12, 2, [0.5]), (20, 1, [0.5, 0.5]), (20, 2, [0.5, 0.45]), (30, 4, [-0.001, 100.0]), (31, 4, [0.001, -100.0]), (32, 4, [0.0, 3.0]), (33, 5, [0.0, 3.0]), (40, 6, [1e30, 0.0]), (-10, 1, [0.25, 0.25]),
    ]
    rows = [(i, label, as_float32(v)) for i, label, v in rows]
    want = brute([r for r in rows if r[2] is None or not any(x == float(np.float32(1e30)) for x in r[2] if x is not None)], 2, 3, 80)
    assert want and run(spark, rows, positives=2, negatives=3) == want


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, 1, [1.0])]) == []
    assert run(spark, [(0, 1, [1.0])]) == []


def test_planes_and_intervals():
    rng = np.random.default_rng(0)
    v, w = rng.integers(-300, 300, (50, 13)), rng.integers(-300, 300, (9, 13))
    block = H.Block(np.arange(50), np.zeros(50, np.int64), H.pack_planes(v, 10))
    a = H.Anchors(np.arange(9), np.ones(9, np.int64), np.zeros(9, np.int64), w, np.full((9, 1), -1))
    exact, widths = v @ w.T, []

    def needed(r, c, low, high):
        own = exact if r is None else exact[r, c]
        assert (low <= own).all() and (own <= high).all()
        widths.append(int((high - low).max()))
        return own > 20_000

    r, c, score = H.scored_pairs(block, a, np.ones((50, 9), bool), needed)
    assert sorted(zip(r, c, score, strict=True)) == [(i, j, exact[i, j]) for i in range(50) for j in range(9) if exact[i, j] > 20_000]
    assert widths == sorted(widths, reverse=True) and widths[-1] == 0


def test_large_components_stay_exact(spark):
    rows = [(0, 1, [70000.0, -0.004]), (1, 1, [70000.0, 3.0]), (2, 2, [69999.0, 5.0]), (3, 2, [60000.0, -1.0])]
    rows = [(i, label, as_float32(v)) for i, label, v in rows]
    want = brute(rows, 5, 5, 80)
    assert len(want) == 2 and run(spark, rows) == want
