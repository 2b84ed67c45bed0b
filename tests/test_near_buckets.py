"""Pairs of a bucket are found where it lies; a class in which a link fails is decided pair by pair."""

import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import near as N

from .test_simhash_near import classes, far


def close(rng, n, base, bits):
    out = set()
    while len(out) < n:
        x = base
        for b in rng.sample(range(20), bits):  # buckets share the other bits
            x ^= 1 << b
        out.add(x)
    return sorted(out)


def test_a_large_bucket_is_connected_as_all_its_pairs(monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 1000)
    rng = random.Random(1)
    for most in (2, 5):
        parts = [close(rng, 90, 0, 4), close(rng, 7, 1 << 40, 3), close(rng, 30, 1 << 50, 2)]
        fps, bucket = np.array(sum(parts, []), np.uint64), np.repeat([0, 1, 2], [90, 7, 30])
        x, y = N.links_in(fps, bucket, most)
        own = fps.tolist()
        assert all(bucket[i] == bucket[j] and far(own[i], own[j]) <= most for i, j in zip(x, y))
        want = [(a, b) for a in range(127) for b in range(a) if bucket[a] == bucket[b] and far(own[a], own[b]) <= most]
        assert classes(range(127), zip(x.tolist(), y.tolist())) == classes(range(127), want)


def test_links_that_fail_split_a_class_of_fingerprints(spark):
    """Rows with equal and near fingerprints link only within a colour, that the pairs of the index don't know."""
    rng = random.Random(4)
    fps = [x for base in (0, 0x0F0F << 32) for x in close(rng, 25, base, 2)]
    rows = [(i, fps[i % 50], i % 3 if i % 50 < 25 else 7) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, fp long, colour int")
    colour = df.select("id", "colour")
    settle = lambda p: p.join(colour.withColumnRenamed("id", "a"), "a").join(colour.select(F.col("id").alias("b"), F.col("colour").alias("c")), "b").where("colour = c")
    want = classes(range(120), [(a, b) for a, x, c in rows for b, y, e in rows if a < b and far(x, y) <= 4 and c == e])
    for sure, more in ((lambda x, y: F.col(f"{x}.colour") == F.col(f"{y}.colour"), None), (lambda x, y: F.lit(False), settle)):
        got = dict(map(tuple, N.near_classes(df, 4, sure, more).collect()))
        assert {i: got.get(i, i) for i in range(120)} == want and len(set(want.values())) > 3
