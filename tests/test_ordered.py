"""Folds, as-of joins and panes against plain Python, with hot keys, nulls, ties and empty tables."""

import random
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordered as R
from tidemark.operators import relational as Q


@pytest.fixture
def many_ranges(spark):
    """Small tables stay in as many ranges as there are partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def newest(left, right):
    out = []
    for key, at, i in left:
        able = [(r_at, tie, v) for k, r_at, tie, v in right if key is not None and at is not None and k == key and r_at is not None and r_at <= at]
        best = max(able, key=lambda x: x[:2]) if able else (None, None, None)
        out.append((i, best[1], best[2]))
    return sorted(out)


@pytest.mark.parametrize("hot", [0.0, 0.5, 1.0])
def test_asof_equals_plain_search(spark, many_ranges, hot):
    rng = random.Random(hot)
    key = lambda: 7 if rng.random() < hot else rng.choice([*range(20), None])
    left = [(key(), rng.choice([None, *range(60)]), i) for i in range(600)]
    right = [(key(), rng.choice([None, *range(0, 60, 5)]), i, None if i % 9 == 0 else f"v{i}") for i in range(150)]
    df = spark.createDataFrame(left, "k long, at int, i int")
    state = spark.createDataFrame(right, "k long, at int, tie int, v string")
    got = R.asof_join(df, state, "k", "at", "at", "tie", ["tie", "v"]).select("i", "asof_tie", "asof_v")
    assert sorted(map(tuple, got.collect())) == newest(left, right)


def test_asof_hands_state_over_ranges(spark, many_ranges):
    """One key, its only state long before every other row: all ranges but the first live on what is handed on."""
    left = spark.range(1_000_000).selectExpr("'a' AS k", "id + 10 AS at", "id AS i", "0 AS side", "0 AS state")
    right = spark.createDataFrame([("a", 5, 1, "old"), ("b", 6, 2, "other")], "k string, at long, tie int, v string")
    got = R.asof_join(left, right, "k", "at", "at", "tie", ["v"])
    assert got.columns == ["k", "at", "i", "side", "state", "asof_v"]
    assert got.where("asof_v = 'old'").count() == 1_000_000


def test_asof_empty_sides(spark):
    left = spark.createDataFrame([("a", 1)], "k string, at long")
    right = spark.createDataFrame([("a", 0, 1, "x")], "k string, at long, tie int, v string")
    assert [tuple(r) for r in R.asof_join(left, right.limit(0), "k", "at", "at", "tie", ["v"]).collect()] == [("a", 1, None)]
    assert R.asof_join(left.limit(0), right, "k", "at", "at", "tie", ["v"]).count() == 0


def test_fold_of_a_hot_key_is_linear(spark):
    def took(n):
        trades = spark.range(n).selectExpr("CAST(NULL AS STRING) AS w", "id AS t", "id AS i", "IF(id % 2 = 0, 'buy', 'sell') AS side", "1.0D AS a", "IF(id % 2 = 0, 1.0D, 3.0D) AS u")
        began = time.time()
        (row,) = Q.average_cost(trades, ["w"], "t", "i", "side", "a", "u").collect()
        assert (row.w, row.bought, row.sold, row.pnl, row.closed) == (None, n / 2, n / 2, n / 2 * 2.0, True)
        return time.time() - began

    took(1000)
    small, large = took(250_000), took(1_000_000)
    assert large < 8 * small + 3


def test_fold_keys_batches_and_odd_trades(spark):
    rows = [("x", i, i, "buy", 1.0, float(i)) for i in range(1, 30)] + [("y", 1, 1, "sell", 5.0, 5.0), ("z", 1, 1, "buy", None, 5.0), ("z", 2, 2, "buy", 0.0, 5.0), ("z", 3, 3, None, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "w string, t int, i int, side string, a double, u double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        got = {r.w: (r.bought, r.sold, r.pnl, r.closed) for r in Q.average_cost(df, ["w"], "t", "i", "side", "a", "u").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {"x": (29.0, 0.0, 0.0, False), "y": (0.0, 0.0, 5.0 * 0, False), "z": (0.0, 0.0, 0.0, False)}
    assert Q.average_cost(df.limit(0), ["w"], "t", "i", "side", "a", "u").count() == 0


def test_launch_coverage_of_one_long_stream(spark):
    n = 200_000
    cuts = spark.range(n).selectExpr("1 AS s", "id AS cut", "id * 10 - IF(id % 1000 = 999, 0, 5) AS a", "id * 10 + 10 AS b", "id % 777 = 776 AS e")
    got = {r.state: r.n for r in Q.launch_coverage(cuts, "s", "cut", "a", "b", "e").groupBy("state").agg(F.count("*").alias("n")).collect()}
    edge, want = None, defaultdict(int)
    for i in range(n):
        a, b = i * 10 - (0 if i % 1000 == 999 else 5), i * 10 + 10
        state = "SOURCE_ERROR" if i % 777 == 776 else "BASELINE_ONLY" if edge is None else "COMPLETE_INTERVAL" if a <= edge <= b else "GAP"
        edge = b if state in ("BASELINE_ONLY", "COMPLETE_INTERVAL") else edge
        want[state] += 1
    assert got == want


def test_panes(spark):
    rng = random.Random(2)
    rows = [("a" if rng.random() < 0.7 else None, rng.choice([1, 2, 3, None]), rng.randrange(0, 6000)) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, u int, s int").select("k", "u", F.timestamp_seconds("s").alias("at"))
    df = df.unionByName(df.limit(1).withColumn("at", F.lit(None).cast("timestamp")))
    got = {(r.k, r.pane): r for r in R.pane_features(df.where("k IS NOT NULL"), "k", "u", "at", {"x": 1, "y": 3}).collect()}
    for (k, pane), r in got.items():
        for name, m in (("x", 1), ("y", 3)):
            own = [u for key, u, s in rows if key == k and pane - m < s // 300 <= pane]
            prior = [u for key, u, s in rows if key == k and pane - 2 * m < s // 300 <= pane - m]
            who = {u: own.count(u) for u in own if u is not None}
            assert (r[f"n_{name}"], r[f"prior_{name}"], r[f"members_{name}"]) == (len(own), len(prior), len(who))
            assert r[f"dominance_{name}"] == (max(who.values()) / len(own) if who else None)
            assert r[f"acceleration_{name}"] == (len(own) / len(prior) if prior else None)
    assert {(k, s // 300) for k, _, s in rows if k} == set(got)
