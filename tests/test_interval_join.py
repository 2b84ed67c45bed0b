from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.functions import fixed
from tidemark.functions import text as X
from tidemark.operators import relational as R

START = datetime(2026, 1, 1)


def brute(events, pools):
    out = set()
    for i, t, p, ws in events:
        for j, u, q, vs in pools:
            a, b = set(ws or []), set(vs or [])
            n = a & b
            score = 1.0 if p == q else min(0.95, 0.6 + 0.1 * len(n)) if len(n) > 1 else 0.72 if len(n) == 1 and len(min(n)) >= 6 and (a == n or b == n) else 0.0
            if p and q and score >= 0.72 and timedelta(0) <= u - t <= timedelta(hours=48):
                out.add((i, j, round(score, 6)))
    return out


def test_interval_token_join_matches_brute_force(spark):
    at = lambda h: START + timedelta(hours=h)
    events = [(1, at(0), "golden penguin", ["golden", "penguin"]), (2, at(0), "penguin", ["penguin"]), (3, at(0), "of it", []), (4, at(0), "a cat", ["cat"]), (5, at(0), "", []), (6, at(0), None, None), (7, at(0) + timedelta(milliseconds=900), "penguin", ["penguin", "penguin"])]
    pools = [(1, at(1), "penguin", ["penguin"]), (2, at(48), "golden penguin dance", ["golden", "penguin", "dance"]), (3, at(2), "of it", None), (4, at(3), "cat", ["cat"]), (5, at(3), "", []), (6, at(49), "penguin", ["penguin"]), (7, at(-1), "penguin", ["penguin"]), (8, at(1), "golden day", ["golden", "day"]), (9, at(0) + timedelta(milliseconds=100), "penguin", ["penguin"])]
    e = spark.createDataFrame(events, "event_id long, published timestamp, phrase string, tokens array<string>")
    p = spark.createDataFrame(pools, "pool_id long, created timestamp, phrase string, tokens array<string>")
    got = [(r.event_id, r.pool_id, round(r.score, 6)) for r in R.interval_token_join(e, p).collect()]
    want = brute(events, pools)
    assert sorted(got) == sorted(want) and {s for *_, s in want} == {0.72, 0.8, 1.0}


def test_reference_buckets(spark):
    rows = [("It went viral, a reaction video https://www.tiktok.com/x", ["origin_tiktok", "reaction", "viral"]), ("a viral day", []), ("Fan art, spoof", ["derivative", "parody"]), (None, [])]
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, x string")
    assert [r[0] for r in df.orderBy("i").select(X.matched_buckets(F.col("x"), patterns=fixed.SOCIAL_BUCKETS)).collect()] == [r[1] for r in rows]
