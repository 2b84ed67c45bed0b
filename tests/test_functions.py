from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.operators import relational as R


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


def test_text_functions(spark):
    assert one(spark, "A Viral MEME", X.matched_buckets) == ["meme"]
    assert [one(spark, v, X.metric) for v in ("1.2M", "3k", "17", "x", None)] == [1200000, 3000, 17, None, None]
    assert [one(spark, v, X.age_minutes) for v in ("3 hours ago", "Streamed 1 day ago", "5 days later", "Premieres in 3 days", "now", None)] == [180.0, 1440.0, None, None, None, None]
    assert X.simhash_bits([]) is None and X.simhash_bits(["a"]) == X.simhash_bits(["a", "a"])


def test_same_address(spark):
    df = spark.createDataFrame([("0xAb", "0xaB"), ("Ab", "ab"), (None, "x"), ("", ""), (None, None), ("q", "q")], "a string, b string")
    assert [r[0] for r in df.select(X.same_address(F.col("a"), F.col("b"))).collect()] == [True, False, False, False, False, True]


def test_launch_coverage_keeps_the_boundary_in_a_gap(spark):
    cuts = spark.createDataFrame([("s", 1, 1, 5, False), ("s", 2, 4, 9, False), ("s", 3, 20, 30, False), ("s", 4, 8, 12, False), ("s", 5, None, None, True)], "s string, cut long, a long, b long, e boolean")
    got = [(r.state, r.boundary) for r in R.launch_coverage(cuts, "s", "cut", "a", "b", "e").orderBy("cut").collect()]
    assert got == [("BASELINE_ONLY", 5), ("COMPLETE_INTERVAL", 9), ("GAP", 9), ("COMPLETE_INTERVAL", 12), ("SOURCE_ERROR", 12)]


def test_average_cost_and_scores(spark):
    rows = [("w", k, i, s, 10.0, u) for k, (b, e) in enumerate([(100.0, 180.0), (100.0, 150.0), (100.0, 50.0)]) for i, s, u in ((1, "buy", b), (2, "sell", e))]
    df = spark.createDataFrame(rows, "wallet string, token int, ts int, side string, amount double, usd double")
    ledger = R.average_cost(df, ["wallet", "token"], "ts", "ts", "side", "amount", "usd")
    s = R.wallet_scores(ledger, "wallet").first()
    assert (s.closed_n, s.wins, round(s.profit_factor, 3)) == (3, 2, 2.6) and ledger.agg(F.sum("pnl")).first()[0] == 80.0


def test_queries_run(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
