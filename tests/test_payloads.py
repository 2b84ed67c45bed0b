"""Payload walks against a walk in Python, flags, the ledger of a query that ends and starts again, summaries and first turnovers."""

import json
import random

from pyspark.sql import functions as F

from tidemark.functions import envelope as V
from tidemark.operators import summary as U
from tidemark.operators import variants as J
from tidemark.streaming import capture as S
from tidemark.streaming import ledger as L


def grown(rng, depth):
    kind = rng.randrange(7 if depth else 5)
    if kind < 5:
        return [rng.randrange(-9, 10**12), rng.choice(["http://a.b/c", "x", "", "1", 'q"uoteé']), True, False, None][kind]
    if kind == 5:
        return [grown(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["url", "HREF", "uri", "a", "b", "c d"]): grown(rng, depth - 1) for _ in range(rng.randrange(4))}


def walked(x, path="$", key=None):
    if isinstance(x, dict | list):
        inner = [(f"{path}.{k}", k, v) for k, v in x.items()] if isinstance(x, dict) else [(f"{path}[{i}]", None, v) for i, v in enumerate(x)]
        return [y for p, k, v in inner for y in walked(v, p, k)]
    text = None if x is None else str(x).lower() if isinstance(x, bool) else str(x)
    return [(path, key, text, "VOID" if x is None else "BOOLEAN" if isinstance(x, bool) else "BIGINT" if isinstance(x, int) else "STRING")]


def test_leaves_equal_a_walk_in_python(spark):
    rng = random.Random(3)
    payloads = [grown(rng, 5) for _ in range(300)] + [{"a": [{"url": "u"}]}] * 2
    df = spark.createDataFrame([(i, json.dumps(x), "k", 1) for i, x in enumerate(payloads)], "id int, payload string, value string, kind int")
    got = sorted(map(str, ((r.id, r.path, r.key, r.v, r.k) for r in J.leaves(df.select("id", "payload"), "payload").toDF("id", "path", "key", "v", "k").collect())))
    assert got == sorted(str((i, *leaf)) for i, x in enumerate(payloads) for leaf in walked(x))
    links = J.links(df.select("id", "payload"), "payload").groupBy("id").agg(F.array_sort(F.collect_list("value")).alias("l"))
    want = df.select("id", F.array_sort(V.recursive_urls(F.col("payload"))).alias("l")).where(F.size("l") > 0)
    assert sorted(map(str, links.collect())) == sorted(map(str, want.collect()))


def test_gaps_of_a_walk_are_rows(spark):
    rows = [(1, "{bad"), (2, None), (3, "{}"), (4, "[]"), (5, ""), (6, "[" * 6 + "7" + "]" * 6), (7, '"x"'), (None, '{"a":{"b":1.5}}')]
    got = {(r.id, r.path, r.value, r.kind) for r in J.leaves(spark.createDataFrame(rows, "id int, payload string"), "payload", deepest=3).collect()}
    assert got == {(1, "$", "{bad", "MALFORMED"), (5, "$", "", "MALFORMED"), (6, "$[0][0][0]", "[[[7]]]", "TOO_DEEP"), (7, "$", "x", "STRING"), (None, "$.a.b", "1.5", "DECIMAL")}
    assert J.leaves(spark.createDataFrame([], "id int, payload string"), "payload").collect() == []


def test_raw_boolean(spark):
    said = [("true", True), ('"Yes "', True), ("1", True), ('"off"', False), ("0", False), ("2", None), ('"maybe"', None), ("null", None), ("{}", None)]
    df = spark.createDataFrame([(f'{{"r":{{"f":{x}}}}}',) for x, _ in said] + [("{bad",), (None,), ("{}",)], "p string")
    assert [r.b for r in df.select(J.raw_boolean(F.col("p"), "$.r.f").alias("b")).collect()] == [b for _, b in said] + [None] * 3


def test_ledger_of_a_restarted_query(spark, tmp_path):
    src, out, offsets, kept = (str(tmp_path / x) for x in ("in", "out", "offsets", "ledger"))
    for part in range(2):
        spark.createDataFrame([(i % 30, part) for i in range(40)], "id int, part int").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id"))).coalesce(1).write.mode("append").parquet(src)
        schema = "id int, part int, ts timestamp"
        with L.RunLedger() as ledger:
            S.capture(L.kept_rows(S.unique_events(S.file_events(spark, src, schema, "ts"), ["id"], "ts", "1 hour")), offsets, out)
        ledger.save(spark, kept)
        ledger.save(spark, kept)  # once more: a cut counts once
    got = sorted((r.rows_in, r.kept, r.late, r.duplicates, r.balanced, r.state) for r in L.read_ledger(spark, kept).collect())
    assert got == [(40, 0, 0, 40, True, "CONNECTED_NO_EVENTS_UNVERIFIED"), (40, 30, 0, 10, True, "RAW_CAPTURE_ACTIVE")]
    unknown = spark.createDataFrame([("q", "r", 0, 5, None, 0, 0, "t")], L.ROW)
    unknown.write.mode("append").parquet(kept)
    assert [r.balanced for r in L.read_ledger(spark, kept).where("query_id = 'q'").collect()] == [False]


def test_state_summary(spark):
    df = spark.createDataFrame([("B", 1), ("A", 2), (None, 3), ("B", 4)], "s string, x int")
    said = json.loads(U.state_summary(df, F.col("s"), "v2", {"sum_x": F.sum("x")}).first().summary)
    assert said == {"version": "v2", "rows": 4, "sum_x": 10, "states": {"A": 1, "B": 2, "UNKNOWN": 1}}
    assert json.loads(U.state_summary(df.limit(0), F.col("s"), "v2").first().summary) == {"version": "v2", "rows": 0, "states": {}}


def test_first_turnover(spark):
    launches = spark.createDataFrame([("t", 100, "me"), ("u", 0, "me"), ("v", 0, None)], "token string, created long, creator string")
    trades = spark.createDataFrame([("t", 100, "me", 1.0), ("t", 109, "a", 2.0), ("t", 109, "a", 2.0), ("t", 110, "a", 9.0), ("t", 99, "a", 9.0), ("t", 105, None, 5.0), ("t", 106, "b", None), ("v", 1, "a", 4.0), ("w", 1, "a", 1.0)], "token string, at long, wallet string, usd double")
    got = {r.token: tuple(r)[1:] for r in U.first_turnover(launches, trades, "token", "at", "wallet", "usd", "created", "creator", 10).collect()}
    assert got == {"t": (5 + 0 + 0, 10.0, 3, 0.1, 0.4), "u": (0, 0.0, 0, None, None), "v": (1, 4.0, 1, 0.0, 1.0)}
