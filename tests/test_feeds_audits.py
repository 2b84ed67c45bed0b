import json

from pyspark.sql import functions as F

from tidemark.operators import audits as A
from tidemark.operators import consensus as C
from tidemark.sources import feeds
from tidemark.streaming import capture as S


def receipt(amount="105", before=1000, after=1100, fee=5, **over):
    move = {"type": "transferChecked", "info": {"mint": A.WRAPPED_SOL, "source": "v", "destination": "tmp", "tokenAmount": {"amount": amount}}}
    outer = [{"programId": A.AMM_PROGRAM, "parsed": "raw"}, {"programId": "x", "parsed": {"type": "closeAccount", "info": {"account": "tmp", "destination": "me"}}}]
    meta = {"err": None, "fee": fee, "logMessages": ["Program log: " + A.COLLECT_LOG], "preBalances": [before], "postBalances": [after], "innerInstructions": [{"instructions": [{"program": "spl-token", "parsed": move}]}]}
    return {"transaction": {"message": {"accountKeys": [{"pubkey": "me", "signer": True}, "other"], "instructions": outer}}, "meta": meta | over}


def test_creator_receipt(spark):
    cases = [
        (receipt(), "me", None), (receipt(fee=6), "me", "claim amount, wallet credit and fee do not reconcile"), (receipt(), "you", "creator not in account keys"),
        (receipt(err={"x": 1}), "me", "transaction unavailable or failed"), (None, "me", "transaction unavailable or failed"), (receipt(logMessages=None), "me", "creator fee collection log absent"),
        (receipt(amount=105), "me", "expected exactly one vault-to-closed-WSOL transfer"), (receipt(postBalances=[]), "me", "missing creator balances"), (receipt(), "other", "expected exactly one vault-to-closed-WSOL transfer"),
    ]
    df = spark.createDataFrame([(i, None if t is None else json.dumps(t), c) for i, (t, c, _) in enumerate(cases)], "i int, tx string, creator string")
    got = A.creator_receipt(df).orderBy("i").collect()
    assert [r.reason for r in got] == [c[2] for c in cases]
    assert (got[0].classification, got[0].amount, got[0].wallet_delta) == ("VERIFIED_CREATOR_LEVEL_AMM_FEE_RECEIPT", 105, 100)


def test_pool_fee_flow(spark):
    move = {"type": "transferChecked", "info": {"mint": A.WRAPPED_SOL, "authority": "p", "destination": "v", "tokenAmount": {"amount": "7"}}}
    tx = {"transaction": {"message": {"accountKeys": ["p", "v"]}}, "meta": {"logMessages": [A.FEES_LOG], "postTokenBalances": [{"mint": "m"}], "innerInstructions": [{"instructions": [{"program": "spl-token", "parsed": move}]}]}}
    df = spark.createDataFrame([(0, json.dumps(tx), "p", "m", "v", A.AMM_PROGRAM), (1, json.dumps(tx), "p", "n", "v", A.AMM_PROGRAM), (2, json.dumps(tx), "p", "m", "v", None)], "i int, tx string, pool string, mint string, vault string, owner string")
    got = A.pool_fee_flow(df).orderBy("i").collect()
    assert [(r.reason, r.fee_amount) for r in got] == [(None, 7), ("pool, mint or vault absent in transaction", None), ("pool is not owned by Pump AMM", None)]


def test_negative_eligibility(spark):
    live, stale = ("bluesky:jetstream_crypto", True, True, "OK"), ("bluesky:jetstream_crypto", True, False, "OK")
    t = 1_790_000_000
    rows = [(0, "s", "2026-09-21T14:13:38Z", (t - 0) * 1_000_000, [live]), (1, "s", "2026-09-21T14:13:38Z", (t - 900) * 1_000_000, [stale, ("reddit:x", False, None, None)]), (2, "z", None, None, None)]
    df = spark.createDataFrame(rows, "i int, schema string, generated_at string, cursor_us long, source_health array<struct<surface:string,ok:boolean,caught_up_near_live:boolean,coverage_status:string>>")
    got = A.negative_eligibility(df, "s").orderBy("i").collect()
    assert (got[0].stream_eligible, got[0].global_eligible, got[0].lag_seconds) == (True, True, 18.0)
    assert got[1].reason_codes == ["CURSOR_STALE", "JETSTREAM_NOT_CAUGHT_UP", "REDDIT_COVERAGE_MISSING"] and not got[1].global_eligible
    assert got[2].reason_codes == ["CURSOR_LAG_UNKNOWN", "JETSTREAM_HEALTH_MISSING", "WRONG_SCHEMA"]


def observe(cut, pool, rank, score, price, usd, buyers, share, route="ROUTE_PASS"):
    return ("f", cut, "n", pool, rank, float(score), float(price), route, "PROXY_PASS", 1.0, buyers, float(usd), 10.0, share, "ADDRESS_DIVERSE")


OBS = "family_id string, cut long, network string, pool_id string, rank int, score double, price double, execution string, contract string, cost_pct double, buyers int, buy_usd double, sell_usd double, max_buyer_share double, diversity string"


def test_family_baskets(spark):
    first = [observe(1, "a", 1, 10, 1, 55, 5, 0.25), observe(1, "b", 2, 9, 1, 45, 5, 0.3)]
    second = [observe(2, "a", 1, 11, 1.2, 75, 8, 0.25), observe(2, "b", 2, 8, 0.9, 25, 3, 0.3)]
    got = C.family_baskets(spark.createDataFrame(first + second, OBS)).orderBy("cut", "pool_id").collect()
    assert [(r.event, r.pool_id, r.siblings_down) for r in got] == [("OPEN", "a", None), ("OPEN", "b", None), ("ROTATE", "a", 1)]
    assert [r.value_usd for r in got[:2]] == [25.0, 25.0]
    flat = [observe(2, "a", 1, 11, 1.2, 55, 8, 0.25), observe(2, "b", 2, 8, 0.9, 45, 5, 0.3)]
    assert C.family_baskets(spark.createDataFrame(first + flat, OBS)).where("event = 'ROTATE'").count() == 0
    alone = [first[0], observe(1, "b", 2, 9, 1, 80, 3, 0.3, "NO_ROUTE")]
    assert C.family_baskets(spark.createDataFrame(alone, OBS)).count() == 0


def test_consensus_signals(spark):
    buys = spark.createDataFrame([("n", "t", w, 10.0) for w in "abc"] + [("n", "u", "a", 5.0)], "network string, token_id string, wallet string, usd double")
    able = spark.createDataFrame([("n", w, 1, "QUALIFIED") for w in "abc"], "network string, wallet string, qualified_at int, state string")
    roots = spark.createDataFrame([("n", w, "r" + w, "INDEPENDENT_VERIFIED") for w in "abc"], "network string, wallet string, funding_root string, provenance_state string")
    cands = spark.createDataFrame([("n", "p", "t", 1.0, None, "ROUTED_QUOTE_PASS", "PROXY_PASS"), ("n", "q", "u", 1.0, 1.0, None, None), ("n", "r", "v", None, None, None, None)], "network string, pool_id string, token_id string, price double, first_price double, route_state string, contract_state string")
    states = lambda *a: {r.token_id: r.signal_state for r in C.consensus_signals(cands, buys, *a).collect()}
    assert states(able, roots, 2) == {"t": "PAPER_PROBE_CANDIDATE", "u": "NO_CONSENSUS", "v": "NO_CONSENSUS"}
    assert states(able, roots, 1)["t"] == "NO_CONSENSUS"  # qualified now is not qualified before
    assert states(able, roots.limit(0), 2)["t"] == "CONSENSUS_INDEPENDENCE_UNVERIFIED"


def test_feeds(spark):
    xml = '<rss xmlns:ht="u"><channel><item><title> A </title><pubDate>Fri, 25 Sep 2026 07:00:00 +0000</pubDate><ht:news_item><ht:news_item_source>s</ht:news_item_source></ht:news_item></item><item><title>B</title></item></channel></rss>'
    got = feeds.trends(spark.createDataFrame([("US", xml)], "geo string, body string")).orderBy("rank").collect()
    assert [(r.geo, r.rank, r.title, len(r.support)) for r in got] == [("US", 1, "A", 1), ("US", 2, "B", 0)]
    assert str(got[0].published) == "2026-09-25 07:00:00" and got[1].published is None and got[0].support[0].source == "s"
    pool = {"id": "x", "attributes": {"name": "P", "reserve_in_usd": "12.5", "base_token_price_usd": "n/a"}, "relationships": {"base_token": {"data": {"id": "t"}}}}
    rows = feeds.pools(spark.createDataFrame([(json.dumps({"data": [pool]}),), (json.dumps({"data": pool}),), ("broken",)], "body string")).collect()
    assert [(r.id, r.reserve_usd, r.price_usd, r.token_id) for r in rows] == [("x", 12.5, None, "t")] * 2
    items = [{"mint": "m", "creator": "c", "program": "pump", "created_timestamp": 1000}, {"mint": "m2", "program": "pump", "created_timestamp": 5}]
    assert [r.mint for r in feeds.launches(spark.createDataFrame([(json.dumps(items),)], "body string")).collect()] == ["m"]


def test_streaming(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(i % 4, f"2026-01-01 00:0{i}:00") for i in range(8)]
    spark.createDataFrame(rows, "id int, ts string").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    for _ in range(2):  # the second run finds nothing new
        S.capture(S.unique_events(S.file_events(spark, src, schema, "ts"), ["id"], "ts", "1 hour"), str(tmp_path / "c1"), str(tmp_path / "out"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "out")).select("id").collect()) == [0, 1, 2, 3]
    S.window_counts(S.file_events(spark, src, schema, "ts"), "ts", ["id"], "4 minutes", str(tmp_path / "c2"), str(tmp_path / "win"))
    assert spark.read.parquet(str(tmp_path / "win")).agg(F.sum("n"), F.count("*")).first()[:] == (8, 8)
    now = 10**15
    df = spark.createDataFrame([(now - 10**6,), (None,), (now - 40 * 3600 * 10**6,)], "p long").select(S.start_cursor(F.col("p"), F.lit(now)).alias("s"))
    assert [(r.s.start_us, r.s.mode[:5]) for r in df.collect()] == [(now - 13 * 10**6, "PRIOR"), (now - 960 * 10**6, "BASEL"), (now - 960 * 10**6, "BASEL")]
