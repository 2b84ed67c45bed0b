"""Envelope functions and evidence operators on rows written out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import envelope as V
from tidemark.operators import evidence as E
from tidemark.operators import relational as R


def each(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_object_urls(spark):
    urls = {
        "https://twitter.com/a/status/12?s=20": "x.com/status/12", "http://vm.tiktok.com/@a/video/7": "tiktok.com/video/7", "https://youtu.be/abc?t=1": "youtube.com/video/abc", "youtube.com/watch?v=q&list=z": "youtube.com/video/q",
        "https://youtube.com/shorts/zz/x": "youtube.com/video/zz", "https://www.reddit.com/r/x/comments/AbC/t/": "reddit.com/comments/abc", "https://instagram.com/Reel/Xy/": "instagram.com/reel/Xy", "https://www.Ex.com//a//b/?utm_source=q&b=2&a=1&ref=z#f": "ex.com/a/b?a=1&b=2",
        "https://ex.com": "ex.com/", "https://ex.com/?q=a%20b&amp;r=": "ex.com/?q=a+b", "": None, None: None,
    }
    assert each(spark, list(urls), V.normalize_object_url) == list(urls.values())
    assert each(spark, ["https://x.com/a", "https://old.reddit.com/r/a/comments/z1/", "https://youtube.com/@me", "https://x.com/a/status/5).", None], V.exact_object_url) == [None, "reddit.com/comments/z1", None, "x.com/status/5", None]


def test_post_text(spark):
    assert each(spark, ["see https://a.b/c mail me@x.org or +1 555-123-4567 @you.x  now", None, "z" * 600], V.clean_text) == ["see mail [redacted-email] or [redacted-phone] [mention] now", "", "z" * 500]
    assert each(spark, ["The 2024 Cat-video cat_video of 2024x and cat-video ab", None], V.text_tokens) == [["cat-video", "cat_video", "2024x"], []]
    assert each(spark, ["Straße Çédille_x", "日本 a1 The fc"], lambda c: V.semantic_tokens(V.normalize(c))) == [["cedille", "strasse"], ["日本"]]
    assert each(spark, ["<p>a &amp;<br>b</p>", None], V.html_to_text) == ["a & b", ""]
    assert each(spark, [["see https://x.com/a, and https://evil.com/b", "https://youtu.be/q).", None]], V.allowed_links, "array<string>") == [["https://x.com/a", "https://youtu.be/q"]]
    assert each(spark, [json.dumps({"a": {"url": "u1", "n": 3}, "b": [{"href": "u2"}, "http://no"], "c": "http://u3"}), "no json", None], V.recursive_urls) == [["u1", "u2", "http://u3"], [], []]
    one, two = each(spark, ['{"b": 1, "a": [1, 2]}', '{"a":[1,2],"b":1}'], V.canonical_json_hash)
    assert one == two


@pytest.mark.parametrize("source, urls, want", [("reddit_rss:new", ["reddit.com/r/a", "redd.it/z"], "redd.it/z"), ("reddit_rss", ["reddit.com/r/a"], "reddit.com/r/a"), ("tiktok_cc", ["ex.com/", "tiktok.com/tag/a"], "tiktok.com/tag/a"), ("mastodon_public", ["x.com/a", "ex.com/q"], "ex.com/q"), ("other", ["x.com/a", "youtube.com/@b"], None), (None, [], None)])
def test_chosen_urls(spark, source, urls, want):
    df = spark.createDataFrame([(source, urls)], "s string, u array<string>")
    assert df.select(V.choose_canonical_url(F.col("s"), F.col("u"))).first()[0] == want


def test_ledger_skips_trades_of_nothing(spark):
    df = spark.createDataFrame([("w", "t", 1, "buy", 0.0, 10.0), ("w", "t", 2, "buy", 10.0, 100.0), ("w", "t", 3, "sell", 10.0, 110.0)], "wallet string, token string, ts int, side string, amount double, usd double")
    r = R.average_cost(df, ["wallet", "token"], "ts", "ts", "side", "amount", "usd").first()
    assert (r.pnl, r.bought, r.closed) == (10.0, 10.0, True)


def test_qualification_needs_persistence(spark):
    rows = [("a", 80.0, True), ("a", 50.0, True), ("a", -50.0, True), ("b", 900.0, True), ("b", 1.0, True), ("b", 1.0, True), ("c", 5.0, False)]
    got = {r.wallet: (r.state, r.realized_pnl_usd) for r in E.wallet_qualification(spark.createDataFrame(rows, "wallet string, pnl double, closed boolean")).collect()}
    assert got == {"a": ("QUALIFIED", 80.0), "b": ("INSUFFICIENT_PERSISTENCE", 902.0)}


def test_flow_without_the_developer(spark):
    rows = [("t", f"w{i}", "buy", 60.0, "0xDE") for i in range(5)] + [("t", "0xde", "buy", 9e9, "0xDE"), ("t", "w1", "sell", None, "0xDE"), ("u", "w", "buy", 1.0, None)]
    got = {r.token: r for r in E.flow_states(spark.createDataFrame(rows, "token string, wallet string, side string, usd double, developer string")).collect()}
    assert (got["t"].address_diversity_state, got["t"].external_buy_usd, got["t"].max_buyer_share, got["t"].developer_seen, got["t"].distinct_sellers) == ("ADDRESS_DIVERSE", 300.0, 0.2, True, 1)
    assert got["u"].address_diversity_state == "DEVELOPER_UNVERIFIED"


def test_converters(spark):
    trade = lambda i, **a: {"id": i, "attributes": a}
    page = {"data": [trade("1", kind="Buy", tx_from_address="w", block_timestamp="2024", to_token_address="0xAB", to_token_amount="2", volume_in_usd="5", price_to_in_usd="2.5"), trade("2", kind="sell", tx_from_address="w", block_timestamp="2024", from_token_address="other", from_token_amount="2", volume_in_usd="5"), trade("3", kind="buy", tx_from_address="w", block_timestamp="2024", to_token_address="0xab", to_token_amount="0", volume_in_usd="5")]}
    got = E.wallet_trades(spark.createDataFrame([("eth", "p", "eth_0xab", None, json.dumps(page))], "network string, pool_id string, token_id string, developer string, payload string")).collect()
    assert [(r.trade_id, r.kind, r.token_amount, r.usd_value, r.token_price_usd) for r in got] == [("1", "buy", 2.0, 5.0, 2.5)]
    info = {"data": {"attributes": {"holders": {"count": 7, "distribution_percentage": {"top_10": "91.5"}}}}}
    r = E.token_info(spark.createDataFrame([(json.dumps(info),), ("{}",)], "payload string")).collect()
    assert (r[0].holders_count, r[0].top10_pct, r[0].honeypot) == (7, 91.5, "unknown") and r[1].holders_count is None
    commit = {"collection": "app.bsky.feed.post", "operation": "create", "rkey": "k", "record": {"text": "hi"}}
    events = [{"kind": "commit", "did": "d", "commit": commit}, {"$type": "message", "payload": {"$type": "x#commit", "did": "e", **commit}}, {"$type": "x#commit", "did": "f", **commit}, {"kind": "commit", "did": "g", "commit": commit | {"operation": "delete"}}, {"kind": "identity"}]
    got = E.feed_commits(spark.createDataFrame([(json.dumps(e),) for e in events], "payload string")).collect()
    assert sorted((r.did, r.post_id, r.text) for r in got) == [(x, f"at://{x}/app.bsky.feed.post/k", "hi") for x in "def"]


def test_logs_and_routes(spark):
    row = spark.range(1).select(V.topic_address(F.lit("0x" + "0" * 24 + "AB" * 20)).alias("a"), V.word_address(F.lit("0x12"), 0).alias("b"), V.hex_long(F.lit(None).cast("string")).alias("c"), E.gas_route_state(F.lit(100.0), F.lit(98.0), F.lit(0.25)).alias("r"), E.route_state(F.lit(100.0), F.lit(98.0), F.lit(90.0), F.lit(0.01), F.lit(None).cast("double")).alias("s")).first()
    assert (row.a, row.b, row.c, row.r.state, row.s.state) == ("0x" + "ab" * 20, None, 0, "ROUTED_QUOTE_PASS", "ROUTED_QUOTE_FAIL")
    assert round(row.r.quoted_cost, 9) == 0.025 and round(row.r.worst_cost, 9) == 0.085 and round(row.s.worst_cost, 9) == 0.1
