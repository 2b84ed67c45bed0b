import datetime
import json
import random

from pyspark.sql import functions as F

from tidemark.functions import envelope as V
from tidemark.operators import coverage as K
from tidemark.sources import posts as P
from tidemark.sources import sinks


def bodies(spark, *payloads):
    return spark.createDataFrame([(i, p if isinstance(p, str) or p is None else json.dumps(p)) for i, p in enumerate(payloads)], "i int, body string")


def test_statuses(spark):
    one = {"id": "1", "uri": "u1", "content": '<p>A <b>remix</b> <a href="https://www.tiktok.com/@a/video/12">x</a></p>', "created_at": "2026-01-02T03:04:05Z", "account": {"url": "actor"}, "media_attachments": [{"preview_url": None, "url": "m"}]}
    plain = {"id": "2", "content": "nothing here"}
    again = dict(one, id="3", uri="u3", reblog={"id": "9"})
    nameless = {"content": one["content"]}
    got = P.statuses(bodies(spark, [one, plain, again, nameless], "not json", [], None)).orderBy("rank").collect()
    assert [(r.post_id, r.actor_id, r.rank, r.media) for r in got] == [("u1", "actor", 1, ["m"]), ("u3", "actor", 3, ["m"])]
    assert got[0].text == "A remix x" and len(got[0].links) == 1 and "12" in got[0].links[0] and str(got[0].created_at) == "2026-01-02 03:04:05"
    assert [r.post_id for r in P.statuses(bodies(spark, [one, plain, again]), reblogs=False).collect()] == ["u1"]
    assert [r.post_id for r in P.statuses(bodies(spark, [plain, one]), most=1).collect()] == []


def test_forum_entries(spark):
    rows = [{"id": "Ab1", "author": "me", "created_utc": 1767225600.5, "title": "see https://a.example/x", "selftext": "", "url": "https://reddit.com/comments/ab1"}, {"id": "", "created_utc": 1}, {"id": "c", "created_utc": "soon"}, {"id": "d", "created_utc": 0}]
    got = P.forum_entries(bodies(spark, rows, "{}")).orderBy("post_id").collect()
    assert [(r.post_id, r.object_url, r.raw_links) for r in got] == [("Ab1", "reddit.com/comments/ab1", ["https://a.example/x"]), ("d", "reddit.com/comments/d", [])]
    assert str(got[0].published) == "2026-01-01 00:00:00.500000"


def test_odd_pages(spark):
    got = P.trade_pages(bodies(spark, {"trades": [], "pagination": {}}, {"trades": []}, "", None, {"trades": [{"a": 1}], "pagination": {"next_cursor": "n", "hasMore": True}})).orderBy("i").collect()
    assert [(r.trades, r.next_cursor, r.has_more, r.error) for r in got] == [([], None, False, None), *[(None, None, None, "malformed_trade_page")] * 3, (['{"a":1}'], "n", True, None)]
    assert P.fresh_videos(bodies(spark, {}, "x", None, {"contents": {"twoColumnSearchResultsRenderer": {"primaryContents": {"sectionListRenderer": {"contents": [{}, {"itemSectionRenderer": {"contents": [{"adSlot": 1}]}}]}}}}})).count() == 0
    landing = spark.createDataFrame([(1, "b", 200, 0.5, None), (2, None, 503, 0.25, "HTTP 503"), (3, None, None, None, "timeout"), (4, "b", 404, 0.1, None)], "i int, body string, code int, s double, e string")
    assert [r.ok for r in P.fetched(landing, "code", "s", "e").orderBy("i").collect()] == [True, False, False, False]


def test_funding_edges(spark):
    tx = lambda keys, pre, post: json.dumps({"transaction": {"message": {"accountKeys": keys}}, "meta": {"preBalances": pre, "postBalances": post}})
    signer = lambda k: {"pubkey": k, "signer": True}
    txs = [("a", tx([signer("x"), signer("y"), "w0"], [100, 100, 0], [60, 60, 70])), ("b", tx(["x", "w1"], [100, 0], [60, 40])), ("c", "broken"), ("d", tx([signer("x"), "other"], [9, 0], [0, 9]))]
    pages = [("w0", 1, 3, "a", None), ("w1", 1, 3, "b", None), ("w2", 1, 3, "c", None), ("w3", 1, 3, "d", None), ("w4", 1, 3, "missing", None), ("w5", 1, 1000, "z", None), ("w6", 1, 1000, "a", None), ("w6", 2, 0, None, None)]
    got = {r.wallet: r for r in K.funding_roots(spark.createDataFrame(pages, "wallet string, page int, n_rows int, oldest string, error string"), spark.createDataFrame(txs, "signature string, tx string")).collect()}
    assert (got["w0"].state, got["w0"].funding_root, got["w0"].wallet_delta, got["w0"].funder_delta) == ("INDEPENDENT_VERIFIED", "y", 70, 40)  # a tie goes to the greater key
    states = {"w1": "EARLIEST_TX_NOT_FUNDING", "w2": "EARLIEST_TX_UNDECODABLE", "w3": "EARLIEST_TX_UNDECODABLE", "w4": "EARLIEST_TX_UNDECODABLE", "w5": "RPC_UNVERIFIED", "w6": "EARLIEST_TX_UNDECODABLE"}
    assert {k: got[k].state for k in states} == states and got["w6"].signature == "a"


def test_coverage_gaps(spark):
    health = spark.createDataFrame([(1, "trends:A", True), (1, "trends:B", True), (1, "pools:x", True), (1, "fees", True), (2, "trends:A", True), (2, "trends:A", False), (2, "trends:B", None), (3, "trends:A", True), (3, "trends:B", True), (3, "pools:x", True), (3, "tokeninfo:x:1", False)], "run int, source string, ok boolean")
    s = K.coverage_states(health, ["A", "B"], ["x"])
    got = {r.run: (r.coverage_state, r.attention_sources_ok) for r in s.collect()}
    assert got == {1: ("COMPLETE", 2), 2: ("INSUFFICIENT", 0), 3: ("INSUFFICIENT", 2)}
    lanes = {(r.run, r.network): r.decision for r in K.lane_decisions(s, spark.createDataFrame([(1, "x"), (1, "x")], "run int, network string"), ["x", "y"]).collect()}
    assert lanes == {(1, "x"): "LEADER_REVIEW", (1, "y"): "UNKNOWN_SOURCE_COVERAGE", (2, "x"): "UNKNOWN_ATTENTION_COVERAGE", (2, "y"): "UNKNOWN_ATTENTION_COVERAGE", (3, "x"): "NO_TRADE_OBSERVED", (3, "y"): "UNKNOWN_SOURCE_COVERAGE"}


def test_crossover_and_hint(spark):
    e = spark.createDataFrame([("a", "o", 100), ("b", None, 100)], "post_hash string, object_url string, at long").withColumn("published_at", F.timestamp_seconds("at")).drop("at")
    posts = spark.createDataFrame([("a", ["o"], 100), ("p", ["o", "o", None], 200), ("early", ["o"], 99), ("late", ["o"], 200000), ("none", None, 200)], "post_hash string, linked_object_urls array<string>, at long").withColumn("published_at", F.timestamp_seconds("at")).drop("at")
    assert [(r.post_hash, r.by_post) for r in K.object_crossover(e, posts).collect()] == [("a", "p")]
    hint = lambda a, b: K.semantic_hint(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)), ["token"])
    assert list(spark.range(1).select(hint("cat dog token".split(), "cat dog".split()), hint("cat token".split(), "cat token".split())).first()) == [True, False]


def test_crossover_holds_spans_not_pairs(spark):
    """Repeated envelopes, overlapping and apart, and repeated posts: distinct pairs without a shuffle of the pairs."""
    rng = random.Random(2)
    e = [(f"e{rng.randrange(6)}", f"o{rng.randrange(2)}", rng.randrange(900_000)) for _ in range(60)]
    p = [(rng.choice([f"p{rng.randrange(40)}", f"e{rng.randrange(6)}"]), [f"o{rng.randrange(2)}"] * 2, rng.randrange(900_000)) for _ in range(300)]
    p += [(f"edge{k}", [o], at + d) for k, (_, o, at) in enumerate(e[:5]) for d in (0, 172_800, 172_801, -1)]
    for kind in ("timestamp", "timestamp_ntz"):
        timed = lambda rows, c: spark.createDataFrame(rows, f"post_hash string, {c}, at long").withColumn("published_at", F.timestamp_seconds("at").cast(kind)).drop("at")  # noqa: B023, E731
        out = K.object_crossover(timed(e, "object_url string"), timed(p, "linked_object_urls array<string>"))
        got = [(r.post_hash, r.by_post, r.object_url, int(r.published_at.replace(tzinfo=datetime.timezone.utc).timestamp())) for r in out.withColumn("published_at", F.col("published_at").cast("timestamp_ntz")).collect()]
        want = {(h, b, o, t) for h, o, at in e for b, (link, _), t in ((b, (x * 2)[:2], t) for b, x, t in p) if link == o and b != h and at <= t <= at + 172_800}
        assert len(got) == len(set(got)) and set(got) == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan.split("Join")[0]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    path = str(tmp_path / "t")
    for df in (rows, rows, spark.createDataFrame([("b", 9), ("c", 3)], "k string, v int")):
        sinks.append_new(df, path, ["k"])
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", 1), ("b", 2), ("c", 3)]
    df, seen = sinks.with_usage(rows, "usage")
    sinks.write_snapshot(df, str(tmp_path / "s"))
    sinks.write_snapshot(rows, str(tmp_path / "s"))
    assert seen.get == {"rows": 2} and spark.read.json(str(tmp_path / "s")).count() == 2


def test_a_candidate_that_was_never_asked_is_a_gap(spark):
    base = ["trends:A", "trends:B", "pools:x", "fees"]
    health = spark.createDataFrame([(r, s, True) for r in (1, 2, 3, 4) for s in base] + [(1, "tokeninfo:x:7", True), (2, "tokeninfo:x:7", False), (4, "tokeninfo:x:7", True)], "run int, source string, ok boolean")
    due = spark.createDataFrame([(1, "x", "7"), (2, "x", "7"), (3, "x", "7"), (4, "x", "7"), (4, "x", "8"), (5, "x", "9")], "run int, network string, token string")
    got = {r.run: (r.coverage_state, r.candidates_complete) for r in K.coverage_states(health, ["A", "B"], ["x"], candidates=due).collect()}
    assert got == {1: ("COMPLETE", True), 2: ("INSUFFICIENT", False), 3: ("INSUFFICIENT", False), 4: ("INSUFFICIENT", False), 5: ("INSUFFICIENT", False)}


def test_a_bad_payload_is_a_gap_beside_good_ones(spark):
    df = spark.createDataFrame([("0x1F", '{"b":1, "a":2}'), ("0x8000000000000000", "{bad"), ("0x7fffffffffffffff", None), ("zz", '{"a":2,"b":1}'), ("0x" + "f" * 64, "[" * 100_000), (None, ""), ("0x" + "0" * 60 + "ff", "1")], "x string, p string").coalesce(1)
    got = df.select(V.hex_long(F.col("x")).alias("n"), V.hex_decimal(F.col("x")).alias("d"), V.canonical_json_hash(F.col("p")).alias("h")).collect()
    assert [r.n for r in got] == [31, None, 2**63 - 1, None, None, 0, 255]
    assert [None if r.d is None else int(r.d) for r in got] == [31, 2**63, 2**63 - 1, None, None, None, 255]
    assert got[0].h == got[3].h is not None and [r.h for r in got[1:3]] == [None, None] and got[4].h is None and got[6].h is not None
