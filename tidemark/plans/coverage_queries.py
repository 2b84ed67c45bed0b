"""Queries of run coverage, first funders, crossovers, payload readers and batches, with their SQL; stand-ins as in ``registry``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import coverage as K
from tidemark.plans.registry import query, t
from tidemark.sources import posts as P
from tidemark.sources import sinks

GEOS, NETWORKS = ["US", "GB", "JP"], ["eth", "base"]
_SOURCES = ["trends:US", "trends:GB", "trends:JP", "pools:eth", "pools:base", "fees", "tokeninfo:eth:1", "tokeninfo:base:2"]
_HEALTH = f"""h AS (SELECT p_partkey // 8 AS run, ['{"', '".join(_SOURCES)}'][p_partkey % 8 + 1] AS source, p_size > 8 AS ok FROM part),
g AS (SELECT run, count(*) FILTER (ok AND source LIKE 'trends:%') AS n, count(*) FILTER (ok AND source NOT LIKE 'tokeninfo:%') AS base, bool_or(ok AND source = 'pools:eth') AS eth, bool_or(ok AND source = 'pools:base') AS lane_base, count(*) FILTER (NOT ok AND source LIKE 'tokeninfo:%') = 0 AND run % 5 <> 0 AS cand FROM h GROUP BY run),
s AS (SELECT *, CASE WHEN base = 6 AND cand THEN 'COMPLETE' WHEN n >= 2 AND (eth OR lane_base) AND cand THEN 'PARTIAL_USABLE' ELSE 'INSUFFICIENT' END AS coverage_state FROM g)"""


def _states(spark, d):
    p, name = t(spark, d, "part"), F.array(*[F.lit(s) for s in _SOURCES])
    # Every fifth run had one more candidate, of which no row tells.
    run = F.floor(F.col("p_partkey") / 8)
    due = p.select(run.alias("run")).where("run % 5 = 0").select("run", F.lit("eth").alias("network"), F.lit(3).alias("token"))
    return K.coverage_states(p.select(F.floor(F.col("p_partkey") / 8).alias("run"), F.get(name, F.col("p_partkey") % 8).alias("source"), (F.col("p_size") > 8).alias("ok")), GEOS, NETWORKS, candidates=due)


@query(f"""WITH {_HEALTH} SELECT run, n AS attention_sources_ok, n >= 2 AS attention_quorum, concat_ws(',', CASE WHEN lane_base THEN 'base' END, CASE WHEN eth THEN 'eth' END) AS usable_lanes, cand AS candidates_complete, coverage_state,
CASE WHEN run % 7 = 0 THEN 'REVIEW_REQUIRED' WHEN run % 3 > 0 AND NOT cand THEN 'CANDIDATE_COVERAGE_INSUFFICIENT' WHEN coverage_state = 'INSUFFICIENT' THEN 'COVERAGE_INSUFFICIENT' ELSE 'NO_TRADE_OBSERVED_LANES' END AS decision FROM s""")
def run_coverage(spark, d):
    s = _states(spark, d)
    decision = K.run_decision(F.col("run") % 7 == 0, F.col("run") % 3, F.col("candidates_complete"), F.col("coverage_state"))
    return s.withColumns({"usable_lanes": F.array_join("usable_lanes", ","), "decision": decision})


@query(f"""WITH {_HEALTH}, o AS (SELECT DISTINCT p_partkey // 8 AS run, CASE WHEN p_size % 2 = 0 THEN 'eth' ELSE 'base' END AS network FROM part WHERE p_size > 40)
SELECT s.run, w.network, CASE WHEN n < 2 THEN 'UNKNOWN_ATTENTION_COVERAGE' WHEN NOT (CASE WHEN w.network = 'eth' THEN eth ELSE lane_base END) THEN 'UNKNOWN_SOURCE_COVERAGE' WHEN o.run IS NOT NULL THEN 'LEADER_REVIEW' ELSE 'NO_TRADE_OBSERVED' END AS decision
FROM s CROSS JOIN (VALUES ('eth'), ('base')) AS w(network) LEFT JOIN o ON s.run = o.run AND w.network = o.network""")
def lane_decisions(spark, d):
    seen = t(spark, d, "part").where("p_size > 40").select(F.floor(F.col("p_partkey") / 8).alias("run"), F.when(F.col("p_size") % 2 == 0, "eth").otherwise("base").alias("network"))
    return K.lane_decisions(_states(spark, d), seen, NETWORKS)


@query("""WITH s AS (SELECT 'w' || s_suppkey AS wallet, s_suppkey % 7 AS k, s_suppkey AS i, CAST(round(s_acctbal * 100) AS BIGINT) AS lamports FROM supplier)
SELECT wallet, CASE WHEN k = 0 THEN 'RPC_UNVERIFIED' WHEN k = 1 THEN 'HISTORY_TRUNCATED' WHEN k = 2 THEN 'NO_HISTORY' WHEN k = 3 THEN 'EARLIEST_TX_UNDECODABLE' WHEN lamports <= 0 THEN 'EARLIEST_TX_NOT_FUNDING' ELSE 'INDEPENDENT_VERIFIED' END AS state,
CASE WHEN k > 3 AND lamports > 0 THEN 'payer' || i END AS funding_root, CASE WHEN k <> 2 THEN 'sig' || i END AS signature, CASE WHEN k > 3 THEN lamports END AS wallet_delta, CASE WHEN k > 3 AND lamports > 0 THEN lamports + 5 END AS funder_delta FROM s""")
def funding_roots(spark, d):
    s = t(spark, d, "supplier").select(F.col("s_suppkey").alias("i"), (F.col("s_suppkey") % 7).alias("k"), F.round(F.col("s_acctbal") * 100).cast("long").alias("lamports"))
    wallet, sig = F.concat(F.lit("w"), F.col("i")), F.concat(F.lit("sig"), F.col("i"))
    n_pages = F.when(F.col("k") == 1, 5).when(F.col("k") == 2, 1).otherwise(2)
    paged = s.withColumn("page", F.explode(F.sequence(F.lit(1), n_pages))).withColumn("n_rows", F.when(F.col("k") == 2, 0).when((F.col("k") == 1) | (F.col("page") < n_pages), 1000).otherwise(7))
    paged = paged.select(wallet.alias("wallet"), "page", "n_rows", F.when(F.col("n_rows") > 0, F.when(F.col("page") == n_pages, sig).otherwise("newer")).alias("oldest"), F.when((F.col("k") == 0) & (F.col("page") == 2), "timeout").alias("error"))
    key = '{"transaction":{"message":{"accountKeys":[{"pubkey":"payer%d","signer":true},{"pubkey":"w%d","signer":false},"plain"]}},"meta":{"preBalances":[900000000,50,7%s],"postBalances":[%d,%d,7]}}'
    tx = F.format_string(key, "i", "i", F.when(F.col("k") == 3, ",1").otherwise(""), F.lit(900000000 - 5) - F.col("lamports"), F.col("lamports") + 50)
    return K.funding_roots(paged, s.select(sig.alias("signature"), tx.alias("tx")))


@query("""WITH p AS (SELECT event_id, 'object/' || (user_id % 97) AS object_url, ts FROM events), e AS (SELECT * FROM p WHERE event_id % 50 = 0)
SELECT DISTINCT e.event_id AS post_hash, p.event_id AS by_post, p.object_url, p.ts AS published_at FROM e JOIN p ON e.object_url = p.object_url AND e.event_id <> p.event_id AND p.ts BETWEEN e.ts AND e.ts + INTERVAL 48 HOURS""")
def object_crossover(spark, d):
    e = t(spark, d, "events").select(F.col("event_id").alias("post_hash"), F.concat(F.lit("object/"), F.col("user_id") % 97).alias("object_url"), F.col("ts").alias("published_at"))
    return K.object_crossover(e.where("post_hash % 50 = 0"), e.withColumn("linked_object_urls", F.array("object_url", "object_url")))


@query("SELECT CAST(p_partkey AS VARCHAR) AS post_id, p_brand AS actor_id, p_name AS text, CASE WHEN p_size % 4 <> 0 THEN p_size * 120 END AS age_minutes FROM part WHERE p_size % 4 = 0 OR p_size <= 24")
def fresh_videos(spark, d):
    runs = lambda c: F.struct(F.array(F.struct(F.col(c).alias("text"))).alias("runs"))
    ago = F.when(F.col("p_size") % 4 == 0, "Streamed live").otherwise(F.concat(F.col("p_size") * 2, F.lit(" hours ago")))
    video = F.struct(F.col("p_partkey").cast("string").alias("videoId"), runs("p_name").alias("title"), runs("p_brand").alias("ownerText"), F.struct(ago.alias("simpleText")).alias("publishedTimeText"))
    item = F.struct(F.array(F.struct(video.alias("videoRenderer"))).alias("contents"))
    body = F.array(F.struct(item.alias("itemSectionRenderer")))
    for name in ["contents", "sectionListRenderer", "primaryContents", "twoColumnSearchResultsRenderer", "contents"]:
        body = F.struct(body.alias(name))
    return P.fresh_videos(t(spark, d, "part").select(F.to_json(body).alias("body"))).select("post_id", "actor_id", "text", F.col("age_minutes").cast("int").alias("age_minutes"))


@query("SELECT s_suppkey, CASE WHEN s_nationkey % 5 > 0 THEN s_nationkey % 5 - 1 END AS n_trades, CASE WHEN s_nationkey % 5 = 2 THEN s_name END AS next_cursor, CASE WHEN s_nationkey % 5 > 0 THEN s_nationkey % 5 = 2 END AS has_more, CASE WHEN s_nationkey % 5 = 0 THEN 'malformed_trade_page' END AS error FROM supplier")
def trade_pages(spark, d):
    k = F.col("s_nationkey") % 5
    trades = F.when(k > 0, F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit('{"id":1}'), k.cast("int") - 1), ","), F.lit("]"))).otherwise(F.lit('"none"'))
    body = F.concat(F.lit('{"trades":'), trades, F.lit(',"pagination":{"nextCursor":"'), F.when(k == 2, F.col("s_name")).otherwise(""), F.lit('","hasMore":'), F.when(k == 2, "true").otherwise("false"), F.lit("}}"))
    return P.trade_pages(t(spark, d, "supplier").select("s_suppkey", body.alias("body"))).select("s_suppkey", F.when(F.col("trades").isNotNull(), F.size("trades")).alias("n_trades"), "next_cursor", "has_more", "error")


@query("""WITH p AS (SELECT o_custkey % 40 AS window_start, o_orderkey AS ingest_time, o_orderkey % 4 AS n FROM orders), b AS (SELECT window_start, min(ingest_time) AS ingest_time, arg_min(n, ingest_time) AS n FROM p WHERE n > 0 GROUP BY window_start)
SELECT 'feed|sol|swap|' || window_start || '|' || (window_start + 60) AS batch_id, ingest_time, n AS item_count, '[' || array_to_string(list_transform(range(n), lambda i: CAST(ingest_time AS VARCHAR)), ',') || ']' AS payload_json FROM b""")
def raw_batches(spark, d):
    o = t(spark, d, "orders").select(F.lit("feed").alias("source"), F.lit("sol").alias("chain"), F.lit("swap").alias("event_class"), (F.col("o_custkey") % 40).alias("window_start"), F.col("o_orderkey").alias("ingest_time"))
    o = o.withColumns({"window_end": F.col("window_start") + 60, "items": F.array_repeat("ingest_time", (F.col("ingest_time") % 4).cast("int"))})
    return sinks.raw_batches(o).select("batch_id", "ingest_time", F.col("item_count").cast("long").alias("item_count"), "payload_json")
