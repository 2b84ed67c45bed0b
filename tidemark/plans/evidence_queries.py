"""Queries of the envelope functions and evidence operators, with their SQL; stand-ins as in ``registry``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark.functions import envelope as V
from tidemark.functions import fixed
from tidemark.functions import text as X
from tidemark.operators import evidence as E
from tidemark.operators import relational as R
from tidemark.plans.registry import ORACLE_SQL, QUERIES, TRADES, query, t, trades

_STOP = ", ".join(f"'{w}'" for w in fixed.POST_STOP)
_TITLE_STOP = ", ".join(f"'{w}'" for w in fixed.TITLE_STOP)


@query("SELECT event_id, user_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10'")
def future_only(spark, d):
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.future_only(e, "ts", F.lit(datetime(2024, 1, 5)), F.lit(datetime(2024, 1, 10))).select("event_id", "user_id")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 48 HOURS")
def recent_events(spark, d):
    return E.recent(t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", datetime(2024, 1, 30, 12), "48 HOURS").select("event_id")


@query("SELECT doc_id FROM documents WHERE lang = 'en' OR len(regexp_extract_all(coalesce(text, ''), 'https?://[^ \\n]+')) > 0")
def source_presence(spark, d):
    x = t(spark, d, "documents").withColumn("buckets", F.filter(F.array("lang"), lambda x: x == "en")).withColumn("links", F.regexp_extract_all("text", F.lit(r"https?://[^ \n]+"), F.lit(0)))
    return E.with_source_presence(x, "buckets", "links").select("doc_id")


_TARGETS = "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS fetched, o_orderdate FROM orders"


def _targets(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("fetched"), "o_orderdate")
    return E.refresh_targets(o, "fetched", "o_orderdate", "o_orderkey", 18)


@query(f"SELECT o_orderkey FROM ({_TARGETS}) ORDER BY fetched IS NOT NULL, coalesce(fetched, o_orderdate), o_orderdate, o_orderkey LIMIT 18")
def refresh_targets(spark, d):
    return _targets(spark, d)[0].select("o_orderkey")


@query("SELECT count(*) AS seen, count(*) > 18 AS truncated FROM orders")
def truncation_flag(spark, d):
    return _targets(spark, d)[1]


@query("SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 'DEVELOPER_UNVERIFIED' WHEN user_id % 7 = 0 THEN 'DEVELOPER_EXCLUDED' ELSE 'DEVELOPER_CLEAR' END AS state FROM events")
def trade_provenance(spark, d):
    user = F.col("user_id")
    developer = F.when(user % 5 == 0, F.lit(None)).when(user % 7 == 0, F.concat(F.lit("WALLET"), user)).otherwise("dev")
    return t(spark, d, "events").select("event_id", E.provenance(F.concat(F.lit("wallet"), user), developer).alias("state"))


@query(f"""WITH {TRADES}, x AS (SELECT *, wallet = token AND token % 10 > 0 AS own FROM trades), w AS (SELECT token, wallet, count(*) AS n, sum(usd) FILTER (side = 'buy' AND NOT own) AS b, sum(usd) FILTER (side = 'sell' AND NOT own) AS s, bool_or(own) AS seen FROM x GROUP BY 1, 2),
f AS (SELECT token, CAST(sum(n) AS BIGINT) AS trade_count, count(b) AS distinct_buyers, count(s) AS distinct_sellers, coalesce(sum(b), 0) AS buy, coalesce(sum(s), 0) AS sell, CASE WHEN sum(b) <> 0 THEN max(b) / sum(b) END AS share, bool_or(seen) AS developer_seen FROM w GROUP BY 1)
SELECT token, trade_count, distinct_buyers, distinct_sellers, round(buy, 2) AS external_buy_usd, round(sell, 2) AS external_sell_usd, round(share, 6) AS max_buyer_share, developer_seen, CASE WHEN token % 10 = 0 THEN 'DEVELOPER_UNVERIFIED' WHEN distinct_buyers >= 5 AND buy >= 250 AND share <= 0.5 THEN 'ADDRESS_DIVERSE' ELSE 'INSUFFICIENT_DIVERSITY' END AS address_diversity_state FROM f""")
def flow_states(spark, d):
    x = trades(spark, d).withColumn("developer", F.when(F.col("token") % 10 > 0, F.concat(F.lit("0xA"), "token"))).withColumn("wallet", F.concat(F.lit("0xa"), "wallet"))
    return E.flow_states(x).withColumns({c: F.round(c, n) for c, n in (("external_buy_usd", 2), ("external_sell_usd", 2), ("max_buyer_share", 6))})


_LEDGER = f"""WITH RECURSIVE {TRADES}, o AS (SELECT wallet, token, side, usd, row_number() OVER (PARTITION BY wallet, token ORDER BY ts, event_id) AS rn FROM trades),
s(wallet, token, rn, held, cost, bought, sold, pnl) AS (SELECT DISTINCT wallet, token, CAST(0 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM trades
 UNION ALL SELECT s.wallet, s.token, o.rn, CASE WHEN usd <= 0 THEN held WHEN side = 'buy' THEN held + 1 ELSE held - least(1, held) END, CASE WHEN usd <= 0 THEN cost WHEN side = 'buy' THEN cost + usd WHEN held > 0 THEN cost - cost * least(1, held) / held ELSE cost END,
 CASE WHEN usd > 0 AND side = 'buy' THEN bought + 1 ELSE bought END, CASE WHEN usd > 0 AND side = 'sell' THEN sold + least(1, held) ELSE sold END, CASE WHEN usd > 0 AND side = 'sell' AND held > 0 THEN pnl + usd * least(1, held) - cost * least(1, held) / held ELSE pnl END FROM s JOIN o ON o.wallet = s.wallet AND o.token = s.token AND o.rn = s.rn + 1),
ledger AS (SELECT wallet, token, arg_max(bought, rn) AS bought, arg_max(sold, rn) AS sold, round(arg_max(pnl, rn), 6) AS pnl, arg_max(bought, rn) > 0 AND arg_max(sold, rn) / nullif(arg_max(bought, rn), 0) >= 0.5 AS closed FROM s GROUP BY 1, 2)"""
ORACLE_SQL["token_pnl"] = _LEDGER + " SELECT * FROM ledger"
_SCORES = """count(*) AS {0}, count(*) FILTER (pnl > 0) AS {1}, avg(CAST(pnl > 0 AS DOUBLE)) AS win_rate, round(CASE WHEN -sum(least(pnl, 0)) > 0 THEN sum(greatest(pnl, 0)) / -sum(least(pnl, 0)) WHEN sum(greatest(pnl, 0)) > 0 THEN 999.0 ELSE 0.0 END, 6) AS profit_factor,
 round(CASE WHEN sum(greatest(pnl, 0)) > 0 THEN max(greatest(pnl, 0)) / sum(greatest(pnl, 0)) ELSE 1.0 END, 6) AS {2}"""
ORACLE_SQL["wallet_scores"] = _LEDGER + " SELECT wallet, " + _SCORES.format("closed_n", "wins", "top_share") + " FROM ledger WHERE closed GROUP BY 1"


@query(_LEDGER + ", q AS (SELECT wallet, " + _SCORES.format("closed_tokens", "profitable_tokens", "top_winner_share") + """, round(sum(pnl), 6) AS realized_pnl_usd FROM ledger WHERE closed GROUP BY 1)
SELECT *, CASE WHEN closed_tokens >= 3 AND profitable_tokens >= 2 AND win_rate >= 0.6 AND realized_pnl_usd > 0 AND profit_factor >= 1.5 AND top_winner_share <= 0.7 THEN 'QUALIFIED' ELSE 'INSUFFICIENT_PERSISTENCE' END AS state FROM q""")
def wallet_qualification(spark, d):
    out = E.wallet_qualification(QUERIES["token_pnl"](spark, d))
    return out.withColumns({c: F.round(c, 6) for c in ("profit_factor", "top_winner_share", "realized_pnl_usd")})


ORACLE_SQL["launch_coverage"] = """WITH RECURSIVE c AS (SELECT user_id % 5 AS stream, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS cut, min(event_id) AS a, max(event_id) AS b, count(*) FILTER (event_type = 'error') > 1000 AS e FROM events GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY cut) AS rn FROM c),
s(stream, rn, cut, state, boundary) AS (SELECT DISTINCT stream, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), '', CAST(NULL AS BIGINT) FROM c
 UNION ALL SELECT o.stream, o.rn, o.cut, CASE WHEN e THEN 'SOURCE_ERROR' WHEN boundary IS NULL THEN 'BASELINE_ONLY' WHEN a <= boundary AND boundary <= b THEN 'COMPLETE_INTERVAL' ELSE 'GAP' END, CASE WHEN NOT e AND (boundary IS NULL OR (a <= boundary AND boundary <= b)) THEN b ELSE boundary END FROM s JOIN o ON o.stream = s.stream AND o.rn = s.rn + 1)
SELECT stream, cut, state, boundary FROM s WHERE rn > 0"""


@query("""WITH r AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS nth, CASE lang WHEN 'en' THEN 30 WHEN 'fr' THEN 80 WHEN 'de' THEN 100 ELSE 0 END AS cap FROM documents)
SELECT doc_id, lang FROM r WHERE nth <= cap OR lang <> 'en' ORDER BY nth > cap, n_chars DESC, doc_id LIMIT 400""")
def quota_with_refill(spark, d):
    x = t(spark, d, "documents").where(F.col("lang").isNotNull()).select("doc_id", "lang", "n_chars")
    return E.quota_with_refill(x, "lang", {"en": 30, "fr": 80, "de": 100}, [F.desc("n_chars"), F.asc("doc_id")], 400, "en").select("doc_id", "lang")


@query("WITH b AS (SELECT *, first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS base FROM events), m AS (SELECT user_id, ts, value / nullif(base, 0) AS m FROM b) SELECT user_id, min(ts) FILTER (m >= 3) AS t3x, min(ts) FILTER (m >= 5) AS t5x, min(ts) FILTER (m >= 10) AS t10x, min(ts) FILTER (m <= 0.65) AS dd35, max(m) AS high, min(m) AS low FROM m GROUP BY 1")
def crossing_times(spark, d):
    return E.crossing_times(t(spark, d, "events"), "user_id", "ts", "value", "event_id")


@query("SELECT user_id, event_id, CAST(r AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r <= 18")
def snapshot_prune(spark, d):
    return R.top_per_group(t(spark, d, "events"), "user_id", [F.desc("ts"), F.desc("event_id")], 18).select("user_id", "event_id", "rank")


_OWNED = "owned AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_custkey % 3 > 0 AND o_orderstatus <> 'F' THEN 'A_UNPROCESSED' WHEN o_custkey % 3 > 0 THEN 'C_PROCESSED' WHEN o_orderdate >= TIMESTAMP '1998-01-01' - INTERVAL 2 HOURS THEN 'B_UNOWNED_RECENT_LT_2H' ELSE 'D_UNOWNED_OLD_GE_2H' END AS bucket FROM orders)"


@query(f"WITH {_OWNED} SELECT o_orderkey, bucket FROM owned")
def retention_ownership(spark, d):
    key = F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey"))
    done, made = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")), F.col("o_orderdate").cast("timestamp")
    return t(spark, d, "orders").select("o_orderkey", "o_orderpriority", E.retention_bucket(key, done, made, datetime(1998, 1, 1)).alias("bucket")).drop("o_orderpriority")


@query(f"WITH {_OWNED}, g AS (SELECT bucket, count(*) AS rows, CAST(sum(octet_length(encode(o_orderpriority))) AS BIGINT) AS bytes, min(o_orderkey) AS oldest, max(o_orderkey) AS newest FROM owned GROUP BY 1) SELECT CAST(to_json(list(struct_pack(bucket := bucket, rows := rows, bytes := bytes, oldest := oldest, newest := newest) ORDER BY bucket)) AS VARCHAR) AS classification FROM g")
def bucket_census(spark, d):
    x = retention_ownership(spark, d).join(t(spark, d, "orders").select("o_orderkey", F.octet_length("o_orderpriority").cast("long").alias("bytes")), "o_orderkey")
    return E.bucket_census(x, "bucket", "bytes", "o_orderkey")


@query("""WITH p AS (SELECT o_orderkey, o_custkey % 7 = 0 AS first, o_custkey % 3 AS errors, o_orderkey % 4 AS items, o_orderkey % 5 - 2 AS overlap, o_orderkey % 2 = 0 AS complete FROM orders),
s AS (SELECT *, CASE WHEN NOT first AND overlap >= 0 THEN 'OK' WHEN errors > 0 AND items = 0 THEN 'UNKNOWN' ELSE 'PARTIAL' END AS listing, CASE WHEN errors > 0 AND items = 0 THEN 'UNKNOWN' WHEN complete AND NOT first THEN 'OK' ELSE 'PARTIAL' END AS signatures FROM p)
SELECT o_orderkey, listing, first OR listing = 'OK' AS moves, signatures FROM s""")
def poll_states(spark, d):
    first, errors, items, over = F.col("o_custkey") % 7 == 0, F.col("o_custkey") % 3, F.col("o_orderkey") % 4, F.col("o_orderkey") % 5 - 2
    listing = E.listing_poll(first, errors, items, over)
    return t(spark, d, "orders").select("o_orderkey", listing.alias("listing"), E.advances(listing, first).alias("moves"), E.signature_poll(first, errors, items, F.col("o_orderkey") % 2 == 0).alias("signatures"))


@query("""WITH p AS (SELECT o_orderkey, CASE WHEN o_custkey % 4 > 0 THEN o_orderkey END AS cursor, greatest(0, o_orderkey + o_custkey * 10 - 2) AS target FROM orders), s AS (SELECT *, coalesce(cursor + 1, greatest(0, target - 120)) AS start FROM p)
SELECT o_orderkey, start, least(target, start + 1999) AS "end", least(target, start + 1999) >= target AND start <= least(target, start + 1999) AS complete FROM s""")
def block_ranges(spark, d):
    key = F.col("o_orderkey")
    return t(spark, d, "orders").select("o_orderkey", E.block_range(F.when(F.col("o_custkey") % 4 > 0, key), key + F.col("o_custkey") * 10).alias("r")).select("o_orderkey", "r.*")


@query("SELECT CAST(ts AS DATE) AS day, CAST(least(count(*), 300) AS BIGINT) AS kept, CAST(greatest(count(*) - 300, 0) AS BIGINT) AS dropped FROM events GROUP BY 1")
def buffer_gaps(spark, d):
    return E.buffered(t(spark, d, "events").withColumn("day", F.col("ts").cast("date")), "day", [F.col("ts"), F.col("event_id")], 300)[1].select("day", F.col("kept").cast("long").alias("kept"), F.col("dropped").cast("long").alias("dropped"))


@query("""WITH q AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_extendedprice <> 0 THEN l_discount / 2 END AS quoted, l_tax / 4 AS i FROM lineitem WHERE l_extendedprice > 0)
SELECT l_orderkey, l_linenumber, round(quoted, 9) AS quoted_cost, CASE WHEN round(quoted, 9) <= 0.03 AND i <= 0.01 THEN 'ROUTED_QUOTE_PASS' ELSE 'ROUTED_QUOTE_FAIL' END AS state FROM q""")
def route_costs(spark, d):
    price, out = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount") / 2)
    impact = F.col("l_tax") / 4
    r = E.route_state(F.lit(1.0), F.round(out / price, 9), F.lit(None).cast("double"), impact, impact, most=0.0300000001, most_impact=0.01)
    return t(spark, d, "lineitem").where(price > 0).select("l_orderkey", "l_linenumber", r.alias("r")).select("l_orderkey", "l_linenumber", F.round("r.quoted_cost", 9).alias("quoted_cost"), "r.state")


@query("WITH e AS (SELECT source, lang, count(*) AS n, bool_or(n_chars > 1000) AS c FROM documents GROUP BY 1, 2), g AS (SELECT source, count(lang) AS actors, count(*) FILTER (c) AS creative_actors, max(n) / sum(n) AS dominance FROM e GROUP BY 1) SELECT *, actors >= 3 AND creative_actors >= 2 AND dominance <= 0.67 AS passes FROM g")
def premint_gate(spark, d):
    return E.hard_gate(t(spark, d, "documents").withColumn("creative", F.col("n_chars") > 1000), "source", "lang", "creative")


@query("SELECT source, doc_id, c AS is_case FROM (SELECT source, doc_id, coalesce(lang = 'en', false) AS c, row_number() OVER (PARTITION BY source, coalesce(lang = 'en', false) ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS n FROM documents) WHERE n <= 10")
def matched_controls(spark, d):
    x = t(spark, d, "documents").select("source", "doc_id", F.coalesce(F.col("lang") == "en", F.lit(False)).alias("is_case"))
    return E.matched_sample(x, ["source"], "is_case", "doc_id", 10).drop("nth")


@query("WITH g AS (SELECT event_type, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY event_type ORDER BY ts) AS gap FROM events) SELECT event_type, avg(CAST(abs(gap - 1200) <= 600 AS DOUBLE)) AS on_time, round(max(gap), 6) AS longest_gap, avg(CAST(abs(gap - 1200) <= 600 AS DOUBLE)) >= 0.95 AND max(gap) <= 300 AS sound FROM g WHERE gap IS NOT NULL GROUP BY 1")
def operational_tape(spark, d):
    return E.tape_quality(t(spark, d, "events"), "ts", 1200, slack=600, key="event_type").withColumn("longest_gap", F.round("longest_gap", 6))


@query("""WITH c AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY 1), j AS (SELECT c.user_id, c.ts, max(value) FILTER (e.ts <= c.ts + INTERVAL 1 HOUR) AS best_h1, max(value) FILTER (e.ts <= c.ts + INTERVAL 24 HOURS) AS best_h24, max(value) FILTER (e.ts <= c.ts + INTERVAL 7 DAYS) AS best_d7 FROM c JOIN events e ON e.user_id = c.user_id AND e.ts >= c.ts GROUP BY 1, 2)
SELECT user_id, best_h1, best_h24, best_d7, """ + ", ".join(f"CASE WHEN best_{h} >= 100 THEN 'Y100' WHEN best_{h} >= 10 THEN 'Y10' WHEN best_{h} >= 1 THEN 'Y1' WHEN best_{h} IS NOT NULL THEN 'Y0' END AS label_{h}" for h in ("h1", "h24", "d7")) + " FROM j")
def outcome_labels(spark, d):
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    cases = e.groupBy("user_id").agg(F.min("ts").alias("ts"))
    return E.outcome_labels(cases, e, "user_id", "ts", "value", {"h1": "1 HOUR", "h24": "24 HOURS", "d7": "7 DAYS"}, {"Y1": 1, "Y10": 10, "Y100": 100}).drop("ts")


@query("WITH l AS (SELECT user_id, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY 1) SELECT 'max' AS side, user_id, v FROM (SELECT * FROM l ORDER BY v DESC, user_id LIMIT 2) UNION ALL SELECT 'min', user_id, v FROM (SELECT * FROM l ORDER BY v, user_id LIMIT 2)")
def latest_extremes(spark, d):
    last = R.latest_per_key(t(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], ["value"]).select("user_id", F.col("value").alias("v"))
    top, low = (last.orderBy(o, "user_id").limit(2).select(F.lit(s).alias("side"), "user_id", "v") for s, o in (("max", F.desc("v")), ("min", F.asc("v"))))
    return top.unionByName(low)


@query("SELECT DISTINCT p_name FROM part ORDER BY p_name LIMIT 12")
def frozen_cohort(spark, d):
    return t(spark, d, "part").select("p_name").dropDuplicates(["p_name"]).orderBy("p_name").limit(12)


@query("""WITH u AS (SELECT page_id, regexp_replace(url, '#.*$', '') AS u FROM pages), p AS (SELECT page_id, regexp_replace(lower(regexp_extract(u, '^https?://([^/?:]+)', 1)), '^www[.]', '') AS host, rtrim(regexp_replace(regexp_extract(u, '^https?://[^/?]+([^?]*)', 1), '/+', '/', 'g'), '/') AS path, regexp_extract(u, '[?](.*)$', 1) AS q FROM u),
l AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x LIKE '%_=_%' AND lower(split_part(x, '=', 1)) NOT IN (""" + ", ".join(f"'{k}'" for k in fixed.TRACKING_KEYS) + """))) AS pairs FROM p) SELECT page_id, host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(pairs) > 0 THEN '?' || array_to_string(pairs, '&') ELSE '' END AS url FROM l""")
def normalized_urls(spark, d):
    return t(spark, d, "pages").select("page_id", V.normalize_object_url(F.col("url")).alias("url"))


_SHAPES = [("https://twitter.com/someone{0}/status/{0}?s=20", "x.com/status/{0}"), ("http://www.tiktok.com/@a{0}/video/{0}", "tiktok.com/video/{0}"), ("https://youtu.be/v{0}?t=3", "youtube.com/video/v{0}"), ("https://www.youtube.com/watch?list=z&v=w{0}", "youtube.com/video/w{0}"), ("https://old.reddit.com/r/x/comments/{0}/title", "reddit.com/comments/{0}"), ("www.instagram.com/user{0}", None)]


@query("SELECT doc_id, CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN " + (f"'{out.split('{0}')[0]}' || doc_id" if out else "NULL") for i, (_, out) in enumerate(_SHAPES)) + " END AS object FROM documents")
def exact_objects(spark, d):
    url = F.lit(None).cast("string")
    for i, (shape, _) in enumerate(_SHAPES):
        url = F.when(F.col("doc_id") % 6 == i, F.replace(F.lit(shape), F.lit("{0}"), F.col("doc_id").cast("string"))).otherwise(url)
    return t(spark, d, "documents").select("doc_id", V.exact_object_url(url).alias("object"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'reddit.com/comments/' || doc_id WHEN 1 THEN 'youtube.com/video/' || doc_id END AS url FROM documents")
def chosen_urls(spark, d):
    key = F.col("doc_id").cast("string")
    urls = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("reddit.com/r/some"), F.concat(F.lit("reddit.com/comments/"), key))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("youtube.com/@me"), F.lit(None), F.concat(F.lit("youtube.com/video/"), key))).otherwise(F.array(F.lit("x.com/someone"), F.lit("reddit.com/user/me/")))
    source = F.when(F.col("doc_id") % 3 == 0, "reddit_rss:new").when(F.col("doc_id") % 3 == 1, "youtube_search").otherwise("bluesky_jetstream")
    return t(spark, d, "documents").select("doc_id", V.choose_canonical_url(source, urls).alias("url"))


@query(f"SELECT doc_id, array_to_string(list_distinct_in_order[1:24], ' ') AS tokens FROM (SELECT doc_id, list_transform(list_filter(list_transform(range(1, len(w) + 1), lambda i: {{'i': i, 'w': w[i]}}), lambda x: list_position(w, x.w) = x.i), lambda x: x.w) AS list_distinct_in_order FROM (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9][a-z0-9_-]{{2,}}'), lambda x: x NOT IN ({_STOP}) AND NOT regexp_full_match(x, '[0-9]+')) AS w FROM documents))")
def post_tokens(spark, d):
    return t(spark, d, "documents").select("doc_id", F.array_join(V.text_tokens(F.col("text")), " ").alias("tokens"))


@query(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(replace(lower(strip_accents(coalesce(text, ''))), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+'), lambda x: x NOT IN ({_TITLE_STOP}) AND (length(x) >= 3 OR regexp_matches(x, '[^\\x00-\\x7F]'))))), ' ') AS tokens FROM documents")
def title_tokens(spark, d):
    return t(spark, d, "documents").select("doc_id", F.array_join(V.semantic_tokens(V.normalize(F.col("text"))), " ").alias("tokens"))


@query("SELECT doc_id, regexp_matches(coalesce(text, '') || CASE WHEN doc_id % 5 = 0 THEN ' so MemeCoin!' WHEN doc_id % 5 = 1 THEN ' so cryptography!' ELSE ' so launch!' END, '(?i)" + fixed.CRYPTO_TERMS.replace("'", "''") + "') AS crypto FROM documents")
def crypto_posts(spark, d):
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" so "), F.when(F.col("doc_id") % 5 == 0, "MemeCoin").when(F.col("doc_id") % 5 == 1, "cryptography").otherwise("launch"), F.lit("!"))
    return t(spark, d, "documents").select("doc_id", V.is_crypto(said).alias("crypto"))


@query("SELECT o_orderkey, o_orderkey AS block, '0x' || lpad(lower(to_hex(o_orderkey)), 40, '0') AS address FROM orders")
def decoded_logs(spark, d):
    word = F.lpad(F.lower(F.hex("o_orderkey")), 64, "0")
    return t(spark, d, "orders").select("o_orderkey", V.hex_long(F.concat(F.lit("0x"), F.hex("o_orderkey"))).alias("block"), V.word_address(F.concat(F.lit("0x"), word, word), 1).alias("address"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN round(50.0 / (s_acctbal / 2 + 50.0), 9) END AS impact, CASE WHEN s_nationkey <> 0 THEN round(s_acctbal / s_nationkey, 9) END AS ratio FROM supplier")
def pool_impact(spark, d):
    return t(spark, d, "supplier").select("s_suppkey", F.round(X.cpmm_impact(F.lit(fixed.PROBE_USD), F.col("s_acctbal")), 9).alias("impact"), F.round(F.try_divide(F.col("s_acctbal"), F.col("s_nationkey")), 9).alias("ratio"))


@query("""WITH e AS (SELECT DISTINCT p_name AS phrase, string_split(p_name, ' ') AS w FROM part), p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 1) WHEN p_partkey % 3 = 1 THEN p_name ELSE p_name || ' coin' END AS phrase, p_partkey * 60 AS age FROM part), q AS (SELECT *, string_split(phrase, ' ') AS w FROM p),
s AS (SELECT e.phrase AS event_id, p_partkey AS pool_id, CASE WHEN e.phrase = q.phrase THEN 1.0 WHEN len(list_intersect(e.w, q.w)) >= 2 THEN least(0.95, 0.6 + 0.1 * len(list_intersect(e.w, q.w))) WHEN len(list_intersect(e.w, q.w)) = 1 AND length(list_intersect(e.w, q.w)[1]) >= 6 AND (len(e.w) = 1 OR len(q.w) = 1) THEN 0.72 ELSE 0.0 END AS score, age FROM e, q)
SELECT event_id, pool_id, CAST(score AS DOUBLE) AS score FROM s WHERE score >= 0.72 AND age <= 172800""")
def event_pool_matches(spark, d):
    p = t(spark, d, "part")
    name, third = F.col("p_name"), F.col("p_partkey") % 3
    said = F.when(third == 0, F.substring_index(name, " ", 1)).when(third == 1, name).otherwise(F.concat(name, F.lit(" coin")))
    events = p.select(name.alias("event_id")).distinct().select("event_id", F.timestamp_seconds(F.lit(0)).alias("published"), F.col("event_id").alias("phrase"), F.split("event_id", " ").alias("tokens"))
    pools = p.select(F.col("p_partkey").alias("pool_id"), F.timestamp_seconds(F.col("p_partkey") * 60).alias("created"), said.alias("phrase")).withColumn("tokens", F.split("phrase", " "))
    return R.interval_token_join(events, pools)


ORACLE_SQL["canonical_urls"] = ORACLE_SQL["normalized_urls"]
