"""Queries by name over the driver's tables (which stand in for the feeds), each with the SQL that gives the same rows.

Stand-ins: a part is a launch (mint), its type words are the family tokens; line items are its fee observations; events
are trades (purchase buys, click sells); documents are posts and ``source`` is their surface."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import envelope as V
from tidemark.functions import text as X
from tidemark.operators import consensus as C
from tidemark.operators import evidence as E
from tidemark.operators import near as N
from tidemark.operators import relational as R
from tidemark.shared import new_folder
from tidemark.streaming import capture as S

FLAGSHIP = "family_lane"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def trades(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").where(F.col("event_type").isin("purchase", "click"))
    return e.select("event_id", "ts", (F.col("user_id") % 50).alias("token"), F.col("user_id").alias("wallet"), F.when(F.col("event_type") == "purchase", "buy").otherwise("sell").alias("side"), F.col("value").alias("usd"))


TRADES = "trades AS (SELECT event_id, ts, user_id % 50 AS token, user_id AS wallet, CASE WHEN event_type = 'purchase' THEN 'buy' ELSE 'sell' END AS side, value AS usd FROM events WHERE event_type IN ('purchase', 'click'))"

_LANE = """WITH births AS (SELECT p_partkey AS mint, p_name AS name, p_brand AS symbol, TIMESTAMP '2026-01-01' + to_seconds(p_partkey) AS created_at, p_size > 20 AS identity, p_size > 45 AS external, p_partkey % 97 = 0 AS backfill, string_split(p_type, ' ') AS tokens FROM part),
fees AS (SELECT l_partkey AS mint, arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber)) AS fee FROM lineitem WHERE l_quantity > 5 GROUP BY 1),
ex AS (SELECT b.*, fee, coalesce(fee, 0.0) AS f, unnest(list_distinct(list_concat(tokens, [symbol]))) AS family_key FROM births b LEFT JOIN fees USING (mint)),
agg AS (SELECT family_key, count(*) AS births, count(DISTINCT lower(name)) AS unique_names, count(DISTINCT lower(symbol)) AS unique_symbols, count(*) FILTER (identity) AS identity_n, count(*) FILTER (external) AS external_n, max(f) AS leader_fee, list(f ORDER BY f DESC)[2] AS second_fee,
 round(sum(f), 2) AS total_fee, count(*) FILTER (f >= 5000) AS n5, count(*) FILTER (fee < 1000) AS nlt1, first(mint ORDER BY f DESC, created_at, mint) AS leader_mint, bool_or(backfill) AS backfill_contaminated FROM ex GROUP BY 1 HAVING count(*) >= 3),
lane AS (SELECT *, CASE WHEN family_key IN ('Brand#11') THEN 'VETO' WHEN births >= 4 AND leader_fee >= 10000 AND unique_names / births >= 0.55 AND identity_n / births >= 0.5 AND second_fee >= 1000 AND (external_n >= 1 OR leader_fee >= 25000) THEN 'FAMILY_EXPANSION_STRONG'
 WHEN births >= 3 AND leader_fee >= 5000 AND unique_names / births >= 0.45 AND identity_n / births >= 0.35 THEN 'FAMILY_EXPANSION_WATCH' WHEN births >= 5 AND unique_names / births < 0.35 THEN 'COPY_SPAM_VETO' ELSE 'SHADOW' END AS lane_state FROM agg)"""


@query(_LANE + " SELECT * FROM lane")
def family_lane(spark, d):
    births = t(spark, d, "part").select(
        F.col("p_partkey").alias("mint"), F.col("p_name").alias("name"), F.col("p_brand").alias("symbol"), F.timestamp_seconds(F.lit(1767225600) + F.col("p_partkey")).alias("created_at"), (F.col("p_size") > 20).alias("identity"), (F.col("p_size") > 45).alias("external"), (F.col("p_partkey") % 97 == 0).alias("backfill"),
        F.array_distinct(F.concat(F.split("p_type", " "), F.array("p_brand"))).alias("tokens"),
    )
    econ = t(spark, d, "lineitem").where(F.col("l_quantity") > 5).select(F.col("l_partkey").alias("mint"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("observed_at"), F.col("l_extendedprice").alias("fee"))
    return R.family_lane(births, econ, ["Brand#11"]).withColumn("total_fee", F.round("total_fee", 2))


@query(_LANE + " SELECT lane_state, count(*) AS n FROM lane GROUP BY 1")
def family_lane_states(spark, d):
    return family_lane(spark, d).groupBy("lane_state").agg(F.count("*").alias("n"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def latest_per_key(spark, d):
    return R.latest_per_key(t(spark, d, "events"), "user_id", [F.col("ts"), F.col("event_id")], ["event_id", "event_type"])


@query("SELECT source, doc_id, CAST(r AS INT) AS rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 3")
def top_per_group(spark, d):
    return R.top_per_group(t(spark, d, "documents"), "source", [F.desc("n_chars"), F.asc("doc_id")], 3).select("source", "doc_id", "rank")


@query("""WITH a AS (SELECT doc_id, source, lang = 'en' AS linked, row_number() OVER (PARTITION BY source, lang = 'en' ORDER BY doc_id DESC) AS r FROM documents),
b AS (SELECT *, CASE WHEN linked AND r <= 6 THEN 0 WHEN NOT linked AND r <= 4 THEN 1 ELSE 2 END AS tier FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY tier, doc_id DESC) AS n FROM b) SELECT doc_id, source, linked FROM c WHERE n <= 10""")
def two_level_quota(spark, d):
    return R.two_level_quota(t(spark, d, "documents").select("doc_id", "source", (F.col("lang") == "en").alias("linked")), "source", "linked", [F.desc("doc_id")], 10)


@query(f"WITH {TRADES}, w AS (SELECT token, wallet, sum(usd) FILTER (side = 'buy') AS b, sum(usd) FILTER (side = 'sell') AS s FROM trades GROUP BY 1, 2) SELECT token, count(b) AS buyers, count(s) AS sellers, round(coalesce(sum(b), 0.0), 2) AS buy_usd, round(coalesce(sum(s), 0.0), 2) AS sell_usd, round(max(b) / sum(b), 6) AS max_buyer_share FROM w GROUP BY 1")
def trade_flow(spark, d):
    return R.trade_flow(trades(spark, d), "token", "wallet", "side", "usd").select("token", "buyers", "sellers", F.round("buy_usd", 2).alias("buy_usd"), F.round("sell_usd", 2).alias("sell_usd"), F.round("max_buyer_share", 6).alias("max_buyer_share"))


@query()
def token_pnl(spark, d):
    return R.average_cost(trades(spark, d).withColumn("amount", F.lit(1.0)), ["wallet", "token"], "ts", "event_id", "side", "amount", "usd").withColumn("pnl", F.round("pnl", 6))


@query()
def wallet_scores(spark, d):
    out = R.wallet_scores(token_pnl(spark, d), "wallet")
    return out.withColumns({c: F.round(c, 6) for c in ("profit_factor", "top_share")})


@query("SELECT event_type, median(value) AS med, quantile_disc(value, 0.9) AS p90, max(value) AS top, avg(CAST(value <= 10 AS DOUBLE)) AS recall_10 FROM events GROUP BY 1")
def quantiles(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.median("value").alias("med"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY value)").alias("p90"), F.max("value").alias("top"), F.avg((F.col("value") <= 10).cast("double")).alias("recall_10"))


@query("SELECT event_type, CASE WHEN epoch(max(ts)) > epoch(min(ts)) THEN round(60.0 * (count(*) - 1) / (epoch(max(ts)) - epoch(min(ts))), 9) END AS per_minute FROM events GROUP BY 1")
def birth_rate(spark, d):
    e = t(spark, d, "events").select("event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("s"))
    span = F.max("s") - F.min("s")
    return e.groupBy("event_type").agg(F.when(span > 0, F.round(60.0 * (F.count("*") - 1) / span, 9)).alias("per_minute"))


@query("SELECT source, count(*) AS items, count(DISTINCT lang) AS langs, count(*) FILTER (n_chars > 1000) AS long_n FROM documents GROUP BY 1")
def source_counts(spark, d):
    return t(spark, d, "documents").groupBy("source").agg(F.count("*").alias("items"), F.countDistinct("lang").alias("langs"), F.count_if(F.col("n_chars") > 1000).alias("long_n"))


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY 1 HAVING count(DISTINCT user_id) >= 2")
def multi_member_sets(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users")).where(F.col("users") >= 2)


@query("WITH w AS (SELECT user_id, min(ts) AS first FROM events GROUP BY 1) SELECT e.user_id, count(*) AS n, round(sum(value), 2) AS gross FROM events e JOIN w USING (user_id) WHERE epoch(e.ts) < epoch(w.first) + 86400 GROUP BY 1")
def first_window_turnover(spark, d):
    e = t(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    e = e.withColumn("first", F.min("us").over(Window.partitionBy("user_id"))).where(F.col("us") < F.col("first") + 86_400_000_000)
    return e.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("gross"))


@query("WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), s AS (SELECT source, n / sum(n) OVER (PARTITION BY source) AS p FROM c) SELECT source, round(-sum(p * log2(p)), 9) AS entropy, max(p) AS dominance FROM s GROUP BY 1")
def entropy(spark, d):
    c = t(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n")).withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("source")))
    return c.groupBy("source").agg(F.round(-F.sum(F.col("p") * F.log2("p")), 9).alias("entropy"), F.max("p").alias("dominance"))


@query("WITH e AS (SELECT *, first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS base FROM events) SELECT user_id, min(ts) FILTER (value >= 3 * base) AS t3, min(ts) FILTER (value <= 0.65 * base) AS dd35, CASE WHEN min(ts) FILTER (value >= 3 * base) = min(ts) FILTER (value <= 0.65 * base) THEN 'ORDER_AMBIGUOUS' WHEN min(ts) FILTER (value >= 3 * base) IS NULL AND min(ts) FILTER (value <= 0.65 * base) IS NULL THEN 'OPEN' WHEN min(ts) FILTER (value <= 0.65 * base) IS NULL OR min(ts) FILTER (value >= 3 * base) < min(ts) FILTER (value <= 0.65 * base) THEN 'WIN_3X' ELSE 'DRAWDOWN' END AS outcome FROM e GROUP BY 1")
def first_crossings(spark, d):
    e = t(spark, d, "events")
    e = e.join(e.groupBy("user_id").agg(F.min_by("value", F.struct("ts", "event_id")).alias("base")), "user_id")
    g = e.groupBy("user_id").agg(F.min(F.when(F.col("value") >= 3 * F.col("base"), F.col("ts"))).alias("t3"), F.min(F.when(F.col("value") <= 0.65 * F.col("base"), F.col("ts"))).alias("dd35"))
    a, b = F.col("t3"), F.col("dd35")
    return g.withColumn("outcome", F.when(a == b, "ORDER_AMBIGUOUS").when(a.isNull() & b.isNull(), "OPEN").when(b.isNull() | (a < b), "WIN_3X").otherwise("DRAWDOWN"))


@query("SELECT event_id, user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS delta FROM events")
def checkpoint_delta(spark, d):
    return t(spark, d, "events").select("event_id", "user_id", (F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).alias("delta"))


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)")
def new_rows_only(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders").where(F.col("o_totalprice") > 450000), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def prior_qualified(spark, d):
    o = t(spark, d, "orders").where(F.col("o_totalprice") > 200000)
    return t(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 6 AS lane FROM events")
def round_robin(spark, d):
    return E.round_robin(t(spark, d, "events"), ["user_id"], [F.col("ts"), F.col("event_id")], 6).select("event_id", F.col("lane").cast("long").alias("lane"))


@query("SELECT l_partkey, greatest(l_quantity, 0) / nullif(sum(greatest(l_quantity, 0)) OVER (PARTITION BY l_partkey), 0) AS share, l_orderkey, l_linenumber FROM lineitem")
def family_shares(spark, d):
    q = F.greatest("l_quantity", F.lit(0.0))
    total = F.sum(q).over(Window.partitionBy("l_partkey"))
    return t(spark, d, "lineitem").select("l_partkey", F.when(total > 0, q / total).otherwise(0.0).alias("share"), "l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, CASE WHEN o_totalprice IS NULL THEN 'D' WHEN o_orderstatus = 'F' AND c_custkey IS NOT NULL THEN 'A' WHEN o_orderstatus = 'O' THEN 'B' WHEN c_custkey IS NULL THEN 'C' ELSE 'D' END AS bucket FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def retention_buckets(spark, d):
    o = t(spark, d, "orders").join(t(spark, d, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    b = F.when(F.col("o_totalprice").isNull(), "D").when((F.col("o_orderstatus") == "F") & F.col("c_custkey").isNotNull(), "A").when(F.col("o_orderstatus") == "O", "B").when(F.col("c_custkey").isNull(), "C").otherwise("D")
    return o.select("o_orderkey", b.alias("bucket"))


@query("SELECT count(*) >= 30 AS tripped FROM (SELECT 1 FROM orders WHERE o_orderstatus = 'O' LIMIT 30)")
def backlog_guard(spark, d):
    return t(spark, d, "orders").where(F.col("o_orderstatus") == "O").limit(30).agg((F.count("*") >= 30).alias("tripped"))


@query("SELECT s_suppkey, round(1.4 * ln(1 + greatest(s_acctbal, 0)) + ln(1 + s_suppkey) + 0.4 * ln(1 + 7) + 5.0 / 7 + 0.8 * ln(1 + s_nationkey) + 0.5 * ln(1 + 3), 6) AS score FROM supplier")
def leader_score(spark, d):
    one = lambda n: F.lit(float(n))
    return t(spark, d, "supplier").select("s_suppkey", X.leader_score(F.col("s_acctbal"), F.col("s_suppkey"), one(5), one(2), F.col("s_nationkey"), one(3)).alias("score"))


@query("SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{3,}'))) AS n FROM documents")
def distinct_tokens(spark, d):
    f = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{3,}"), F.lit(0)))
    return t(spark, d, "documents").select("doc_id", F.size(f).cast("long").alias("n"))


@query()
def redacted_text(spark, d):
    return t(spark, d, "documents").select("doc_id", V.clean_text(F.col("text"), None).alias("text"))


@query()
def canonical_urls(spark, d):
    return t(spark, d, "pages").select("page_id", V.normalize_object_url(F.col("url")).alias("url"))


@query()
def simhash_near(spark, d):
    return N.near_texts(t(spark, d, "documents"), "doc_id", "text")


@query()
def image_near(spark, d):
    return N.near_images(t(spark, d, "embeddings"), "vec_id", "embedding", 8)


@query()
def launch_coverage(spark, d):
    e = t(spark, d, "events")
    cuts = e.groupBy(F.pmod(F.col("user_id"), F.lit(5)).alias("stream"), F.unix_date(F.col("ts").cast("date")).cast("long").alias("cut")).agg(F.min("event_id").alias("oldest"), F.max("event_id").alias("newest"), (F.count_if(F.col("event_type") == "error") > 1000).alias("error"))
    return R.launch_coverage(cuts, "stream", "cut", "oldest", "newest", "error")


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderpriority, o_orderstatus)")
def cube_totals(spark, d):
    return t(spark, d, "orders").cube("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"""WITH {TRADES}, able AS (SELECT wallet FROM trades WHERE side = 'buy' GROUP BY 1 HAVING min(ts) < (SELECT max(ts) FROM events) - INTERVAL 1 DAY),
each AS (SELECT token, wallet, sum(usd) AS usd FROM trades SEMI JOIN able USING (wallet) WHERE side = 'buy' GROUP BY 1, 2),
flow AS (SELECT token, count(*) AS wallets, count(CASE WHEN wallet % 5 > 0 THEN 1 END) AS verified, count(DISTINCT CASE WHEN wallet % 5 > 0 THEN wallet % 7 END) AS roots, max(usd) / nullif(sum(usd), 0) AS top FROM each GROUP BY 1),
cand AS (SELECT token, max(usd) / nullif(min(usd), 0) AS move FROM trades GROUP BY 1), f AS (SELECT token, coalesce(wallets, 0) AS wallets, coalesce(verified, 0) AS verified, coalesce(roots, 0) AS roots, top, move FROM cand LEFT JOIN flow USING (token))
SELECT token, wallets, roots, CASE WHEN wallets < 3 THEN 'NO_CONSENSUS' WHEN roots < 3 OR verified < 3 THEN 'CONSENSUS_INDEPENDENCE_UNVERIFIED' WHEN top IS NULL OR top > 0.5 THEN 'CONSENSUS_CONCENTRATED' WHEN move IS NULL OR move > 3.0 THEN 'MOVE_CONSUMED_OR_UNKNOWN' WHEN token % 2 = 1 THEN 'CONSENSUS_PENDING_EXECUTION' ELSE 'PAPER_PROBE_CANDIDATE' END AS signal_state FROM f""")
def consensus_signals(spark, d):
    x = trades(spark, d).withColumn("network", F.lit("n")).withColumnRenamed("token", "token_id")
    buys = x.where(F.col("side") == "buy")
    as_of = t(spark, d, "events").agg(F.max("ts")).first()[0] - timedelta(days=1)
    able = buys.groupBy("network", "wallet").agg(F.min("ts").alias("qualified_at")).withColumn("state", F.lit("QUALIFIED"))
    known = buys.select("network", "wallet", (F.col("wallet") % 7).alias("funding_root"), F.when(F.col("wallet") % 5 > 0, "INDEPENDENT_VERIFIED").otherwise("UNKNOWN").alias("provenance_state"))
    cands = x.groupBy("network", "token_id").agg(F.max("usd").alias("price"), F.min("usd").alias("first_price")).withColumn("route_state", F.when(F.col("token_id") % 2 == 0, "ROUTED_QUOTE_PASS")).withColumn("contract_state", F.lit("PROXY_PASS"))
    return C.consensus_signals(cands, buys, able, known, as_of).select(F.col("token_id").alias("token"), "wallets", "roots", "signal_state")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, d):
    out = new_folder(spark, "windows")
    S.window_counts(S.file_events(spark, f"{d}/events*.parquet", t(spark, d, "events").schema, "ts"), "ts", ["event_type"], "1 hour", new_folder(spark, "offsets"), out)
    return spark.read.parquet(out).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT event_id, event_type, value FROM events")
def stream_capture(spark, d):
    out = new_folder(spark, "captured")
    S.capture(S.unique_events(S.file_events(spark, f"{d}/events*.parquet", t(spark, d, "events").schema, "ts"), ["event_id"], "ts"), new_folder(spark, "offsets"), out)
    return spark.read.parquet(out).select("event_id", "event_type", "value")
