"""Queries of the receipt, flow and eligibility audits and of search pages, with their SQL. Line items stand for transactions: their prices are the
amounts, their flags, quantities and taxes what is wrong with one; the SQL reads the columns, the query only the payload built from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import audits as A
from tidemark.plans.registry import query, t
from tidemark.sources import seeds as D

# JSON text by its parts; concat_ws leaves out a field that is null, as to_json does.
_FIELD = "concat('\"{}\":\"{}', {}, '\"')"
_KEY, _POOL, _TMP = (lambda name: _FIELD.format(name, "s", "l_suppkey")), (lambda name: _FIELD.format(name, "", "pool")), (lambda name: _FIELD.format(name, "tmp", "l_orderkey"))
_MOVE = f"""concat('{{"program":"spl-token","parsed":{{"type":"transferChecked","info":{{', concat_ws(',', '"mint":"{A.WRAPPED_SOL}","source":"v"', {_POOL("authority")}, {_TMP("destination")}, concat('"tokenAmount":{{', coalesce(concat('"amount":"', cents, '"'), ''), '}}')), '}}}}}}')"""
_META = f"""concat_ws(',', if(l_linenumber = 7 AND l_linestatus = 'O', '"err":"failed"', null), concat('"fee":', fee), if(l_linenumber = 6, '"logMessages":["Program log: other",""]', '"logMessages":["Program log: {A.COLLECT_LOG}","Program log: {A.FEES_LOG}"]'),
'"preBalances":[0,1000000000,0]', if(l_tax = 0.08, '"postBalances":[0]', concat('"postBalances":[0,', coalesce(cast(1000000000L + cents - fee + if(l_returnflag = 'R', 1, 0) AS string), 'null'), ',0]')), concat('"postTokenBalances":[{{', coalesce({_FIELD.format("mint", "m", "l_partkey")}, ''), '}}]'),
concat('"innerInstructions":[{{"instructions":[', concat_ws(',', move, if(l_quantity > 45, move, null)), ']}}]'))"""
_TX = f"""concat('{{"transaction":{{"message":{{"accountKeys":[{{"pubkey":"payer"}},{{', coalesce({_KEY("pubkey")}, ''), '}},{{', coalesce({_POOL("pubkey")}, ''), '}},{{', coalesce({_TMP("pubkey")}, ''), '}}],"instructions":[{{"programId":"',
if(l_linenumber = 5, 'other', '{A.AMM_PROGRAM}'), '","parsed":{{"type":"closeAccount","info":{{', concat_ws(',', {_TMP("account")}, {_KEY("destination")}), '}}}}}}]}}}},"meta":{{', {_META}, '}}}}')"""
_ITEMS = "i AS (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, 5000 + l_linenumber AS fee FROM lineitem)"


def _transactions(spark, d):
    x = t(spark, d, "lineitem").withColumns({"cents": F.round(F.col("l_extendedprice") * 100).cast("long"), "fee": F.expr("5000L + l_linenumber"), "pool": F.expr("concat('p', l_partkey)")})
    return x.withColumn("move", F.expr(_MOVE)).withColumn("tx", F.expr(_TX)).drop("move")


@query(f"""WITH {_ITEMS} SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber = 7 AND l_linestatus = 'O' THEN 'transaction unavailable or failed' WHEN l_suppkey % 50 = 0 THEN 'creator not in account keys' WHEN l_linenumber = 5 THEN 'Pump AMM program absent'
WHEN l_linenumber = 6 THEN 'creator fee collection log absent' WHEN l_quantity > 45 THEN 'expected exactly one vault-to-closed-WSOL transfer' WHEN l_tax = 0.08 THEN 'missing creator balances'
WHEN l_returnflag = 'R' OR cents <= fee THEN 'claim amount, wallet credit and fee do not reconcile' END AS reason,
CASE WHEN l_quantity <= 45 AND l_suppkey % 50 > 0 THEN cents END AS amount, CASE WHEN l_suppkey % 50 > 0 AND l_tax <> 0.08 THEN cents - fee + CAST(l_returnflag = 'R' AS INT) END AS wallet_delta FROM i""")
def creator_receipts(spark, d):
    creator = F.expr("if(l_suppkey % 50 = 0, 'stranger', concat('s', l_suppkey))")
    return A.creator_receipt(_transactions(spark, d).withColumn("creator", creator)).select("l_orderkey", "l_linenumber", "l_partkey", "reason", "amount", "wallet_delta")


@query(f"""WITH {_ITEMS}, r AS (SELECT *, CASE WHEN l_suppkey % 20 = 0 THEN 'pool is not owned by Pump AMM' WHEN l_linenumber = 7 AND l_linestatus = 'O' THEN 'transaction unavailable or failed' WHEN l_returnflag = 'A' AND l_partkey % 2 = 0 THEN 'pool, mint or vault absent in transaction'
WHEN l_linenumber = 6 THEN 'Pump AMM fee calculation log absent' WHEN l_quantity > 45 THEN 'one direct pool-to-vault WSOL transfer not found' END AS reason FROM i)
SELECT coalesce(reason, 'VERIFIED') AS reason, count(*) AS n, CAST(sum(CASE WHEN reason IS NULL THEN cents END) AS BIGINT) AS fee_amount FROM r GROUP BY 1""")
def pool_fee_flows(spark, d):
    x = _transactions(spark, d).withColumns({"mint": F.expr("concat('m', if(l_returnflag = 'A' AND l_partkey % 2 = 0, -1, l_partkey))"), "vault": F.expr("concat('tmp', l_orderkey)"), "owner": F.expr(f"if(l_suppkey % 20 = 0, 'other', '{A.AMM_PROGRAM}')")})
    return A.pool_fee_flow(x).groupBy(F.coalesce("reason", F.lit("VERIFIED")).alias("reason")).agg(F.count("*").alias("n"), F.sum("fee_amount").alias("fee_amount"))


_SURFACE = "bluesky:jetstream_crypto"


@query("""WITH g AS (SELECT user_id, epoch_ms(max(ts)) // 1000 AS newest, max(epoch_us(ts)) FILTER (event_type = 'purchase') AS cursor_us, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'signup') AS signups, count(*) FILTER (event_type = 'view') AS views,
max_by(event_type, (ts, event_id)) AS last FROM events GROUP BY 1), l AS (SELECT *, greatest(0.0, (newest * 1000000 - cursor_us) / 1e6) AS lag FROM g),
r AS (SELECT *, list_sort(list_filter([CASE WHEN last = 'click' THEN 'WRONG_SCHEMA' END, CASE WHEN signups = 0 OR user_id % 10 = 0 THEN 'JETSTREAM_HEALTH_MISSING' ELSE NULL END, CASE WHEN NOT (signups = 0 OR user_id % 10 = 0) AND errors > views THEN 'JETSTREAM_NOT_OK' END,
CASE WHEN NOT (signups = 0 OR user_id % 10 = 0) AND errors >= signups THEN 'JETSTREAM_NOT_CAUGHT_UP' END, CASE WHEN NOT (signups = 0 OR user_id % 10 = 0) AND last = 'error' THEN 'JETSTREAM_PARTIAL' END, CASE WHEN lag > 86400 THEN 'CURSOR_STALE' END, CASE WHEN lag IS NULL OR cursor_us IS NULL THEN 'CURSOR_LAG_UNKNOWN' END], lambda x: x IS NOT NULL)) AS codes FROM l)
SELECT user_id, CASE WHEN cursor_us IS NOT NULL THEN round(lag, 3) END AS lag_seconds, array_to_string(list_sort(codes || CASE WHEN views > 12 THEN ['REDDIT_COVERAGE_MISSING'] ELSE [] END), ',') AS reason_codes, len(codes) = 0 AS stream_eligible, len(codes) = 0 AND views <= 12 AS global_eligible FROM r""")
def absence_eligibility(spark, d):
    """May an absence be claimed for a user? The newest purchase is the cursor, errors and signups are the health."""
    e = t(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    g = e.groupBy("user_id").agg(
        F.max("us").alias("at"), F.max(F.when(F.col("event_type") == "purchase", F.col("us"))).alias("cursor_us"), n("error").alias("errors"), n("signup").alias("signups"), n("view").alias("views"),
        F.max_by("event_type", F.struct("us", "event_id")).alias("last"),
    )
    own = f"""filter(array(if(signups = 0 OR user_id % 10 = 0, null, named_struct('surface', '{_SURFACE}', 'ok', errors <= views, 'caught_up_near_live', errors < signups, 'coverage_status', if(last = 'error', 'PARTIAL_OR_BASELINE_UNKNOWN', 'OK'))),
    named_struct('surface', 'reddit:r/x', 'ok', views <= 12, 'caught_up_near_live', cast(null AS boolean), 'coverage_status', cast(null AS string))), x -> x IS NOT NULL)"""
    g = g.select("user_id", "cursor_us", F.date_format(F.timestamp_seconds(F.floor(F.col("at") / 1_000_000)), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("generated_at"), F.when(F.col("last") == "click", "z").otherwise("s").alias("schema"), F.expr(own).alias("source_health"))
    out = A.negative_eligibility(g, "s", _SURFACE, max_lag=86_400)
    return out.select("user_id", F.round("lag_seconds", 3).alias("lag_seconds"), F.array_join("reason_codes", ",").alias("reason_codes"), "stream_eligible", "global_eligible")


@query("""SELECT doc_id, doc_id % 3 = 1 AS malformed, CASE WHEN doc_id % 3 = 1 THEN '' WHEN source IS NULL THEN 'reddit.com/comments/' || lower(to_base(doc_id, 36)) ELSE 'reddit.com/comments/' || lower(to_base(doc_id, 36)) || ',youtube.com/video/' || source END AS links FROM documents WHERE doc_id % 3 = 1 OR n_chars % 241 BETWEEN 0 AND 125""")
def search_pages(spark, d):
    """A document as a search page of one post, n_chars % 241 - 5 minutes old; every third page is no list."""
    x = t(spark, d, "documents")
    link = "concat('https://www.reddit.com/r/x/comments/', lower(conv(doc_id, 10, 36)), '/')"
    body = f"""to_json(named_struct('posts', array(named_struct('uri', concat('at://', doc_id), 'author', named_struct('did', coalesce(lang, 'none')), 'record', named_struct('text', text, 'createdAt', date_format(timestamp_seconds(1767225600 - 60 * (n_chars % 241 - 5)), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
    'facets', array(named_struct('features', array(named_struct('uri', {link})))), 'embed', named_struct('external', named_struct('uri', if(source IS NULL, null, concat('https://youtu.be/', source)))))))))"""
    x = x.select("doc_id", F.timestamp_seconds(F.lit(1767225600)).alias("observed_at"), F.when(F.col("doc_id") % 3 == 1, F.lit('{"posts":{}}')).otherwise(F.expr(body)).alias("body"))
    return D.search_posts(x).select("doc_id", F.col("error").isNotNull().alias("malformed"), F.coalesce(F.array_join("links", ","), F.lit("")).alias("links"))
