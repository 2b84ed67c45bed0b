"""Queries of payload walks, run ledgers, summaries and first turnovers, with their SQL; stand-ins as in ``registry``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import summary as U
from tidemark.operators import variants as J
from tidemark.plans.registry import query, t
from tidemark.plans.stream_queries import fed
from tidemark.shared import new_folder
from tidemark.streaming import capture as S
from tidemark.streaming import ledger as L

# Every event as a payload five levels deep around its own props; every 50th is cut short.
_EVENT = """'{"id":' || event_id || ',"props":' || props || ',"by":[{"user":' || user_id || ',"seen":[{"type":"' || event_type || '","big":' || CASE WHEN value > 100 THEN 'true' ELSE 'null' END || ',"none":[],"at":{"in":{"n":"' || event_id % 9 || '"}}}]},7]}'"""
_EVENT = f"CASE WHEN event_id % 50 = 49 THEN left({_EVENT}, 30) ELSE {_EVENT} END"


@query(f"""WITH p AS (SELECT event_id, {_EVENT} AS payload FROM events)
SELECT event_id, w.fullkey AS path, CASE WHEN w.key IS NULL OR w.fullkey LIKE '%]' THEN NULL ELSE w.key END AS key, CASE WHEN w.type <> 'NULL' THEN w.atom ->> '$' END AS value,
CASE w.type WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'VARCHAR' THEN 'STRING' WHEN 'NULL' THEN 'VOID' ELSE w.type END AS kind FROM p, json_tree(payload) AS w WHERE json_valid(payload) AND w.type NOT IN ('OBJECT', 'ARRAY')
UNION ALL SELECT event_id, '$', NULL, payload, 'MALFORMED' FROM p WHERE NOT json_valid(payload)""")
def payload_leaves(spark, d):
    return J.leaves(t(spark, d, "events").select("event_id", F.expr(_EVENT).alias("payload")), "payload")


# Links as a page's payload gives them: under a known key, under another, in a list, and deep.
_PAGE = """'{"page":' || page_id || ',"URL":"' || url || '","other":"' || url || '","id":"x","list":["' || url || '",{"href":"/' || page_id || '"}],"embed":{"external":{"uri":"at://' || page_id || '"}}}'"""


@query(f"""WITH p AS (SELECT page_id, {_PAGE} AS payload FROM pages)
SELECT page_id, w.fullkey AS path, w.atom ->> '$' AS link FROM p, json_tree(payload) AS w WHERE w.type = 'VARCHAR' AND w.fullkey NOT LIKE '%]' AND (lower(w.key) IN ('uri', 'url', 'href') OR starts_with(w.atom ->> '$', 'http'))""")
def payload_links(spark, d):
    return J.links(t(spark, d, "pages").select("page_id", F.expr(_PAGE).alias("payload")), "payload").select("page_id", "path", F.col("value").alias("link"))


# Flags as feeds write them: a boolean, a word, a number, something else, or none.
_FLAG = """'{"raw":{' || CASE event_id % 7 WHEN 0 THEN '"flag":true' WHEN 1 THEN '"flag":" Yes"' WHEN 2 THEN '"flag":' || (user_id % 3) WHEN 3 THEN '"flag":"' || event_type || '"' WHEN 4 THEN '"flag":null' WHEN 5 THEN '"flag":"OFF"' ELSE '"x":1' END || '}}'"""


@query(f"""WITH p AS (SELECT event_type, lower(trim(({_FLAG}) ->> '$.raw.flag')) AS f FROM events),
b AS (SELECT event_type, CASE WHEN f IN ('true', 't', 'yes', 'y', 'on', '1') THEN true WHEN f IN ('false', 'f', 'no', 'n', 'off', '0') THEN false END AS b FROM p)
SELECT event_type, count(*) FILTER (b) AS yes, count(*) FILTER (NOT b) AS no, count(*) FILTER (b IS NULL) AS unknown FROM b GROUP BY 1""")
def raw_flags(spark, d):
    flag = t(spark, d, "events").select("event_type", J.raw_boolean(F.expr(_FLAG), "$.raw.flag").alias("b"))
    return flag.groupBy("event_type").agg(F.count_if("b").alias("yes"), F.count_if(~F.col("b")).alias("no"), F.count_if(F.col("b").isNull()).alias("unknown"))


@query("""WITH one AS (SELECT l_partkey, epoch_us(l_shipdate) AS us, l_suppkey, l_extendedprice FROM lineitem),
o AS (SELECT l_partkey, min(us) AS created, arg_min(l_suppkey, (epoch_us(l_shipdate), l_orderkey, l_linenumber)) AS creator FROM (SELECT *, epoch_us(l_shipdate) AS us FROM lineitem) GROUP BY 1),
w AS (SELECT l_partkey, l_suppkey, any_value(creator) AS creator, count(*) AS n, sum(l_extendedprice) AS usd FROM one JOIN o USING (l_partkey) WHERE us < created + 31536000000000 GROUP BY 1, 2)
SELECT l_partkey, CAST(sum(n) AS BIGINT) AS trades, round(sum(usd), 2) AS gross, count(*) AS addresses, round(coalesce(sum(usd) FILTER (l_suppkey = creator), 0) / sum(usd), 6) AS creator_share, round(max(usd) / sum(usd), 6) AS largest_share FROM w GROUP BY 1""")
def launch_turnover(spark, d):
    """A part's first shipment stands for its launch by that supplier, a year for the first five minutes."""
    x = t(spark, d, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", "l_orderkey", "l_linenumber", F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("us"))
    launches = x.groupBy("l_partkey").agg(F.min("us").alias("created"), F.min_by("l_suppkey", F.struct("us", "l_orderkey", "l_linenumber")).alias("creator"))
    out = U.first_turnover(launches, x, "l_partkey", "us", "l_suppkey", "l_extendedprice", "created", "creator", 31_536_000_000_000)
    return out.withColumns({"gross": F.round("gross", 2), "creator_share": F.round("creator_share", 6), "largest_share": F.round("largest_share", 6)})


@query("""WITH c AS (SELECT o_orderstatus AS s, count(*) AS n, count(*) FILTER (o_totalprice > 100000) AS big FROM orders GROUP BY 1)
SELECT '{"version":"v1","rows":' || sum(n) || ',"big":' || sum(big) || ',"states":{' || string_agg('"' || s || '":' || n, ',' ORDER BY s) || '}}' AS summary FROM c""")
def order_summary(spark, d):
    return U.state_summary(t(spark, d, "orders"), F.col("o_orderstatus"), "v1", {"big": F.count_if(F.col("o_totalprice") > 100000)})


@query("""WITH e AS (SELECT event_id, epoch_us(ts) AS us, event_id * 7919 % 10 AS cut FROM events UNION ALL SELECT event_id, epoch_us(ts), (event_id * 7919 + 3) % 10 FROM events WHERE event_id % 7 = 0),
m AS (SELECT cut, max(max(us)) OVER (ORDER BY cut ROWS BETWEEN UNBOUNDED PRECEDING AND 2 PRECEDING) AS before FROM e GROUP BY 1),
l AS (SELECT cut, event_id, before IS NOT NULL AND us <= (before // 1000 - 1728000000) * 1000 AS late, row_number() OVER (PARTITION BY event_id ORDER BY cut) > 1 AS again FROM e JOIN m USING (cut))
SELECT cut, count(*) AS rows_in, count(*) FILTER (NOT late AND NOT again) AS kept, count(*) FILTER (late) AS late, count(*) FILTER (NOT late AND again) AS duplicates, true AS balanced,
CASE WHEN count(*) FILTER (late) > 0 THEN 'BUFFER_GAP' WHEN count(*) FILTER (NOT late AND NOT again) = 0 THEN 'CONNECTED_NO_EVENTS_UNVERIFIED' ELSE 'RAW_CAPTURE_ACTIVE' END AS state FROM l GROUP BY 1""")
def cut_ledger(spark, d):
    """Files in mixed order, every seventh event sent twice: each cut's rows are kept, late, or duplicates. A cut's rows are
    late if they are 20 days or more behind the newest time two cuts before: a stateful stage drops rows by the mark that the cut before it had."""
    e = t(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    number = F.col("event_id") * 7919
    both = e.withColumn("cut", number % 10).unionByName(e.where("event_id % 7 = 0").withColumn("cut", (number + 3) % 10))
    stream = fed(spark, both, 10, F.col("cut")).withColumn("at", F.timestamp_micros("us"))
    once = L.kept_rows(S.unique_events(stream, ["event_id"], "at", "20 days"))
    folder = new_folder(spark, "ledger")
    with L.RunLedger() as ledger:
        S.capture(once, new_folder(spark, "offsets"), new_folder(spark, "captured"))
    ledger.save(spark, folder)
    return L.read_ledger(spark, folder).drop("query_id")
