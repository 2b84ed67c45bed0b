"""Streaming queries over the driver's tables fed in cuts, with the SQL over the whole table that they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.relational import launch_step
from tidemark.plans.registry import ORACLE_SQL, query, t
from tidemark.shared import new_folder
from tidemark.sources import commits as C
from tidemark.streaming import capture as S
from tidemark.streaming import replay as P
from tidemark.streaming import stateful as Y

DAY = 86_400_000_000
FEED = "event_id long, us long, user_id long, value double"


def feed(spark, d) -> DataFrame:
    return t(spark, d, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "user_id", "value")


@query("SELECT 'EVENT' AS kind, event_id, epoch_us(ts) AS us, user_id, value FROM events")
def replayed_feed(spark, d):
    """The feed is landed in two halves; the query stops at the end of the first and is started again from its checkpoint."""
    e, land, offsets, out = feed(spark, d), new_folder(spark, "feed"), new_folder(spark, "offsets"), new_folder(spark, "replayed")
    low, high = e.agg(F.min("us"), F.max("us")).first()
    middle = low + (high - low) // 2 // DAY * DAY
    for part in (e.where(F.col("us") < middle), e.where(F.col("us") >= middle)):
        P.land_feed(part, land, "us", 86_400)
        stream = P.replay(spark, land, FEED, slice_s=86_400, step_s=5 * 86_400, now_us=low + 30 * 3_600_000_000, prior_us=low)
        once = S.unique_events(stream.withColumn("at", F.timestamp_micros("us")), ["event_id"], "at")
        P.run_to_end(once.drop("at"), offsets, C.committing(out, lambda cut: {"events": cut}))
    return C.read_committed(spark, out, "events", f"{FEED}, kind string").select("kind", "event_id", "us", "user_id", "value")


@query("""WITH h AS (SELECT max(epoch_us(ts)) - 960000000 AS start FROM events)
SELECT 'EVENT' AS kind, event_id, epoch_us(ts) AS us FROM events, h WHERE epoch_us(ts) > start UNION ALL SELECT 'UNKNOWN_PREHISTORY', NULL, start FROM h""")
def replay_baseline(spark, d):
    """Without a usable cursor only the last minutes are read, and what was before them is a row."""
    land, out = new_folder(spark, "feed"), new_folder(spark, "replayed")
    P.land_feed(feed(spark, d), land, "us")
    P.run_to_end(P.replay(spark, land, FEED, prior_us=0), new_folder(spark, "offsets"), C.committing(out, lambda cut: {"events": cut}))
    return C.read_committed(spark, out, "events", f"{FEED}, kind string").select("kind", "event_id", "us")


def fed(spark, rows: DataFrame, parts: int, number) -> DataFrame:
    """A stream of ``rows`` in ``parts`` cuts, one file each, in order of ``number``."""
    folder = new_folder(spark, "fed")
    Y.fed_in_order(rows, number, folder, parts)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def folded(spark, stream: DataFrame, **how) -> DataFrame:
    """What a stream's fold commits, cut by cut."""
    out = new_folder(spark, "folded")
    result = Y.stream_fold(stream, **how)
    S.run_cuts(result, new_folder(spark, "offsets"), C.committing(out, lambda cut: {"states": cut}))
    return C.read_committed(spark, out, "states", result.schema)


@query(ORACLE_SQL.get("launch_coverage"))
def launch_cuts(spark, d):
    """``launch_coverage`` with its boundary carried from cut to cut."""
    e = t(spark, d, "events")
    day = F.unix_date(F.col("ts").cast("date")).cast("long")
    cuts = e.groupBy(F.pmod(F.col("user_id"), F.lit(5)).alias("stream"), day.alias("cut")).agg(F.min("event_id").alias("oldest"), F.max("event_id").alias("newest"), (F.count_if(F.col("event_type") == "error") > 1000).alias("error"))
    first = cuts.agg(F.min("cut")).first()[0]
    stream = fed(spark, cuts, 10, F.least(F.floor((F.col("cut") - (first or 0)) / 3), F.lit(9)))
    return folded(spark, stream, keys=["stream"], order=["cut"], columns=["cut", "oldest", "newest", "error"], out="cut long, state string, boundary long", state="boundary long, cut long", start=lambda: (None, None), step=launch_step)


def _poll_sql(first: str, rest: str, columns: str) -> str:
    return f"""r AS (SELECT stream, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS poll, {first}, CAST(NULL AS BIGINT) AS before, CAST(NULL AS BIGINT) AS after FROM (SELECT DISTINCT stream FROM p)
UNION ALL SELECT p.stream, p.i, p.poll, {rest} FROM r JOIN p ON p.stream = r.stream AND p.i = r.i + 1) SELECT stream, poll, {columns}, before, after FROM r WHERE i > 0"""


_PAGES = """WITH RECURSIVE x AS (SELECT user_id % 20 AS stream, event_id, unnest([day, day + 1]) AS poll FROM (SELECT *, epoch_us(ts) // 86400000000 AS day FROM events)),
g AS (SELECT stream, poll, list(event_id ORDER BY event_id DESC) AS ids, CAST((stream + poll) % 11 = 0 AS BIGINT) AS errors FROM x GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY poll) AS i FROM (SELECT stream, poll, CASE WHEN (stream + poll) % 22 = 0 THEN [] ELSE ids[1:30] END AS items, errors, len(ids) AS seen FROM g)),
"""


def pages(spark, d) -> DataFrame:
    """A poll a day: the newest events of a stream in this day and the one before, 30 at most; some polls fail."""
    e = t(spark, d, "events").select((F.col("user_id") % 20).alias("stream"), "event_id", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / DAY).alias("day"))
    x = e.withColumn("poll", F.explode(F.array("day", F.col("day") + 1)))
    ids = F.sort_array(F.collect_list("event_id"), False)
    g = x.groupBy("stream", "poll").agg(ids.alias("ids"))
    failed = F.when((F.col("stream") + F.col("poll")) % 22 == 0, F.array().cast("array<long>")).otherwise(F.slice("ids", 1, 30))
    return g.select("stream", "poll", failed.alias("items"), ((F.col("stream") + F.col("poll")) % 11 == 0).cast("long").alias("errors"), F.size("ids").cast("long").alias("seen"))


def polled(spark, d) -> DataFrame:
    p = pages(spark, d)
    first = p.agg(F.min("poll")).first()[0] or 0
    return fed(spark, p, 10, F.least(F.floor((F.col("poll") - first) / 3), F.lit(9)))


_POS = "coalesce(list_position(p.items, r.after), 0)"


@query(_PAGES + _poll_sql("CAST(NULL AS VARCHAR) AS status, CAST(NULL AS BIGINT) AS fresh", f"CASE WHEN {_POS} > 0 THEN 'OK' WHEN errors > 0 AND len(items) = 0 THEN 'UNKNOWN' ELSE 'PARTIAL' END, CASE WHEN {_POS} > 0 THEN {_POS} - 1 ELSE len(items) END, r.after, CASE WHEN len(items) > 0 AND (r.after IS NULL OR {_POS} > 0) THEN items[1] ELSE r.after END", "status, fresh"))
def listing_polls(spark, d):
    out = "poll long, status string, fresh long, before long, after long"
    return folded(spark, polled(spark, d), keys=["stream"], order=["poll"], columns=["poll", "items", "errors"], out=out, state="cursor long", start=lambda: (None,), step=Y.listing_step)


_DONE = "(seen < 40)"


@query(_PAGES + _poll_sql("CAST(NULL AS VARCHAR) AS status", f"CASE WHEN errors > 0 AND len(items) = 0 THEN 'UNKNOWN' WHEN NOT {_DONE} OR r.after IS NULL THEN 'PARTIAL' ELSE 'OK' END, r.after, CASE WHEN {_DONE} AND len(items) > 0 THEN items[1] ELSE r.after END", "status"))
def signature_polls(spark, d):
    rows = polled(spark, d).select("stream", "poll", F.get("items", F.lit(0)).alias("newest"), F.size("items").alias("rows"), (F.col("seen") < 40).alias("complete"), "errors")
    out = "poll long, status string, before long, after long"
    return folded(spark, rows, keys=["stream"], order=["poll"], columns=["poll", "newest", "rows", "complete", "errors"], out=out, state="cursor long", start=lambda: (None,), step=Y.signature_step)


@query("""WITH e AS (SELECT event_type, event_id, epoch_us(ts) AS us, event_id * 7919 % 10 AS cut FROM events),
c AS (SELECT event_type, cut, max(us) AS newest FROM e GROUP BY 1, 2), b AS (SELECT event_type, cut, max(newest) OVER (PARTITION BY event_type ORDER BY cut ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c),
l AS (SELECT e.*, coalesce(us < before - 1728000000000, false) AS late FROM e JOIN b USING (event_type, cut))
SELECT event_type, 'ROW' AS kind, us, event_id, CAST(1 AS BIGINT) AS n FROM l WHERE NOT late UNION ALL SELECT event_type, 'LATE', us // 86400000000 * 86400000000, NULL, count(*) FROM l WHERE late GROUP BY event_type, cut, 3""")
def late_rows(spark, d):
    """Files in mixed order: what comes over 20 days behind is counted by day; rows and gaps are two tables of one commit."""
    e = t(spark, d, "events").select("event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    stream = fed(spark, e, 10, F.col("event_id") * 7919 % 10)
    out, both = new_folder(spark, "late"), Y.rows_and_gaps(stream, "event_type", "us", "event_id", 20 * 86_400, 86_400)
    S.run_cuts(both, new_folder(spark, "offsets"), C.committing(out, lambda cut: {"rows": cut.where("kind = 'ROW'"), "gaps": cut.where("kind <> 'ROW'")}))
    return C.read_committed(spark, out, "rows", both.schema).unionByName(C.read_committed(spark, out, "gaps", both.schema))
