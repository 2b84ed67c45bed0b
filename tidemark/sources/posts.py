"""Payloads of post and trade feeds as rows. A payload of another shape gives no rows, or is named as malformed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import envelope as V
from tidemark.functions import fixed
from tidemark.functions import text as X
from tidemark.sources.feeds import feed_time

STATUS = "struct<id:string,uri:string,url:string,content:string,created_at:string,reblog:string,account:struct<id:string,uri:string,url:string>,media_attachments:array<struct<preview_url:string,url:string>>>"
RUNS = "struct<runs:array<struct<text:string>>>"
VIDEO = f"struct<videoId:string,title:{RUNS},ownerText:{RUNS},publishedTimeText:struct<simpleText:string>>"
SEARCH = f"array<struct<itemSectionRenderer:struct<contents:array<struct<videoRenderer:{VIDEO}>>>>>"
ENTRY = "struct<id:string,author:string,created_utc:string,title:string,selftext:string,url:string>"
LONGEST_AGE = 48 * 60


def _first(*columns: Column) -> Column:
    """The first that is neither null nor empty; else empty."""
    return F.coalesce(*[F.when(c != "", c) for c in columns], F.lit(""))


def fetched(landing: DataFrame, http_code: str, seconds: str, error: str, body: str = "body") -> DataFrame:
    """Landed responses with ``ok`` and ``health``: a body counts only with a code of 2xx and no error."""
    ok = F.col(http_code).between(200, 299) & F.col(error).isNull() & F.col(body).isNotNull()
    health = F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), F.col(http_code).alias("http_code"), F.round(seconds, 3).alias("seconds"), F.col(error).alias("error"))
    return landing.withColumn("ok", F.coalesce(ok, F.lit(False))).withColumn("health", health)


def trade_pages(df: DataFrame, body: str = "body") -> DataFrame:
    """(trades, next_cursor, has_more, error) of each page; trades is an array of JSON texts. A page without a list of trades
    and a pagination object is ``malformed_trade_page``, never an empty page."""
    keep = [c for c in df.columns if c != body]
    say = lambda path: F.get_json_object(body, path)
    trades, paging = say("$.trades"), say("$.pagination")
    good = F.coalesce(trades.startswith("[") & paging.startswith("{"), F.lit(False))
    cursor = _first(say("$.pagination.nextCursor"), say("$.pagination.next_cursor"))
    return df.select(
        *keep, F.when(good, F.from_json(trades, "array<string>")).alias("trades"), F.when(good & (cursor != ""), cursor).alias("next_cursor"),
        F.when(good, F.coalesce(say("$.pagination.hasMore") == "true", F.lit(False))).alias("has_more"), F.when(~good, "malformed_trade_page").alias("error"),
    )


def statuses(df: DataFrame, body: str = "body", most: int | None = None, reblogs: bool = True) -> DataFrame:
    """(rank, actor_id, post_id, created_at, text, links, buckets, media) of the statuses of a timeline that have an id and
    a bucket or an allowed link. Tag feeds take the first ``most`` and no reblogs."""
    keep = [c for c in df.columns if c != body]
    all_ = F.from_json(body, f"array<{STATUS}>")
    x = df.select(*keep, F.posexplode(F.slice(all_, 1, most) if most else all_).alias("_p", "_s"))
    if not reblogs:
        x = x.where(F.col("_s.reblog").isNull())
    html = F.coalesce("_s.content", F.lit(""))
    hrefs = F.regexp_extract_all(html, F.lit(r"(?i)href=[\"']([^\"']+)"), F.lit(1))
    media = F.flatten(F.transform(F.coalesce("_s.media_attachments", F.array().cast("array<struct<preview_url:string,url:string>>")), lambda m: F.array(m["preview_url"], m["url"])))
    x = x.select(*keep, (F.col("_p") + 1).alias("rank"), _first(F.col("_s.account.uri"), F.col("_s.account.url"), F.col("_s.account.id")).alias("actor_id"), _first(F.col("_s.uri"), F.col("_s.url"), F.col("_s.id")).alias("post_id"), feed_time(F.col("_s.created_at")).alias("created_at"), V.html_to_text(html).alias("text"), V.allowed_links(F.concat(F.array(html), hrefs)).alias("links"), F.array_compact(media).alias("media"))
    x = x.withColumn("buckets", X.matched_buckets(F.col("text"), F.col("links"), fixed.SOCIAL_BUCKETS))
    return x.where((F.col("post_id") != "") & ((F.size("buckets") > 0) | (F.size("links") > 0)))


def fresh_videos(df: DataFrame, body: str = "body", observed: str | None = None, longest: int = LONGEST_AGE) -> DataFrame:
    """(post_id, actor_id, text, url, media_url, published_relative, age_minutes) of a search's videos of at most ``longest``
    minutes; an age that can't be read is unknown and stays. With the column ``observed`` also created_at."""
    keep = [c for c in df.columns if c != body]
    sections = F.from_json(F.get_json_object(body, "$.contents.twoColumnSearchResultsRenderer.primaryContents.sectionListRenderer.contents"), SEARCH)
    items = F.flatten(F.transform(sections, lambda s: F.coalesce(s["itemSectionRenderer"]["contents"], F.array().cast(f"array<struct<videoRenderer:{VIDEO}>>"))))
    x = df.select(*keep, F.explode(F.transform(items, lambda i: i["videoRenderer"])).alias("_v")).where(_first(F.col("_v.videoId")) != "")
    said = lambda c: F.trim(F.array_join(F.transform(F.col(c), lambda r: F.coalesce(r["text"], F.lit(""))), " "))
    ago = F.coalesce("_v.publishedTimeText.simpleText", F.lit(""))
    x = x.withColumn("age_minutes", X.age_minutes(ago)).where(F.col("age_minutes").isNull() | (F.col("age_minutes") <= longest))
    video = F.col("_v.videoId")
    out = x.select(*keep, video.alias("post_id"), F.coalesce(said("_v.ownerText.runs"), F.lit("")).alias("actor_id"), F.coalesce(said("_v.title.runs"), F.lit("")).alias("text"), F.concat(F.lit("https://www.youtube.com/watch?v="), video).alias("url"), F.format_string("https://i.ytimg.com/vi/%s/hqdefault.jpg", video).alias("media_url"), ago.alias("published_relative"), "age_minutes")
    return out.withColumn("created_at", F.timestamp_micros(F.unix_micros(F.col(observed)) - (F.col("age_minutes") * 60_000_000).cast("long"))) if observed else out


def forum_entries(df: DataFrame, body: str = "body") -> DataFrame:
    """(post_id, object_url, author, published, title, body, raw_links) of a forum listing's entries that have an id and a
    time in seconds; the entry's own object is no link of its own."""
    keep = [c for c in df.columns if c != body]
    x = df.select(*keep, F.explode(F.from_json(body, f"array<{ENTRY}>")).alias("_e"))
    at, pid = F.col("_e.created_utc").try_cast("double"), F.trim(F.coalesce("_e.id", F.lit("")))
    title, text = F.substring(F.coalesce("_e.title", F.lit("")), 1, 250), F.substring(F.coalesce("_e.selftext", F.lit("")), 1, 2000)
    links = F.array_compact(F.concat(F.regexp_extract_all(F.concat_ws(" ", title, text), F.lit(r"https?://[^\s<>()\]\[{}\"']+"), F.lit(0)), F.array("_e.url")))
    own = F.concat(F.lit("reddit.com/comments/"), F.lower(pid))
    x = x.where(at.isNotNull() & (pid != ""))
    return x.select(*keep, pid.alias("post_id"), own.alias("object_url"), F.trim(F.coalesce("_e.author", F.lit(""))).alias("author"), F.timestamp_micros((at * 1_000_000).cast("long")).alias("published"), title.alias("title"), text.alias("body"), F.array_distinct(F.filter(links, lambda u: ~F.contains(F.lower(u), own))).alias("raw_links"))
