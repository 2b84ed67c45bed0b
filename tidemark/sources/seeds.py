"""Search pages, hashtag lists and browser seeds as rows. A payload of another shape is a row with its error, never an empty page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import envelope as V
from tidemark.functions import fixed
from tidemark.functions import text as X
from tidemark.sources.feeds import feed_time

# Fixed value: the tag of the one form of browser seeds that is read.
SEED_SCHEMA = "tiktok_cc_browser_seed_v2"
TAG_URL = "https://www.tiktok.com/tag/"

EXTERNAL = "struct<external:struct<uri:string>>"
POST = f"struct<uri:string,indexedAt:string,author:struct<did:string>,embed:{EXTERNAL},record:struct<text:string,createdAt:string,embed:{EXTERNAL},facets:array<struct<features:array<struct<uri:string>>>>>>"
TAG = "struct<name:string,hashtag_name:string,url:string,posts:long,views:long,rank:long,category:string,video_count:string,video_views:string,view_count:string,trend:string>"
VIDEO = "struct<url:string,item_url:string,video_id:string,item_id:string,id:string,text:string,title:string,desc:string,author_name:string,author:string,creator_name:string,thumbnail_url:string,cover:string,cover_url:string>"


def _said(*columns: Column | str) -> Column:
    """The first that is more than blanks, trimmed; else null."""
    trimmed = [F.trim(F.col(c) if isinstance(c, str) else c) for c in columns]
    return F.coalesce(*[F.when(c != "", c) for c in trimmed])


def _list(body: str, *paths: str) -> Column:
    """The JSON text of the first path that holds a list with something in it, or any list."""
    found = [F.get_json_object(body, p) for p in paths]
    return F.coalesce(*[F.when(c.startswith("[") & (c != "[]"), c) for c in found], *[F.when(c.startswith("["), c) for c in found])


def _objects(values: Column) -> Column:
    return V._each("array<string>", lambda urls: sorted({o for u in (urls if urls is not None else ()) if (o := V.exact_object_text(u))}), values)


def search_posts(df: DataFrame, body: str = "body", observed: str = "observed_at", most: int = 35, links: int = 8) -> DataFrame:
    """(post_id, actor_id, published, links, tokens, excerpt, has_object, error) of the first ``most`` posts of a search page that have an
    id and an actor and are timely at ``observed``. Links are the exact objects in the text, its facets and embeds, sorted."""
    keep = [c for c in df.columns if c != body]
    page = F.get_json_object(body, "$.posts")
    good = F.coalesce(page.startswith("["), F.lit(False))
    x = df.select(*keep, F.when(~good, "malformed_search_page").alias("error"), F.explode_outer(F.when(good, F.slice(F.from_json(page, f"array<{POST}>"), 1, most))).alias("_p"))
    text = F.coalesce("_p.record.text", F.lit(""))
    none = F.array().cast("array<string>")
    features = F.flatten(F.transform("_p.record.facets", lambda f: F.coalesce(f["features"]["uri"], none)))
    urls = F.concat(F.regexp_extract_all(text, F.lit(fixed.POST_URL), F.lit(0)), F.coalesce(features, none), F.array("_p.record.embed.external.uri", "_p.embed.external.uri"))
    clean = V.clean_text(text, None)
    x = x.select(
        *keep, _said("_p.uri").alias("post_id"), _said("_p.author.did").alias("actor_id"), feed_time(F.coalesce(_said("_p.record.createdAt"), _said("_p.indexedAt"))).alias("published"),
        _objects(F.array_compact(urls)).alias("links"), F.slice(F.filter(V.text_tokens(clean, None), lambda w: F.length(w) < 36), 1, 24).alias("tokens"), F.substring(clean, 1, 180).alias("excerpt"), "error",
    )
    x = x.withColumn("links", F.slice("links", 1, links)).withColumn("has_object", F.size("links") > 0)
    read = F.col("post_id").isNotNull() & F.col("actor_id").isNotNull() & X.timely(F.col("published"), F.col(observed))
    return x.where(F.col("error").isNotNull() | read)


def hashtags(df: DataFrame, body: str = "body", browser: bool = False) -> DataFrame:
    """(post_id, tag, url, text, posts, views, rank, category, error) of a hashtag list: of the service's answer, or of a ``browser`` seed,
    which must bear ``SEED_SCHEMA`` and whose ids name its hour, so that each hour's rank is a row of its own."""
    keep = [c for c in df.columns if c != body]
    page, error = _page(body, browser, "$.hashtags" if browser else "$.data.list", "$.data.hashtags")
    x = df.select(*keep, F.get_json_object(body, "$.generated_at").alias("_at"), error.alias("error"), F.explode_outer(F.from_json(page, f"array<{TAG}>")).alias("_t"))
    tag = F.regexp_replace(_said("_t.name" if browser else "_t.hashtag_name"), "^#+", "")
    x = x.withColumn("tag", F.when(tag != "", tag)).where(F.col("tag").isNotNull() | F.col("error").isNotNull())
    plain = F.concat(F.lit(TAG_URL), F.replace(F.url_encode("tag"), F.lit("+"), F.lit("%20")))
    number = lambda *c: F.coalesce(*[F.col(f"_t.{n}") for n in c], F.lit("0"))
    if browser:
        name, url = F.concat_ws(":", F.lit("hashtag"), F.lower("tag"), F.substring("_at", 1, 13)), F.coalesce(_said("_t.url"), plain)
        text = F.trim(F.concat(F.lit("#"), "tag", F.lit(" "), F.coalesce("_t.category", F.lit(""))))
    else:
        name, url = F.concat(F.lit("hashtag:"), F.lower("tag")), plain
        text = F.concat(F.lit("#"), "tag", F.lit(" TikTok Creative Center trend videos="), number("video_count"), F.lit(" views="), number("video_views", "view_count"), F.lit(" trend="), number("trend"))
    own = lambda c: F.when(F.col("tag").isNotNull(), c)
    return x.select(*keep, own(name).alias("post_id"), "tag", own(url).alias("url"), own(text).alias("text"), "_t.posts", "_t.views", "_t.rank", "_t.category", "error")


def seed_videos(df: DataFrame, body: str = "body", browser: bool = False) -> DataFrame:
    """(post_id, actor_id, text, links, buckets, media_url, error) of the videos beside the hashtags. A video without a link, or in a
    browser seed without an id, is none; ``direct_video_seed`` is every video's last bucket."""
    keep = [c for c in df.columns if c != body]
    page, error = _page(body, browser, "$.videos" if browser else "$.data.videos", "$.data.list")
    x = df.select(*keep, error.alias("error"), F.explode_outer(F.from_json(page, f"array<{VIDEO}>")).alias("_v"))
    url = _said("_v.url") if browser else _said("_v.item_url", "_v.url")
    links = F.array_compact(F.array(url)) if browser else V.allowed_links(F.array(url))
    name = F.concat(F.lit("video:"), _said("_v.video_id")) if browser else F.coalesce(_said("_v.item_id"), _said("_v.id"), url)
    text = F.coalesce("_v.text" if browser else _said("_v.title", "_v.desc"), F.lit(""))
    x = x.select(
        *keep, name.alias("post_id"), F.lit(None).cast("string").alias("actor_id") if browser else _said("_v.author_name", "_v.author", "_v.creator_name").alias("actor_id"),
        text.alias("text"), links.alias("links"), (_said("_v.thumbnail_url") if browser else _said("_v.thumbnail_url", "_v.cover", "_v.cover_url")).alias("media_url"), "error",
    )
    x = x.withColumn("buckets", F.concat(X.matched_buckets(F.col("text"), F.col("links"), fixed.SOCIAL_BUCKETS), F.array(F.lit("direct_video_seed"))))
    return x.where(F.col("error").isNotNull() | (F.col("post_id").isNotNull() & (F.size("links") > 0)))


def _page(body: str, browser: bool, *paths: str) -> tuple[Column, Column]:
    """The list to read and the error of a payload. A seed may leave its list out; an answer may not."""
    own = F.get_json_object(body, "$.schema").eqNullSafe(F.lit(SEED_SCHEMA))
    page = _list(body, *paths[: 1 if browser else None])
    return (F.when(own, page), F.when(~own, "unexpected_schema")) if browser else (page, F.when(page.isNull(), "malformed_list"))
