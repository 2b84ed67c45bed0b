"""Feeds as landed files: raw payload in, typed rows out, with built-in XML and JSON functions only.

A payload that cannot be parsed gives no rows; ``landed`` keeps it, so that the gap stays visible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NEWS = "array<struct<news_item_source:string,news_item_title:string,news_item_url:string,news_item_picture:string>>"
RSS = f"struct<channel:struct<item:array<struct<title:string,pubDate:string,picture:string,news_item:{NEWS}>>>>"
ATOM = "struct<entry:array<struct<id:string,title:string,content:string,published:string,updated:string,link:array<struct<_href:string>>>>>"
POOL = "struct<id:string,attributes:struct<name:string,address:string,pool_created_at:string,reserve_in_usd:string,base_token_price_usd:string>,relationships:struct<base_token:struct<data:struct<id:string>>>>"
LAUNCH = "array<struct<mint:string,creator:string,program:string,name:string,symbol:string,created_timestamp:bigint>>"


def landed(spark: SparkSession, path: str) -> DataFrame:
    """(path, body, observed_at) of every file of a landing folder, one row per payload."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"), F.col("_metadata.file_modification_time").alias("observed_at"))


def feed_time(text: Column) -> Column:
    """ISO 8601 or RFC 2822 (with or without a weekday, with an offset or GMT) as a timestamp; null for anything else."""
    rfc = F.regexp_replace(F.regexp_replace(F.trim(text), r"^[A-Za-z]{3},\s*", ""), r"(GMT|UTC|Z)$", "+0000")
    return F.coalesce(F.when(F.trim(text).rlike(r"^\d{4}-\d{2}"), F.try_to_timestamp(F.trim(text))), F.when(rfc.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4}"), F.try_to_timestamp(rfc, F.lit("d MMM yyyy HH:mm:ss Z"))))


def _text(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def trends(df: DataFrame, body: str = "body") -> DataFrame:
    """One row per item of an RSS payload: rank (1-based, in payload order), title, published, event_picture and support."""
    keep = [c for c in df.columns if c != body]
    x = df.withColumn("_x", F.from_xml(body, RSS, {"ignoreNamespace": "true"})).select(*keep, F.posexplode("_x.channel.item").alias("_p", "_i"))
    support = F.transform(F.coalesce("_i.news_item", F.array().cast(NEWS)), lambda n: F.struct(_text(n["news_item_source"]).alias("source"), _text(n["news_item_title"]).alias("article_title"), _text(n["news_item_url"]).alias("article_url"), _text(n["news_item_picture"]).alias("picture_url")))
    return x.select(*keep, (F.col("_p") + 1).alias("rank"), _text(F.col("_i.title")).alias("title"), feed_time(F.col("_i.pubDate")).alias("published"), _text(F.col("_i.picture")).alias("event_picture"), support.alias("support"))


def atom_entries(df: DataFrame, body: str = "body", most: int = 25) -> DataFrame:
    """Up to ``most`` first entries of each Atom payload, with the links other than the entry's own in links."""
    keep = [c for c in df.columns if c != body]
    x = df.withColumn("_x", F.from_xml(body, ATOM, {"ignoreNamespace": "true"})).select(*keep, F.posexplode(F.slice("_x.entry", 1, most)).alias("_p", "_e"))
    own = F.get(F.col("_e.link"), F.lit(0))["_href"]
    links = F.regexp_extract_all(F.coalesce(F.col("_e.content"), F.lit("")), F.lit(r"https?://[^\s\"'<>]+"), F.lit(0))
    return x.select(*keep, (F.col("_p") + 1).alias("rank"), F.col("_e.id").alias("entry_id"), _text(F.col("_e.title")).alias("title"), feed_time(F.coalesce("_e.published", "_e.updated")).alias("published"), own.alias("url"), F.array_distinct(F.filter(links, lambda u: ~u.eqNullSafe(own))).alias("links"))


def pools(df: DataFrame, body: str = "body") -> DataFrame:
    """One row per pool of a ``data`` list, or of a single ``data`` object; numbers that don't parse are null, not zero."""
    keep = [c for c in df.columns if c != body]
    data = F.get_json_object(body, "$.data")
    many = F.when(data.startswith("["), F.from_json(data, f"array<{POOL}>")).when(data.startswith("{"), F.array(F.from_json(data, POOL)))
    x = df.select(*keep, F.explode(many).alias("_d"))
    return x.select(
        *keep, "_d.id", F.col("_d.attributes.name").alias("name"), F.col("_d.attributes.address").alias("address"), feed_time(F.col("_d.attributes.pool_created_at")).alias("created"),
        F.col("_d.attributes.reserve_in_usd").try_cast("double").alias("reserve_usd"), F.col("_d.attributes.base_token_price_usd").try_cast("double").alias("price_usd"), F.col("_d.relationships.base_token.data.id").alias("token_id"),
    )


def growing_fees(df: DataFrame, body: str = "body", least_total: float = 50_000, least_change: float = 500) -> DataFrame:
    """Protocols of a fee overview whose day and growth reach both limits; sort by total24h where an order is wanted."""
    keep = [c for c in df.columns if c != body]
    x = df.select(*keep, F.explode(F.from_json(body, "struct<protocols:array<struct<name:string,total24h:double,change_30dover30d:double>>>")["protocols"]).alias("_p"))
    return x.select(*keep, "_p.name", "_p.total24h", F.col("_p.change_30dover30d").alias("change")).where((F.col("total24h") >= least_total) & (F.col("change") >= least_change))


def launches(df: DataFrame, body: str = "body", program: str = "pump") -> DataFrame:
    """Launches of a snapshot that have a mint, a creator, a numeric time and the right program; others are skipped."""
    keep = [c for c in df.columns if c != body]
    x = df.select(*keep, F.explode(F.from_json(body, LAUNCH)).alias("_l")).select(*keep, "_l.*")
    return x.where((F.col("program") == program) & (F.col("mint") != "") & (F.col("creator") != "") & F.col("created_timestamp").isNotNull()).withColumn("created_at", F.timestamp_millis("created_timestamp"))
