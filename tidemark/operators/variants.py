"""Walks over semi-structured payloads as VARIANT, one lateral explode a level: no Python, no shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that a database takes for booleans.
TRUE, FALSE = ["true", "t", "yes", "y", "on", "1"], ["false", "f", "no", "n", "off", "0"]
#: Keys whose strings are links.
LINK_KEYS = ["uri", "url", "href"]


def raw_boolean(payload: Column, path: str) -> Column:
    """A flag in a JSON text, whether it is a boolean, a number or a word; null if absent or anything else."""
    said = F.lower(F.trim(F.get_json_object(payload, path)))
    return F.when(said.isin(TRUE), True).when(said.isin(FALSE), False)


def leaves(df: DataFrame, payload: str, deepest: int = 12) -> DataFrame:
    """The other columns, path, key (null in a list), value (text) and kind of every scalar in the JSON text ``payload``.

    A kind is a type name, ``MALFORMED`` for a text that isn't JSON (path ``$``), or ``TOO_DEEP`` for what stands below
    ``deepest`` levels, whose JSON is then the value: a gap is a row, never an absence. A null payload, an empty object and an empty
    list have no leaves. Every row is walked by itself, so a payload's own size is all that bounds a task."""
    keep = [c for c in df.columns if c != payload]
    level = df.where(F.col(payload).isNotNull()).select(*keep, F.col(payload).alias("_text"), F.try_parse_json(payload).alias("_v"))
    level = level.select(*keep, F.when(F.col("_v").isNull(), F.col("_text")).alias("_text"), F.lit("$").alias("path"), F.lit(None).cast("string").alias("key"), "_v", F.lit(0).alias("_depth"))
    # A row that has nothing below it (a scalar, an empty list, no JSON) stays as it is, so one pass reaches all levels.
    for _ in range(deepest):
        inner = df.sparkSession.tvf.variant_explode_outer(F.col("_v").outer()).select(F.col("pos").alias("_pos"), F.col("key").alias("_key"), F.col("value").alias("_value"))
        step = F.when(F.col("_key").isNull(), F.concat(F.lit("["), F.col("_pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "_key"))
        under, own = F.col("_pos").isNotNull(), lambda below, here: F.when(F.col("_pos").isNotNull(), below).otherwise(here)
        level = level.lateralJoin(inner).select(*keep, "_text", own(F.concat("path", step), F.col("path")).alias("path"), own(F.col("_key"), F.col("key")).alias("key"), own(F.col("_value"), F.col("_v")).alias("_v"), (F.col("_depth") + under.cast("int")).alias("_depth"))
    # VOID is JSON's null: a leaf without a value.
    level = level.withColumn("_kind", F.regexp_extract(F.schema_of_variant("_v"), "^[A-Z]+", 0))
    nested = F.coalesce(F.col("_kind").isin("OBJECT", "ARRAY"), F.lit(False))
    bad = F.col("_text").isNotNull()
    value = F.when(bad, F.col("_text")).when(nested, F.to_json("_v")).otherwise(F.col("_v").cast("string"))
    kind = F.when(bad, F.lit("MALFORMED")).when(nested, F.lit("TOO_DEEP")).otherwise(F.col("_kind"))
    return level.where(~nested | (F.col("_depth") == deepest)).select(*keep, "path", "key", value.alias("value"), kind.alias("kind"))


def links(df: DataFrame, payload: str, deepest: int = 12) -> DataFrame:
    """The leaves that are links: strings under one of ``LINK_KEYS`` or that start with ``http``, none of them directly in a list.
    Payloads that can't be read, or not to their ends, stay as ``MALFORMED`` and ``TOO_DEEP``."""
    link = (F.col("kind") == "STRING") & F.col("key").isNotNull() & (F.lower("key").isin(LINK_KEYS) | F.col("value").startswith("http"))
    return leaves(df, payload, deepest).where(link | F.col("kind").isin("MALFORMED", "TOO_DEEP"))
