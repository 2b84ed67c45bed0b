"""Vector bin packing of documents into shards.

Law ``bytes``: shard sizes near equal, with tokens and rows balanced jointly. Groups of equal texts stay in one shard
unless they alone would unbalance the shards; such a group is dealt out in parts, each placed as a group of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.shared import materialize, release


def utf8_size(text: Column | str) -> Column:
    """Bytes of the UTF-8 text (null: none)."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def place(sizes: np.ndarray, left: np.ndarray, turn: int = 0) -> np.ndarray:
    """Shard of each row of ``sizes`` (groups x resources, in the unit of ``left``, the shards' residual capacities, which
    is updated): large groups first, each to the highest dot product of group and residual; ties go round from ``turn``."""
    by_rank = (np.arange(len(left)) + turn) % len(left)
    weight = np.array([8.0, 1.0, 1.0])  # where resources conflict, bytes decide: theirs is the law that holds
    out = np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes.max(axis=1), kind="stable") if len(sizes) else ():
        s = by_rank[int(np.argmax((left @ (sizes[i] * weight))[by_rank]))]
        left[s] -= sizes[i]
        out[i] = s
    return out


def assign_shards(docs: DataFrame, n_shards: int = 24, bucket_rows: int = 8192, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, size, text_crc32, shard, slot) for every row of ``docs``.

    Tokens are counted as words, with one for the end. Rows are slimmed to (key, sizes, fingerprint) before any shuffle.
    Groups over 1/64 of a shard's share are fewer than 128 times the shards at any input size: those are placed first, on
    the driver, by their sums; of them, groups over half a shard's share are dealt out in parts. Other groups of more than
    an eighth of ``bucket_rows`` rows are placed by their sums too, about 4,096 of them in a task, and only then are their
    rows spread over the buckets. All others are hashed to buckets of about ``bucket_rows`` rows, which are packed
    independently against the capacity that the large groups leave; so a task holds one bucket, whatever the groups' sizes.
    Nulls: a null text has size 8 and the checksum of no bytes and shares a group with the empty text; null keys are
    placed as any row. Repeated rows are placed separately. An empty table gives no rows. Extra columns are ignored.
    """
    spark = docs.sparkSession
    whole = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(
        F.col(key).alias("k"), (utf8_size(F.col(text)) + 8).alias("size"), F.crc32(F.encode(whole, "UTF-8")).alias("crc"),
        F.xxhash64(whole).alias("g1"), F.xxhash64(whole, F.lit(7)).alias("g2"), (F.regexp_count(whole, F.lit(r"\S+")) + 1).cast("long").alias("tokens"),
    )
    slim = materialize(slim, "shard-rows")
    n, total = slim.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if not n:
        return spark.createDataFrame([], T.StructType([docs.schema[key], *(T.StructField(c, t) for c, t in (("size", T.LongType()), ("text_crc32", T.LongType()), ("shard", T.IntegerType()), ("slot", T.LongType())))]))
    buckets = max(1, math.ceil(n / bucket_rows))
    groups = slim.groupBy("g1", "g2").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"))
    fine, whole_rows = 64 * n_shards, max(1, bucket_rows // 8)
    groups = materialize(groups.where((F.col("rows") * fine > n) | (F.col("bytes") * fine > total) | (F.col("rows") > whole_rows)), "shard-groups")
    is_large = (F.col("rows") * fine > n) | (F.col("bytes") * fine > total)
    large = groups.where(is_large).orderBy("g1", "g2").collect()  # fewer than 2 * fine rows
    all_tokens = slim.agg(F.sum("tokens")).first()[0]
    parts = [(r.g1, r.g2, min(r.rows, math.ceil(2 * n_shards * max(r.rows / n, r.bytes / total)))) for r in large]
    sized = spark.createDataFrame(parts, "g1 long, g2 long, parts int")
    parted = slim.join(F.broadcast(sized), ["g1", "g2"], "left").withColumn("part", F.pmod(F.xxhash64("k", F.lit(3)), F.coalesce("parts", F.lit(1))).cast("int"))
    units = parted.where(F.col("parts").isNotNull()).groupBy("g1", "g2", "part").agg(F.sum("size"), F.sum("tokens"), F.count("*")).orderBy("g1", "g2", "part").collect()
    capacity = np.full((n_shards, 3), 1.0 / n_shards)
    fixed = place(np.array([u[3:] for u in units], float).reshape(-1, 3) / [max(total, 1), max(all_tokens, 1), n], capacity).tolist()
    preset = spark.createDataFrame([(*u[:3], s) for u, s in zip(units, fixed, strict=True)], "g1 long, g2 long, part int, preset int")
    capacity = np.maximum(capacity, 0) + 1e-12
    capacity /= capacity.sum(axis=0)
    parted = parted.join(F.broadcast(preset), ["g1", "g2", "part"], "left").drop("parts", "part")

    def settle(ids: tuple, rows: pa.Table) -> pa.Table:
        sizes = np.stack([rows[c].to_numpy() for c in ("bytes", "tokens", "rows")], axis=1).astype(float)
        order = np.lexsort([rows["g2"].to_numpy(), rows["g1"].to_numpy()])
        shard = np.empty(len(sizes), np.int32)
        shard[order] = place(sizes[order] / sizes.sum(axis=0), capacity.copy(), ids[0].as_py() * 5)
        return pa.table([rows["g1"], rows["g2"], pa.array(shard)], names=["g1", "g2", "settled"])

    middle = groups.where(~is_large)
    if n_middle := middle.count():
        lots = F.pmod(F.xxhash64("g2", "g1", F.lit(11)), F.lit(math.ceil(n_middle / 4096))).cast("int")
        middle = middle.withColumn("lot", lots).groupBy("lot").applyInArrow(settle, "g1 long, g2 long, settled int")
        # One row a group meets its many rows: Spark broadcasts it if it is small, and else splits skewed keys.
        parted = parted.join(middle, ["g1", "g2"], "left").withColumn("preset", F.coalesce("preset", "settled")).drop("settled")
    spread = F.when(F.col("preset").isNull(), F.xxhash64("g1", "g2")).otherwise(F.xxhash64("k", "crc", F.lit(5)))
    parted = parted.withColumn("bucket", F.pmod(spread, F.lit(buckets)).cast("int"))

    kind = docs.schema[key].dataType.simpleString()

    def pack(ids: tuple, rows: pa.Table) -> pa.Table:
        shard = pc.fill_null(rows["preset"], -1).to_numpy().astype(np.int32)
        free = np.flatnonzero(shard < 0)
        if len(free):
            pair = np.stack([rows["g1"].to_numpy()[free], rows["g2"].to_numpy()[free]], axis=1)
            first, code = np.unique(pair, axis=0, return_inverse=True)
            sizes = np.stack([np.bincount(code, w, len(first)) for w in (rows["size"].to_numpy()[free], rows["tokens"].to_numpy()[free], np.ones(len(free)))], axis=1).astype(float)
            shard[free] = place(sizes / sizes.sum(axis=0), capacity.copy(), ids[0].as_py() * 7)[code]
        # Keys stay Arrow values: through pandas, a null among them would turn the others into floats.
        rows = rows.append_column("shard", pa.array(shard, pa.int32()))
        rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("shard", "k", "crc", "size")]))
        count = np.bincount(shard, minlength=n_shards)
        nth = np.arange(len(shard)) - np.repeat(np.cumsum(count) - count, count)
        return rows.select(["k", "size", "crc", "bucket", "shard"]).append_column("nth", pa.array(nth, pa.int64()))

    placed = parted.groupBy("bucket").applyInArrow(pack, f"k {kind}, size long, crc long, bucket int, shard int, nth long")
    placed = materialize(placed, "shard-placed")
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    release(slim)
    release(groups)
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))  # a row per shard and bucket
    return placed.join(base, ["shard", "bucket"]).select(F.col("k").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("base") + F.col("nth")).alias("slot"))
