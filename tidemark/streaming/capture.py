"""Bounded captures of event streams with Structured Streaming: file source, watermark, cuts that can be replayed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Seconds of rewind, of a first read, of the longest look back, and of clock tolerance.
REWIND, BASELINE, LOOKBACK, AHEAD = 12, 16 * 60, 35 * 3600, 30


def start_cursor(prior_us: Column, now_us: Column) -> Column:
    """struct(start_us, mode): shortly before a usable prior cursor, else a short baseline whose prehistory is unknown."""
    floor = now_us - LOOKBACK * 1_000_000
    usable = F.coalesce(prior_us.between(floor, now_us + AHEAD * 1_000_000), F.lit(False))
    return F.struct(F.when(usable, F.greatest(floor, prior_us - REWIND * 1_000_000)).otherwise(now_us - BASELINE * 1_000_000).alias("start_us"), F.when(usable, "PRIOR_CURSOR_REWIND").otherwise("BASELINE_16M_UNKNOWN_PREHISTORY").alias("mode"))


def near_live(ts_us: Column, now_us: Column) -> Column:
    """From five seconds before to three seconds after the clock; an unknown time is not."""
    return F.coalesce(ts_us.between(now_us - 5_000_000, now_us + 3_000_000), F.lit(False))


def event_id(*parts: Column) -> Column:
    """SHA-256 of the parts joined by NUL; nulls count as empty."""
    return F.sha2(F.concat_ws("\x00", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def file_events(spark: SparkSession, path: str, schema, ts: str, files_per_cut: int = 100) -> DataFrame:
    """Stream of Parquet files (a folder or a glob) with ``ts`` as a timestamp that watermarks accept."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_cut).parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def unique_events(events: DataFrame, key: list[str], ts: str, late: str = "10 minutes") -> DataFrame:
    """First arrival of each key; state is kept only as long as the watermark needs it."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def run_cuts(events: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Reads what there is, in cuts, and ends. A cut that was lost is handed to ``each`` again under the same number."""
    query = events.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def capture(events: DataFrame, checkpoint: str, folder: str) -> None:
    """Writes each cut to a folder of its own, replaced if the cut is repeated: every event ends up there once."""

    def write(cut: DataFrame, number: int) -> None:
        cut.write.mode("overwrite").parquet(f"{folder}/cut={number}")

    run_cuts(events, checkpoint, write)


def window_counts(events: DataFrame, ts: str, by: list[str], length: str, checkpoint: str, folder: str, slide: str | None = None) -> None:
    """Counts per window and group; each cut replaces the whole (small) result in ``folder``."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    counts = events.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")

    def write(result: DataFrame, number: int) -> None:
        result.write.mode("overwrite").parquet(folder)

    run_cuts(counts, checkpoint, write, "complete")


def merge_posts(posts: DataFrame, key: str = "post_hash") -> DataFrame:
    """One row per post: first and last observation, and the sorted union of buckets and links (12 at most)."""
    g = posts.groupBy(key).agg(F.min("observed_at").alias("first_observed_at"), F.max("observed_at").alias("last_observed_at"), F.flatten(F.collect_set("buckets")).alias("b"), F.flatten(F.collect_set("links")).alias("l"))
    return g.select(key, "first_observed_at", "last_observed_at", F.array_sort(F.array_distinct("b")).alias("buckets"), F.slice(F.array_sort(F.array_distinct("l")), 1, 12).alias("links"))
