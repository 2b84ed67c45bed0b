"""Sinks that can be repeated: raw batches that keep their first arrival, snapshots, and what a run read and wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

BATCH_KEY = ["source", "chain", "event_class", "window_start", "window_end"]


def raw_batches(pages: DataFrame, items: str = "items", arrived: str = "ingest_time") -> DataFrame:
    """One row per batch of landed pages (BATCH_KEY, arrival, array of items): batch_id, item_count, payload_json. Empty
    pages are none; of several pages of a batch the first stays, by arrival, then by payload."""
    x = pages.where(F.size(items) > 0).withColumn("batch_id", F.concat_ws("|", *[F.col(c).cast("string") for c in BATCH_KEY]))
    x = x.select("batch_id", *BATCH_KEY, arrived, F.size(items).alias("item_count"), F.to_json(items).alias("payload_json"))
    first = F.min_by(F.struct(*[c for c in x.columns if c != "batch_id"]), F.struct(arrived, F.xxhash64("payload_json")))
    return x.groupBy("batch_id").agg(first.alias("_b")).select("batch_id", "_b.*")


def append_new(rows: DataFrame, path: str, key: list[str]) -> None:
    """Appends the rows whose key isn't in the Parquet table ``path`` yet; a repeated call adds nothing."""
    spark = rows.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
        rows = rows.join(spark.read.parquet(path).select(*key).distinct(), key, "left_anti")
    rows.write.mode("append").parquet(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    """Replaces the snapshot in ``path``: compact JSON lines, nulls left out."""
    df.write.mode("overwrite").json(path)


def with_usage(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """The rows, and their number (``rows``) once an action has run over them, without a scan of its own."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen
