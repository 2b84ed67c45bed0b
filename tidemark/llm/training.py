"""Bounded samples of labelled rows for models that are fitted in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def held_out(key: str = "doc_id"):
    """True for the third of the keys that no label is learnt from: crc32(key as text) mod 3 is 1."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(rows: DataFrame, most_rows: int, most_bytes: int, key: str = "doc_id", text: str = "text", label: str = "label") -> DataFrame:
    """(label, text) of ``most_rows`` rows and about ``most_bytes`` bytes of whole texts at most, by a hash of key and text.

    Both bounds hold exactly but for one text: each of the ``most_rows`` commonest labels gets a share by its distinct
    rows, of one row at least, and in it texts over an eighth of the label's bytes come last. Repeated rows count once, so
    no key or text fills the sample. Rows with a null label or text aren't drawn; an empty table gives no rows.
    """
    own = rows.select(F.col(label).alias("label"), F.col(text).alias("text"), F.xxhash64(F.col(key), F.col(text), F.lit("sample")).alias("h")).where(F.col("label").isNotNull() & F.col("text").isNotNull())
    sizes = own.groupBy("label").agg(F.approx_count_distinct("h", 0.02).alias("n")).orderBy(F.desc("n"), "label").limit(most_rows).collect()
    total = sum(r.n for r in sizes)
    # A label's quota of rows, and the part of the hashes that surely holds as many distinct rows.
    plan = [(r.label, q := max(1, most_rows * r.n // max(total, 1)), max(1, most_bytes * r.n // max(total, 1)), min(1.0, (1.3 * q + 20) / max(r.n, 1))) for r in sizes]
    quota = rows.sparkSession.createDataFrame(plan, rows.select(F.col(label).alias("label")).schema.add("quota", "long").add("bytes", "long").add("part", "double"))
    drawn = own.join(F.broadcast(quota), "label").where(F.pmod("h", F.lit(1 << 30)) < F.col("part") * (1 << 30))
    drawn = drawn.groupBy("label", "h", "quota", "bytes").agg(F.first("text").alias("text")).withColumn("size", F.octet_length("text").cast("long"))
    by = Window.partitionBy("label").orderBy(F.col("size") * 8 > F.col("bytes"), "h")
    drawn = drawn.withColumn("nth", F.row_number().over(by)).withColumn("held", F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, -1)))
    return drawn.where((F.col("nth") <= F.col("quota")) & ((F.col("nth") == 1) | (F.col("held") + F.col("size") <= F.col("bytes")))).select("label", "text", "h")


def fit_in_task(drawn: DataFrame, fit: Callable[[list, list], bytes | None]) -> bytes | None:
    """``fit(texts, labels)`` over a bounded sample, in one task of an executor; its bytes come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels = [], []
        for batch in batches:
            labels += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
        if texts and (got := fit(texts, labels)) is not None:
            yield pa.RecordBatch.from_pydict({"model": pa.array([got], pa.binary())})

    rows = drawn.repartition(1).sortWithinPartitions("h", "label").select("label", "text").mapInArrow(run, "model binary").collect()
    return bytes(rows[0].model) if rows else None
