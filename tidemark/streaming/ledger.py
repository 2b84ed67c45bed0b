"""A run's ledger: what each cut of a streaming query read, kept, and dropped, from its progress and observed metrics."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidemark.operators.audits import stream_state
from tidemark.operators.relational import latest_per_key

ROW = "query_id string, run_id string, cut long, rows_in long, kept long, late long, duplicates long, ended string"
KEPT = "kept"


def kept_rows(df: DataFrame) -> DataFrame:
    """Counts the rows that pass here as those that the cut kept."""
    return df.observe(KEPT, F.count(F.lit(1)).alias("n"))


class RunLedger(StreamingQueryListener):
    """One row a cut, a few numbers each. Cuts without data that only move state on have no row."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        self.ended.clear()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows:
            kept = p.observedMetrics.get(KEPT)
            late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
            double = sum(dict(s.customMetrics).get("numDroppedDuplicateRows", 0) for s in p.stateOperators)
            self.rows.append((str(p.id), str(p.runId), p.batchId, p.numInputRows, kept and kept["n"], late, double, p.timestamp))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()

    def __enter__(self) -> RunLedger:
        self.spark = SparkSession.getActiveSession()
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.ended.wait(30)  # events come after the query's own end
        self.spark.streams.removeListener(self)

    def save(self, spark: SparkSession, folder: str) -> None:
        """Adds the rows so far to the ledger in ``folder``."""
        spark.createDataFrame(self.rows, ROW).coalesce(1).write.mode("append").parquet(folder)


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The newest row of every query's cuts, with ``balanced`` (every row read is kept, late or a duplicate) and the state
    of the cut. A cut that was repeated after a loss, or saved twice, counts once; one whose metrics are missing isn't balanced."""
    rows = latest_per_key(spark.read.schema(ROW).parquet(folder).withColumn("_key", F.struct("query_id", "cut")), "_key", [F.col("ended"), F.col("run_id")], ["query_id", "cut", "rows_in", "kept", "late", "duplicates"])
    balanced = F.coalesce(F.col("kept") + F.col("late") + F.col("duplicates") == F.col("rows_in"), F.lit(False))
    return rows.drop("_key").withColumn("balanced", balanced).withColumn("state", stream_state(F.lit(True), F.col("late"), F.col("kept")))
