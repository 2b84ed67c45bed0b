"""A replayable source over a landed feed: offsets are source times, so a reader says from when on it wants the events.

``land_feed`` cuts the feed into slices of source time. A query over ``format("replay")`` starts shortly before a prior cursor, or with a
short baseline whose prehistory is a row of its own; each cut covers a span of source time, rewound a little, whose slices
alone are listed and read. Offsets live in the query's checkpoint, so a restart goes on at the same source time."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from tidemark.streaming.capture import AHEAD, BASELINE, LOOKBACK, REWIND

SECOND = 1_000_000
SLICE = re.compile(r"slice=(-?\d+)$")
KINDS = ("EVENT", "UNKNOWN_PREHISTORY")


def land_feed(rows: DataFrame, folder: str, at_us: str, slice_s: int = 3600) -> None:
    """Appends the rows to the feed, in folders by the second at which their slice of source time begins. Rows without a time go to
    the slice before all others, where no cursor reaches them."""
    begin = F.floor(F.col(at_us) / (slice_s * SECOND)).cast("long") * slice_s
    rows.withColumn("slice", F.coalesce(begin, F.lit(-1))).write.mode("append").partitionBy("slice").parquet(folder)


def first_cursor(prior_us: int | None, now_us: int) -> tuple[int, str]:
    """Where a first read starts, and why: a usable prior cursor rewound, never beyond the look-back, or a short baseline."""
    floor = now_us - LOOKBACK * SECOND
    if prior_us is not None and floor <= prior_us <= now_us + AHEAD * SECOND:
        return max(floor, prior_us - REWIND * SECOND), "PRIOR_CURSOR_REWIND"
    return now_us - BASELINE * SECOND, "BASELINE_16M_UNKNOWN_PREHISTORY"


@dataclass
class Span(InputPartition):
    """The events of one file with ``after`` < time <= ``until``, or one row that says that what lies before ``until`` is unknown."""

    path: str | None
    after: int
    until: int


class ReplayReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.folder, self.at = schema, options["path"], options.get("at", "us")
        self.step, self.slice = int(options.get("step_s", 3600)) * SECOND, int(options.get("slice_s", 3600))
        self.now = int(options["now_us"]) if "now_us" in options else None
        self.prior = int(options["prior_us"]) if "prior_us" in options else None
        self.reached: int | None = None

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder) if ":/" in self.folder else (fs.LocalFileSystem(), self.folder)

    def _slices(self) -> list[int]:
        store, path = self._store()
        return sorted(int(m[1]) for x in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if (m := SLICE.search(x.path)))

    def _files(self, s: int) -> list[str]:
        store, path = self._store()
        return [f.path for f in store.get_file_info(fs.FileSelector(f"{path}/slice={s}")) if f.path.endswith(".parquet")]

    def _head(self) -> int:
        """The newest time in the feed, from the footers of its last slice: what a feed that lands in order has landed."""
        slices, store = self._slices(), self._store()[0]
        if not slices or slices[-1] < 0:
            return 0
        found = []
        for path in self._files(slices[-1]):
            footer = pq.read_metadata(path, filesystem=store)
            at = footer.schema.names.index(self.at)
            found += [footer.row_group(i).column(at).statistics.max for i in range(footer.num_row_groups) if footer.row_group(i).column(at).statistics is not None]
        return max((x for x in found if x is not None), default=slices[-1] * SECOND)

    def initialOffset(self) -> dict:
        start, mode = first_cursor(self.prior, self.now if self.now is not None else self._head())
        return {"us": start, "mode": mode, "first": 1}

    def latestOffset(self) -> dict:
        # A span of source time is a cut; Spark asks again until nothing is left.
        head = self._head()
        if self.reached is None:
            self.reached = min(head, self.initialOffset()["us"])
        self.reached = max(self.reached, min(head, self.reached + self.step))
        return {"us": self.reached, "mode": "", "first": 0}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        self.reached = max(self.reached or 0, end["us"])
        out = [Span(None, 0, start["us"])] if start["first"] and start["mode"] == "BASELINE_16M_UNKNOWN_PREHISTORY" else []
        if end["us"] <= start["us"]:
            return out
        after = start["us"] - (0 if start["first"] else REWIND * SECOND)
        for s in self._slices():
            if s >= 0 and (s + self.slice) * SECOND > after and s * SECOND <= end["us"]:
                out += [Span(path, after, end["us"]) for path in self._files(s)]
        return out

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        names = [f.name for f in self.schema]
        if partition.path is None:
            row = {f.name: pa.nulls(1, to_arrow_type(f.dataType)) for f in self.schema} | {"kind": pa.array([KINDS[1]]), self.at: pa.array([partition.until], pa.int64())}
            yield pa.RecordBatch.from_arrays([row[n] for n in names], names=names)
            return
        own = ds.dataset(partition.path, format="parquet", filesystem=self._store()[0])
        within = (pc.field(self.at) > partition.after) & (pc.field(self.at) <= partition.until)
        for batch in own.to_batches(columns=[n for n in names if n != "kind"], filter=within):
            if batch.num_rows:
                columns = {n: batch.column(n) for n in batch.schema.names} | {"kind": pa.array([KINDS[0]] * batch.num_rows)}
                yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)


class ReplaySource(DataSource):
    """Options: path; at (column of microseconds); slice_s (as landed); step_s (source time a cut); now_us (the clock at the
    first start; by default the newest time in the feed); prior_us (the cursor of an earlier run). The schema must be given; ``kind`` is EVENT or UNKNOWN_PREHISTORY."""

    @classmethod
    def name(cls) -> str:
        return "replay"

    def streamReader(self, schema: StructType) -> ReplayReader:
        return ReplayReader(schema, self.options)


def replay(spark: SparkSession, folder: str, schema: str, **options) -> DataFrame:
    """A stream over a landed feed: the columns of ``schema`` (DDL, with the time in microseconds) and ``kind``."""
    spark.dataSource.register(ReplaySource)
    reader = spark.readStream.format("replay").schema(f"{schema}, kind string").option("path", folder)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def run_to_end(stream: DataFrame, checkpoint: str, each) -> None:
    """Hands every cut up to the end of the feed to ``each``, then stops; a later call goes on from the checkpoint."""
    query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
