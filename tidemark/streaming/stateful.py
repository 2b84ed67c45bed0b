"""State that outlives a cut: folds of each key's rows whose state the stream keeps, poll cursors, late rows as gaps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.operators.ordered import Start, Step

#: Keys and values of RocksDB's state store, which arbitrary state needs; set before the query starts.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def as_texts(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, list[Callable]]:
    """The rows with the whole numbers of ``columns``, also those in arrays, as texts, and a function for each column that reads its cells
    back: pandas would turn a column of whole numbers with a null in it into doubles."""
    readers = []
    for c in columns:
        kind = rows.schema[c].dataType
        if isinstance(kind, T.IntegralType):
            rows, read = rows.withColumn(c, F.col(c).cast("string")), int
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.IntegralType):
            rows, read = rows.withColumn(c, F.col(c).cast("array<string>")), lambda x: [None if y is None else int(y) for y in x]
        elif isinstance(kind, T.ArrayType):
            read = list
        else:
            read = lambda x: x.item() if hasattr(x, "item") else x
        readers.append(lambda x, read=read: None if x is None or x is pd.NaT or isinstance(x, float) and x != x else read(x))
    return rows, readers


class FoldProcessor(StatefulProcessor):
    """``step`` over a key's rows in order, from the state that the cuts before have left."""

    def __init__(self, n_order: int, readers: list[Callable], state: str, start: Start, step: Step, out: list[str]):
        self.n_order, self.readers, self.kind, self.start, self.step, self.out = n_order, readers, state, start, step, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", self.kind)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # Only the rows of one cut and key are here, which the source bounds. The columns are those of the order, then the step's.
        cut = [tuple(read(x) for read, x in zip(self.readers, row, strict=True)) for batch in rows for row in zip(*(batch[c] for c in batch.columns[-len(self.readers) :]), strict=True)]
        cut.sort(key=lambda row: [(x is not None, x) for x in row[: self.n_order]])
        state, made = tuple(self.state.get()) if self.state.exists() else self.start(), []
        for row in cut:
            state, emitted = self.step(state, row[self.n_order :])
            if emitted is not None:
                made.append((*key, *emitted))
        self.state.update(tuple(state))
        yield pd.DataFrame(made, columns=self.out, dtype=object)

    def close(self) -> None:
        pass


def stream_fold(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], out: str, state: str, start: Start, step: Step) -> DataFrame:
    """A stream's ``ordered_fold`` that emits in each cut and carries every key's state (declared by ``state``) to the next.

    Within a cut rows are folded in ``order``, nulls first; across cuts they come as they arrive, so a step that needs an order must say what a
    row that is late is. The state is checkpointed with the offsets: a restart goes on where the last cut ended."""
    for k, v in STATE_STORE.items():
        rows.sparkSession.conf.set(k, v)
    fields = rows.select(*keys).schema
    for f in rows.sparkSession.createDataFrame([], out).schema:
        fields = fields.add(f)
    named = [F.col(c).alias(f"_{i}") for i, c in enumerate([*order, *columns])]
    told, readers = as_texts(rows.select(*keys, *named), [f"_{i}" for i in range(len(named))])
    processor = FoldProcessor(len(order), readers, state, start, step, [f.name for f in fields])
    return told.groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=fields, outputMode="Append", timeMode="None")


def listing_step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
    """A poll of a listing, newest item first. State: the cursor; row: (poll, items, errors).

    OK if the page reaches the cursor: what stands before it is fresh. UNKNOWN if an error left nothing, else PARTIAL, all of it fresh.
    The cursor moves to the newest item at the first poll and after one that reached it, never across a gap."""
    (cursor,) = state
    poll, items, errors = row
    items = items or []
    overlap = items.index(cursor) if cursor is not None and cursor in items else -1
    status = "OK" if overlap >= 0 else "UNKNOWN" if errors and not items else "PARTIAL"
    fresh = overlap if overlap >= 0 else len(items)
    after = items[0] if items and (cursor is None or overlap >= 0) else cursor
    return (after,), (poll, status, fresh, cursor, after)


def signature_step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
    """A poll of signatures down to the cursor. State: the cursor; row: (poll, newest, rows, complete, errors).

    UNKNOWN if an error left nothing; PARTIAL for the first poll and one whose last page was full; else OK. A complete poll with rows
    moves the cursor."""
    (cursor,) = state
    poll, newest, n, complete, errors = row
    status = "UNKNOWN" if errors and not n else "PARTIAL" if not complete or cursor is None else "OK"
    after = newest if complete and n else cursor
    return (after,), (poll, status, cursor, after)


class LateProcessor(StatefulProcessor):
    """Rows that are not older than ``delay`` behind the newest of the cuts before; counts of the others by window."""

    def __init__(self, readers: list[Callable], delay_us: int, window_us: int, out: list[str]):
        self.readers, self.delay, self.window, self.out = readers, delay_us, window_us, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = self.newest.get()[0] if self.newest.exists() else None
        newest, gaps = before, {}
        for batch in rows:
            made = []
            for us, own in zip(*(map(read, batch[c]) for read, c in zip(self.readers, batch.columns[-2:], strict=True)), strict=True):
                if us is None or before is not None and us < before - self.delay:
                    gap = ("NO_TIME", None) if us is None else ("LATE", us // self.window * self.window)
                    gaps[gap] = gaps.get(gap, 0) + 1
                else:
                    made.append((*key, "ROW", us, own, 1))
                if us is not None and (newest is None or us > newest):
                    newest = us
            yield pd.DataFrame(made, columns=self.out, dtype=object)
        if newest is not None:
            self.newest.update((newest,))
        yield pd.DataFrame([(*key, kind, w, None, n) for (kind, w), n in gaps.items()], columns=self.out, dtype=object)

    def close(self) -> None:
        pass


def rows_and_gaps(rows: DataFrame, key: str, at_us: str, id: str, delay_s: int, window_s: int) -> DataFrame:
    """(key, kind, us, id, n) of a stream: each captured row as ``ROW``, and per cut, key and window a gap row with the number of
    rows that came too late (``LATE``) or have no time (``NO_TIME``). Nothing vanishes: the sum of ``n`` is the number of rows.

    A row is late if it is more than ``delay_s`` older than the newest row of its key in the cuts before; the rows of one cut don't
    make each other late, so the result doesn't depend on their order."""
    for k, v in STATE_STORE.items():
        rows.sparkSession.conf.set(k, v)
    fields = rows.select(key).schema.add("kind", "string").add("us", "long")
    fields = fields.add(id, rows.schema[id].dataType).add("n", "long")
    told, readers = as_texts(rows.select(key, F.col(at_us).cast("long").alias("_us"), F.col(id).alias("_id")), ["_us", "_id"])
    processor = LateProcessor(readers, delay_s * 1_000_000, window_s * 1_000_000, [f.name for f in fields])
    return told.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=fields, outputMode="Append", timeMode="None")


def fed_in_order(rows: DataFrame, part, folder: str, parts: int) -> None:
    """Lands ``rows`` as files that a file stream takes one after the other: part 0 first. ``part`` is a column of 0 to ``parts`` - 1."""
    for i in range(parts):
        rows.where(part == i).coalesce(1).write.mode("append").parquet(folder)
