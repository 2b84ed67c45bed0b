"""Operators over rows in order: folds that hold one row at a time, and as-of joins whose hot keys are cut into ranges."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.shared import materialize

#: start() gives a key's first state; step(state, row) the next state and a row to emit, or None; end(state) a last row, or None.
Start = Callable[[], tuple]
Step = Callable[[tuple, tuple], tuple[tuple, tuple | None]]
End = Callable[[tuple], tuple | None]


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], columns: list[str], out: str, start: Start, step: Step, end: End | None = None) -> DataFrame:
    """(keys, out): ``step`` over the rows of each key in ``order``, ``row`` being the values of ``columns``.

    ``out`` declares the emitted columns. Rows are sorted within partitions and read as a stream, so a task holds one Arrow batch and one
    state however many rows a key has, and the time is linear in them. A step depends on the one before, so a key is one task's work; equal
    rows in ``order`` come in any order, which must be total where it matters. Null keys are a key; an empty table gives no rows."""
    fields = df.select(*keys).schema
    for f in df.sparkSession.createDataFrame([], out).schema:
        fields = fields.add(f)
    n, names = len(keys), [f.name for f in fields]
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, rows = None, None, []

        def ended() -> None:
            if key is not None and end is not None and (last := end(state)) is not None:
                rows.append((*key, *last))

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows.clear()
            return made

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:n] != key:
                    ended()
                    key, state = row[:n], start()
                state, emitted = step(state, row[n:])
                if emitted is not None:
                    rows.append((*key, *emitted))
            if rows:
                yield batch()
        ended()
        if rows:
            yield batch()

    rows = df.select(*keys, *columns, *[F.col(o).alias(f"_order{i}") for i, o in enumerate(order)])
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, *[f"_order{i}" for i in range(len(order))]).drop(*[f"_order{i}" for i in range(len(order))])
    return rows.mapInArrow(run, fields)


def asof_join(left: DataFrame, right: DataFrame, key: str, left_at: str, right_at: str, tie: str, columns: list[str], prefix: str = "asof_") -> DataFrame:
    """``left`` with ``columns`` of the newest row of ``right`` of its key, under ``prefix``: the greatest (``right_at``, ``tie``) that
    is not after ``left_at``; nulls where there is none.

    Both sides are put in one order and cut into ranges of about equal size, so a key with most of the rows is spread over many
    tasks. A row takes the last right row of its range; the rows before a range's first one of a key take what earlier ranges hand on, of which there
    is one row per range. A row without key or time finds nothing and stays; right rows without them are no state."""
    kind = F.struct(*[F.col(f"`{c}`") for c in columns])
    state = right.where(F.col(key).isNotNull() & F.col(right_at).isNotNull()).select(F.col(key).alias("k"), F.col(right_at).alias("at"), F.lit(0).alias("side"), F.col(tie).alias("tie"), F.struct(kind.alias("v")).alias("state"))
    rows = left.select(F.col(key).alias("k"), F.col(left_at).alias("at"), F.lit(1).alias("side"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("row"))
    salt = F.xxhash64("row")  # many rows of one key and time still fall into several ranges
    both = state.unionByName(rows.withColumns({"tie": F.lit(None).cast(state.schema["tie"].dataType), "salt": salt}), allowMissingColumns=True)
    ranged = materialize(both.repartitionByRange("k", "at", "side", "tie", "salt").withColumn("range", F.spark_partition_id()), "asof-ranges")
    newest = F.max_by("state", F.when(F.col("side") == 0, F.struct("at", "tie")))
    # A row for each range of a key; only keys that several ranges share hand anything on, two of a range at most.
    ends = ranged.groupBy("k", "range").agg(newest.alias("last"))
    before = Window.partitionBy("k").orderBy("range")
    handed = ends.withColumns({"ranges": F.count("*").over(Window.partitionBy("k")), "handed": F.last("last", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1))})
    handed = handed.where("ranges > 1").select(F.col("k").alias("hk"), F.col("range").alias("hr"), "handed")
    inside = Window.partitionBy("k", "range").orderBy("at", "side", "tie", "salt").rowsBetween(Window.unboundedPreceding, 0)
    found = ranged.withColumn("found", F.last("state", ignorenulls=True).over(inside)).where("side = 1")
    found = found.join(F.broadcast(handed), F.col("k").eqNullSafe(F.col("hk")) & (F.col("range") == F.col("hr")), "left").withColumn("found", F.coalesce("found", "handed"))
    known = F.col("k").isNotNull() & F.col("at").isNotNull()
    return found.select("row.*", *[F.when(known, F.col("found.v")[c]).alias(f"{prefix}{c}") for c in columns])


def time_buckets(at: Column, seconds: int) -> Column:
    """Number of the bucket of ``seconds`` that a timestamp lies in."""
    return F.floor(F.unix_micros(at.cast("timestamp")) / (seconds * 1_000_000)).cast("long")


def panes(df: DataFrame, key: list[str], actor: str, at: str, value: str | None = None, pane: int = 300) -> DataFrame:
    """(key, pane, actor, n[, total]): rows counted per actor in panes of ``pane`` seconds, the one shuffle that all window lengths share."""
    more = [F.sum(value).alias("total")] if value else []
    return df.where(F.col(at).isNotNull()).groupBy(*key, time_buckets(F.col(at), pane).alias("pane"), F.col(actor).alias("actor")).agg(F.count("*").alias("n"), *more)


def pane_features(df: DataFrame, key: str, actor: str, at: str, lengths: dict[str, int], pane: int = 300) -> DataFrame:
    """(key, pane, and for each name ``n_``, ``prior_``, ``acceleration_``, ``members_`` and ``dominance_``): for every pane in which a key is seen, over the
    last ``lengths[name]`` panes up to it: rows, rows of as many panes before, their ratio (null without any), distinct actors and the
    largest actor's share.

    Counts per actor and pane are made once; each is handed to the panes whose windows hold it, so all lengths come from the same rows and
    no window over a key's whole history is sorted. A null actor counts as rows but isn't a member."""
    own = panes(df, [key], actor, at, None, pane).withColumnRenamed(key, "k")
    own = materialize(own, "panes")
    seen = own.select("k", "pane").distinct()
    most = max(lengths.values())
    # To the panes that may look back on it, where the key is seen.
    spread = own.withColumn("to", F.explode(F.sequence(F.col("pane"), F.col("pane") + 2 * most - 1)))
    spread = spread.join(seen.select("k", F.col("pane").alias("to")), ["k", "to"]).withColumn("back", F.col("to") - F.col("pane"))
    each = spread.groupBy("k", "to", "actor").agg(*[F.sum(F.when(F.col("back") < m, F.col("n"))).alias(f"n{m}") for m in lengths.values()], *[F.sum(F.when(F.col("back").between(m, 2 * m - 1), F.col("n"))).alias(f"p{m}") for m in lengths.values()])
    out = []
    for name, m in lengths.items():
        n, prior = F.sum(f"n{m}"), F.coalesce(F.sum(f"p{m}"), F.lit(0))
        member = F.when(F.col("actor").isNotNull(), F.col(f"n{m}"))
        out += [n.alias(f"n_{name}"), prior.alias(f"prior_{name}"), F.try_divide(n, prior).alias(f"acceleration_{name}"), F.count(member).alias(f"members_{name}"), F.try_divide(F.max(member), n).alias(f"dominance_{name}")]
    return each.groupBy(F.col("k").alias(key), F.col("to").alias("pane")).agg(*out)
