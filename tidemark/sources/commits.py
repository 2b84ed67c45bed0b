"""Tables that are written together: each cut's folders become visible by one manifest, whole or not at all.

``<folder>/data/<cut>-<attempt>/<table>`` holds the rows, ``<folder>/log/<cut>.json`` says which attempt counts. A manifest
is written beside the log and moved to its place, which fails if another writer was first; what has no manifest is never read. That
only one writer gets a place is the promise of the store's rename; a local disk has a moment between its check and the move."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


def _paths(spark: SparkSession):
    """(Path, a path's file context): the file systems that Spark itself uses."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    return path, lambda p: jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsparkSession.sessionState().newHadoopConf()) if p.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsparkSession.sessionState().newHadoopConf())


def manifests(spark: SparkSession, folder: str) -> dict[int, dict[str, str]]:
    """Cut to the place of each of its tables, for all committed cuts in order; one short row a cut."""
    path, context = _paths(spark)
    log = path(f"{folder}/log")
    if not context(log).util().exists(log):
        return {}
    for wait in (0.1, 0.3, 1.0, None):  # a manifest that is just being moved may not be readable yet
        try:
            rows = spark.read.schema("cut long, tables map<string,string>").json(f"{folder}/log/*.json").where("cut IS NOT NULL").collect()
            break
        except Exception:
            if wait is None:
                raise
            time.sleep(wait)
    return {r.cut: r.tables for r in sorted(rows, key=lambda r: r.cut)}


def _is_committed(spark: SparkSession, folder: str, cut: int) -> bool:
    path, context = _paths(spark)
    at = path(f"{folder}/log/{cut:012d}.json")
    return context(at).util().exists(at)


def _delete(spark: SparkSession, place: str) -> None:
    path, context = _paths(spark)
    context(path(place)).delete(path(place), True)


def _publish(spark: SparkSession, folder: str, cut: int, tables: dict[str, str]) -> bool:
    """Moves the manifest into place; False if the cut has one already."""
    path, context = _paths(spark)
    own, place = path(f"{folder}/pending/{cut:012d}-{uuid.uuid4().hex}.json"), path(f"{folder}/log/{cut:012d}.json")
    fs = own.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    fs.mkdirs(place.getParent())
    out = fs.create(own, False)
    out.write(json.dumps({"cut": cut, "tables": tables}).encode())
    out.close()
    for wait in (0.1, 0.3, 1.0, 3.0):
        try:
            context(own).rename(own, place, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception:  # another writer was first, or the store failed for a moment: the log tells which
            if not _is_committed(spark, folder, cut):
                time.sleep(wait)
                continue
        won = manifests(spark, folder).get(cut) == tables
        if not won:
            fs.delete(own, False)
        return won
    raise PySparkException(f"the manifest of cut {cut} can't be moved into {folder}")


def commit_cut(folder: str, cut: int, tables: dict[str, DataFrame]) -> bool:
    """Writes all tables of a cut, then its manifest. A cut that has one stays as it is: a replay adds nothing, and of two
    writers of one cut the first to publish wins. False if nothing was committed. What a killed writer leaves is never read."""
    spark = next(iter(tables.values())).sparkSession
    if _is_committed(spark, folder, cut):
        return False
    data = f"{folder}/data/{cut:012d}-{uuid.uuid4().hex}"
    for name, rows in tables.items():
        rows.write.parquet(f"{data}/{name}")
    if _publish(spark, folder, cut, {name: f"{data}/{name}" for name in tables}):
        return True
    _delete(spark, data)
    return False


def read_committed(spark: SparkSession, folder: str, table: str, schema, before: int | None = None) -> DataFrame:
    """The rows of a table in all committed cuts (those below ``before``, if given); an empty frame before the first."""
    places = [x[table] for cut, x in manifests(spark, folder).items() if table in x and (before is None or cut < before)]
    return spark.read.schema(schema).parquet(*places) if places else spark.createDataFrame([], schema)


def append_once(folder: str, table: str, key: list[str], rows: DataFrame, most_tries: int = 20) -> int:
    """Commits the rows whose key no committed cut has, the first of each key by a hash of the row; returns the cut.

    The cut that was last when the keys were read fixes the number of the next one. A writer that finds it taken reads the keys of the cuts
    since and tries again, so writers at once never double a key and none is lost."""
    spark, tries = rows.sparkSession, 0
    own = rows.dropDuplicates(key)
    while True:
        done = manifests(spark, folder)
        cut = max(done, default=-1) + 1
        known = read_committed(spark, folder, table, rows.schema, cut).select(*key)
        fresh = own.join(known, [own[k].eqNullSafe(known[k]) for k in key], "left_anti")
        if commit_cut(folder, cut, {table: fresh}):
            return cut
        tries += 1
        if tries >= most_tries:
            raise PySparkException(f"no free cut in {folder} after {tries} tries")


def committing(folder: str, tables: Callable[[DataFrame], dict[str, DataFrame]]) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the tables of each micro-batch as one cut, of the batch's number."""

    def each(batch: DataFrame, number: int) -> None:
        batch.persist()
        commit_cut(folder, number, tables(batch))
        batch.unpersist()

    return each
