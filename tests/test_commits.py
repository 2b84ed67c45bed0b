"""Cuts over several tables: whole or unseen, replays add nothing, writers at once don't double a key."""

import threading

import pytest
from pyspark.sql import functions as F

from tidemark.shared import new_folder
from tidemark.sources import commits as C

KIND = "k long, v string"


def rows(spark, ids, v="x"):
    return spark.createDataFrame([(i, v) for i in ids], KIND)


def test_a_cut_is_seen_whole_or_not_at_all(spark):
    folder = new_folder(spark, "commits")
    assert C.read_committed(spark, folder, "a", KIND).count() == 0
    broken = rows(spark, [1]).select(F.raise_error(F.lit("killed")).cast("long").alias("k"), "v")
    with pytest.raises(Exception, match="killed"):
        C.commit_cut(folder, 0, {"a": rows(spark, [1, 2]), "b": broken})  # the first table is written, the second fails
    assert C.read_committed(spark, folder, "a", KIND).count() == 0
    assert C.commit_cut(folder, 0, {"a": rows(spark, [1, 2]), "b": rows(spark, [3])})
    assert [C.read_committed(spark, folder, t, KIND).count() for t in "ab"] == [2, 1]


def test_a_replay_adds_nothing(spark):
    folder = new_folder(spark, "commits")
    assert C.commit_cut(folder, 7, {"a": rows(spark, [1])})
    assert not C.commit_cut(folder, 7, {"a": rows(spark, [1, 2])})
    assert C.commit_cut(folder, 8, {"a": rows(spark, [9])})
    assert sorted(r.k for r in C.read_committed(spark, folder, "a", KIND).collect()) == [1, 9]
    assert [r.k for r in C.read_committed(spark, folder, "a", KIND, before=8).collect()] == [1]
    assert list(C.manifests(spark, folder)) == [7, 8]


def test_of_two_writers_of_one_cut_one_wins(spark):
    folder = new_folder(spark, "commits")
    assert C._publish(spark, folder, 0, {"a": "first"})
    assert not C._publish(spark, folder, 0, {"a": "second"})
    assert C.manifests(spark, folder) == {0: {"a": "first"}}


def test_writers_at_once_never_double_a_key(spark):
    folder, cuts = new_folder(spark, "commits"), []
    work = [threading.Thread(target=lambda i=i: cuts.append(C.append_once(folder, "a", ["k"], rows(spark, [*range(i, i + 6), 0, 0, None], f"w{i}")))) for i in range(4)]
    for w in work:
        w.start()
    for w in work:
        w.join()
    got = [r.k for r in C.read_committed(spark, folder, "a", KIND).collect()]
    assert sorted(got, key=str) == sorted([*range(9), None], key=str)
    assert sorted(cuts) == [0, 1, 2, 3]
