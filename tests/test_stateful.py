"""State across cuts: folds, polls and late rows against plain Python, with restarts, nulls and ids beyond 2^53."""

import random

from pyspark.sql import functions as F

from tidemark.operators.relational import launch_step
from tidemark.shared import new_folder
from tidemark.sources import commits as C
from tidemark.streaming import capture as S
from tidemark.streaming import replay as P
from tidemark.streaming import stateful as Y

BIG = 2**60


def run(spark, df, parts, make, folder=None, offsets=None):
    """The committed output of ``make(stream)`` over parts 0, 1, ..."""
    folder, offsets, out = folder or new_folder(spark, "fed"), offsets or new_folder(spark, "offsets"), new_folder(spark, "out")
    kind = None
    for some in parts:  # a restart after each
        for i in some:
            df.where(F.col("part") == i).drop("part").coalesce(1).write.mode("append").parquet(folder)
        made = make(spark.readStream.schema(df.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(folder))
        kind = made.schema
        S.run_cuts(made, offsets, C.committing(out, lambda cut: {"t": cut}))
    return [tuple(r) for r in C.read_committed(spark, out, "t", kind).collect()]


def test_polls_keep_their_cursor_over_a_restart(spark):
    rng, polls = random.Random(1), []
    for poll in range(12):
        for stream in ("a", "b", None):
            top = BIG + poll * 3 + rng.randrange(3)
            items = list(range(top, top - rng.randrange(1, 14), -1)) if rng.random() < 0.8 else []
            polls.append((stream, poll, items, int(rng.random() < 0.3), poll // 3))
    df = spark.createDataFrame(polls, "stream string, poll long, items array<long>, errors long, part int")
    make = lambda s: Y.stream_fold(s, ["stream"], ["poll"], ["poll", "items", "errors"], "poll long, status string, fresh long, before long, after long", "cursor long", lambda: (None,), Y.listing_step)
    got = run(spark, df, [[0, 1], [2, 3]], make)
    want, cursor = [], {}
    for stream, poll, items, errors, _ in polls:
        old = cursor.get(stream)
        reached = old is not None and old in items
        new = items[0] if items and (old is None or reached) else old
        want.append((stream, poll, "OK" if reached else "UNKNOWN" if errors and not items else "PARTIAL", items.index(old) if reached else len(items), old, new))
        cursor[stream] = new
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {w[2] for w in want} == {"OK", "UNKNOWN", "PARTIAL"} and any(w[4] is not None and w[4] > 2**53 for w in want)


def test_a_gap_never_moves_the_boundary(spark):
    cuts = [(1, 0, 10, 20, False), (1, 1, 30, 40, False), (1, 2, 15, 35, False), (1, 3, 30, 50, True), (1, 4, 35, 60, False), (1, 2, 0, 99, False), (1, 6, None, None, False)]
    df = spark.createDataFrame([(*c, i) for i, c in enumerate(cuts)], "s int, cut long, a long, b long, e boolean, part int")
    make = lambda s: Y.stream_fold(s, ["s"], ["cut"], ["cut", "a", "b", "e"], "cut long, state string, boundary long", "boundary long, cut long", lambda: (None, None), launch_step)
    got = run(spark, df, [range(3), range(3, 7)], make)
    assert sorted(got, key=lambda r: (r[1], r[2])) == [
        (1, 0, "BASELINE_ONLY", 20), (1, 1, "GAP", 20), (1, 2, "COMPLETE_INTERVAL", 35), (1, 2, "LATE_CUT", 60), (1, 3, "SOURCE_ERROR", 35), (1, 4, "COMPLETE_INTERVAL", 60), (1, 6, "SOURCE_ERROR", 60),
    ]


def test_signatures():
    state, out = (None,), []
    for row in [(0, 5, 3, True, 0), (1, 9, 1000, False, 0), (2, 8, 2, True, 0), (3, None, 0, True, 1), (4, None, 0, True, 0)]:
        state, emitted = Y.signature_step(state, row)
        out.append(emitted)
    assert out == [(0, "PARTIAL", None, 5), (1, "PARTIAL", 5, 5), (2, "OK", 5, 8), (3, "UNKNOWN", 8, 8), (4, "OK", 8, 8)]


def test_every_row_is_captured_or_counted(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b"]), None if rng.random() < 0.05 else rng.randrange(0, 10**9), BIG + i if i % 7 else None, rng.randrange(4)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, us long, id long, part int")
    got = run(spark, df, [[0, 1], [2, 3]], lambda s: Y.rows_and_gaps(s, "k", "us", "id", 600, 100))
    newest, want = {}, []
    for part in range(4):
        own = [r for r in rows if r[3] == part]
        for k, us, i, _ in own:
            late = us is not None and k in newest and us < newest[k] - 600_000_000
            want.append((k, "NO_TIME", None, None) if us is None else (k, "LATE", us // 100_000_000 * 100_000_000, None) if late else (k, "ROW", us, i))
        for k, us, _, _ in own:
            if us is not None:
                newest[k] = max(newest.get(k, us), us)
    each = [r[:4] for r in got for _ in range(r[4])]
    assert sorted(map(str, each)) == sorted(map(str, want)) and len(each) == 400
    assert {r[1] for r in got} == {"ROW", "LATE", "NO_TIME"}


def test_first_cursors():
    now = 10**15
    assert P.first_cursor(now - 60 * P.SECOND, now) == (now - 72 * P.SECOND, "PRIOR_CURSOR_REWIND")
    assert P.first_cursor(now - P.LOOKBACK * P.SECOND, now)[0] == now - P.LOOKBACK * P.SECOND
    assert P.first_cursor(now + P.AHEAD * P.SECOND, now)[1] == "PRIOR_CURSOR_REWIND"
    for prior in (None, 0, now - P.LOOKBACK * P.SECOND - 1, now + P.AHEAD * P.SECOND + 1):
        assert P.first_cursor(prior, now) == (now - P.BASELINE * P.SECOND, "BASELINE_16M_UNKNOWN_PREHISTORY")


def test_replay_plans_only_the_slices_of_its_span(spark):
    folder = new_folder(spark, "feed")
    assert P.ReplayReader(spark.range(0).schema, {"path": folder})._head() == 0
    df = spark.createDataFrame([(i, i * 60 * P.SECOND) for i in range(600)] + [(-1, None)], "id long, us long")
    P.land_feed(df, folder, "us", 3600)
    reader = P.ReplayReader(df.withColumn("kind", F.lit("")).schema, {"path": folder, "slice_s": "3600", "step_s": "7200", "prior_us": "0", "now_us": "60000000"})
    first = reader.initialOffset()
    assert first == {"us": -12 * P.SECOND, "mode": "PRIOR_CURSOR_REWIND", "first": 1} and reader._head() == 599 * 60 * P.SECOND
    spans, ends, start = [], [], first
    while (end := reader.latestOffset()) and end["us"] > start["us"]:
        spans.append(reader.partitions(start, end))
        ends.append(end["us"])
        start = end
    assert ends == [(7200 * i - 12) * P.SECOND for i in range(1, 5)] + [599 * 60 * P.SECOND]
    read = [sorted(x for s in part for b in reader.read(s) for x in b.column(0).to_pylist()) for part in spans]
    assert read == [list(range(i, i + 120)) for i in range(0, 600, 120)]
    again = reader.partitions({"us": 7200 * P.SECOND, "mode": "", "first": 0}, {"us": 7201 * P.SECOND, "mode": "", "first": 0})
    assert [x for s in again for b in reader.read(s) for x in b.column(0).to_pylist()] == [120]  # rewound by 12 seconds
    assert len({s.path.rsplit("/", 2)[1] for s in again}) == 2


def test_replay_query_restarts(spark):
    from tidemark.plans import stream_queries as Q

    d = "/root/testdata/sf0.001"
    want = spark.read.parquet(f"{d}/events.parquet").count()
    got = Q.replayed_feed(spark, d)
    assert got.count() == got.select("event_id").distinct().count() == want
