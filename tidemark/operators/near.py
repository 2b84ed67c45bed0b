"""Classes of 64-bit fingerprints within a Hamming distance, by an index whose keys grow with the number of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import envelope as V
from tidemark.functions import images as I
from tidemark.functions import text as X
from tidemark.operators.components import connected_components
from tidemark.shared import materialize, release

#: Most keys of a row.
MOST_KEYS = 5000
#: Rows of a partition of the index, and rows that a task looks at together; buckets of up to SMALL rows are compared by their distance in
#: the order, larger ones by HUBS hubs and in blocks of BLOCK pairs.
PART_ROWS, HELD, SMALL, HUBS, BLOCK = 1_000_000, 200_000, 24, 8, 1 << 20


def key_masks(n: int, most: int) -> list[int]:
    """Masks of bits of which two fingerprints within ``most`` bits agree on one whole at least (signed 64-bit integers).

    The bits are cut into bands; at most ``most`` of them differ, so the others agree. More bands make more keys a row and longer ones, so fewer rows meet
    by chance: the number of bands is that of the least keys and chance meetings a row among ``n``."""
    able = [b for b in range(most + 1, 65) if comb(b, most) <= MOST_KEYS]
    cost = lambda b: comb(b, most) * (1 + n / 2 ** min(64 * (b - most) / b + 1, 100))
    bands = min(able, key=cost)
    cut = [sum(1 << i for i in range(j * 64 // bands, (j + 1) * 64 // bands)) for j in range(bands)]
    whole = [sum(cut[j] for j in chosen) for chosen in combinations(range(bands), bands - most)]
    return [m - (1 << 64) if m >> 63 else m for m in whole]


def close_pairs(prints: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs of one bucket's distinct fingerprints within ``most`` bits: enough of them to connect all that such pairs connect.

    Each of a few hubs is held against all, which ties most of a large group; then only fingerprints of different hubs are held against each
    other, in blocks of a bounded size."""
    tied = np.arange(len(prints))
    for _ in range(HUBS):
        free = np.flatnonzero(tied == np.arange(len(prints)))
        if len(free) < 2:
            break
        hub = free[_ * len(free) // HUBS]
        near = free[np.bitwise_count(prints[free] ^ prints[hub]) <= most]
        near = near[near != hub]
        tied[near] = hub
        yield np.full(len(near), hub), near
    most_tied = np.bincount(tied).argmax()
    rest, step = np.flatnonzero(tied != most_tied), max(1, BLOCK // len(prints))
    for at in range(0, len(rest), step):
        x, y = np.nonzero(np.bitwise_count(prints[rest[at : at + step], None] ^ prints[None]) <= most)
        x = rest[at : at + step][x]
        cross = (tied[x] != tied[y]) & ((tied[y] == most_tied) | (x < y))
        yield x[cross], y[cross]


def links_in(prints: np.ndarray, bucket: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs within ``most`` bits, of rows sorted by their bucket, that connect what all such pairs of a bucket connect."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    sizes = np.diff(np.append(starts, len(bucket)))
    place = np.arange(len(bucket)) - np.repeat(starts, sizes)
    small = np.repeat(sizes <= SMALL, sizes)
    for s in range(1, SMALL):
        second = np.flatnonzero(small & (place >= s))
        if not len(second):
            break
        second = second[np.bitwise_count(prints[second - s] ^ prints[second]) <= most]
        out.append((second - s, second))
    for at, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        out += [(at + x, at + y) for x, y in close_pairs(prints[at : at + n], most)]
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def near_prints(prints: DataFrame, n: int, most: int) -> DataFrame:
    """Pairs (a, b) of the ``n`` distinct fingerprints ``fp`` within ``most`` bits, enough to connect what all such pairs connect.

    Rows are dealt once by the keys of the index, as a mask's number and the fingerprint alone, in so many partitions that one holds about
    ``PART_ROWS`` of them; a bucket's pairs are found where it lies, so neither buckets nor their pairs are written."""
    masks = key_masks(n, most)
    of = np.array(masks, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def found(at: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            key = fp & of[at]
            turn = np.append(False, (at[1:] != at[:-1]) | (key[1:] != key[:-1]))
            x, y = links_in(fp.view(np.uint64), np.cumsum(turn), most)
            a, b, own = np.minimum(fp[x], fp[y]), np.maximum(fp[x], fp[y]), at[x]
            # A pair that agrees on several masks is one of the first of them only: what it connects is connected there.
            first = np.ones(len(a), bool)
            for j in range(len(of)):
                first &= ((a ^ b) & of[j] != 0) | (own <= j)
            return pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first])], names=["a", "b"])

        def whole() -> tuple[np.ndarray, np.ndarray]:
            return tuple(np.concatenate([x[i] for x in held]) for i in (0, 1))

        for batch in batches:
            held.append(tuple(c.to_numpy() for c in batch.columns))
            rows += batch.num_rows
            if rows >= HELD:
                at, fp = whole()
                key = fp & of[at]
                last = np.flatnonzero((at != at[-1]) | (key != key[-1]))  # the last bucket may go on
                cut = last[-1] + 1 if len(last) else 0
                if cut:
                    yield found(at[:cut], fp[:cut])
                held, rows = [(at[cut:], fp[cut:])], 0
        if held:
            yield found(*whole())

    spread = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(n * len(masks) // PART_ROWS, min(spread, n * len(masks) // 50_000)) + 1
    keyed = prints.select("fp", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("at", "mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
    return keyed.select("at", "key", "fp").repartition(parts, "at", "key").sortWithinPartitions("at", "key").select("at", "fp").mapInArrow(run, "a long, b long")


def near_classes(nodes: DataFrame, most: int, sure: Callable[[str, str], Column] | None = None, settle: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(node, component) of the nodes that links reach: rows (id, fp, ...) link within ``most`` bits and, if given, where ``sure(x, y)`` holds
    for the aliases of both or ``settle`` keeps the pair (a, b).

    Distinct fingerprints are connected first, whatever else a link needs. The pairs that connect them are then checked: a class of which all
    hold is one of links. In the others, which chance made, every pair that crosses what holds so far is formed and checked, so no link
    between classes is lost and no group of near copies is expanded into all its pairs."""
    nodes = materialize(nodes, "fingerprints")
    prints = materialize(nodes.groupBy("fp").agg(F.min("id").alias("first")), "prints")
    near = materialize(near_prints(prints.select("fp"), prints.count(), most), "near")
    x, y = (prints.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_id")) for c in "ab")
    tree = near.join(x, "a").join(y, "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    equal = nodes.join(prints, "fp").where("id != first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    tree = materialize(tree.unionByName(equal), "tree")
    whole = materialize(connected_components(tree), "whole")
    if sure is None:
        for done in (nodes, prints, near, tree):
            release(done)
        return whole

    def holds(pairs: DataFrame) -> DataFrame:
        told = materialize(pairs.join(nodes.alias("x"), F.col("a") == F.col("x.id")).join(nodes.alias("y"), F.col("b") == F.col("y.id")).select("a", "b", sure("x", "y").alias("sure")), "told")
        good, open_ = told.where("sure").select("a", "b"), told.where("sure IS NOT TRUE").select("a", "b")
        if settle is not None and open_.limit(1).count():
            good = good.unionByName(settle(open_).select("a", "b"))
        return materialize(good, "links")

    links = holds(tree)
    failed = tree.join(links, ["a", "b"], "left_anti").join(whole, F.col("a") == F.col("node")).select("component").distinct()
    doubt = materialize(whole.join(failed, "component").select("node", F.col("component").alias("whole")), "doubt")
    if doubt.limit(1).count():
        part = connected_components(links).select(F.col("node").alias("id"), F.col("component").alias("part"))
        rest = nodes.select("id", "fp").join(doubt, F.col("id") == F.col("node")).drop("node").join(part, "id", "left").withColumn("part", F.coalesce("part", "id"))
        rest = materialize(rest, "rest")
        masks = key_masks(rest.count(), most)
        keyed = rest.select("*", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("at", "mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        x, y = keyed.alias("x"), keyed.alias("y")
        met = (F.col("x.at") == F.col("y.at")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.whole") == F.col("y.whole")) & (F.col("x.part") < F.col("y.part")) & (X.hamming(F.col("x.fp"), F.col("y.fp")) <= most)
        links = links.unionByName(holds(materialize(x.join(y, met).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct(), "cross")))
    return materialize(connected_components(links), "near-classes")


def near_texts(docs: DataFrame, key: str, text: str, most: int = 6) -> DataFrame:
    """(key, set_id, class_id) of every row: the smallest key with the same set of tokens, and the smallest that links reach. Sets link that share a
    token and whose SimHash fingerprints are up to ``most`` bits apart; a text without tokens is alone.

    Keys are integers; rows that repeat one are linked through it. Four least token hashes show most shared tokens, and the texts of other pairs are
    compared whole. An empty table gives no rows."""
    full = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), V.text_tokens(F.col(text), None).alias("words"))
    ends = F.slice(F.array_sort(F.transform("words", lambda w: F.xxhash64(w))), 1, 4)
    base = full.select("id", F.when(F.size("words") > 0, F.sha2(F.array_join(F.array_sort("words"), " "), 256)).alias("own"), ends.alias("ends"), X.simhash(F.col("words")).alias("fp"))
    base = materialize(base, "token-prints")
    sets = materialize(base.where(F.col("own").isNotNull()).groupBy("own").agg(F.min("id").alias("id"), F.first("fp").alias("fp"), F.first("ends").alias("ends")), "token-sets")
    # A set's own number, since two sets may have the same least key.
    number = F.xxhash64("own")

    def settle(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("n")).unionByName(pairs.select(F.col("b").alias("n"))).distinct()
        words = full.select(F.xxhash64(F.sha2(F.array_join(F.array_sort("words"), " "), 256)).alias("n"), "words").join(wanted, "n", "left_semi").dropDuplicates(["n"])
        a, b = words.select(F.col("n").alias("a"), F.col("words").alias("wa")), words.select(F.col("n").alias("b"), F.col("words").alias("wb"))
        return pairs.join(a, "a").join(b, "b").where(F.arrays_overlap("wa", "wb"))

    near = near_classes(sets.select(number.alias("id"), "fp", "ends"), most, lambda x, y: F.arrays_overlap(f"{x}.ends", f"{y}.ends"), settle)
    told = sets.select("own", F.col("id").alias("set_id"), number.alias("node")).join(near, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = base.select("id", "own").join(told, "own", "left")
    # Classes that share a key are one.
    twice = rows.where("component IS NOT NULL").groupBy("id").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b")
    tied = rows.join(twice.select("id", F.col("a").alias("least")), "id").select(F.col("component").alias("a"), F.col("least").alias("b"))
    whole = connected_components(tied).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    rows = rows.join(whole, "component", "left").withColumn("component", F.coalesce("whole", "component"))
    least = rows.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("class_id"))
    out = rows.join(least, "component", "left")
    return out.select(F.col("id").alias(key), F.coalesce("set_id", "id").alias("set_id"), F.coalesce("class_id", "id").alias("class_id"))


def near_images(images: DataFrame, key: str, pixels: str, side: int, most: int = 8) -> DataFrame:
    """(key, phash, class_id) of every row: the perceptual hash of its ``side`` x ``side`` grey image and the smallest key that links of up to ``most`` bits
    reach. An image that isn't of this size, or has a value that is null or not finite, has no hash and is alone."""
    rows = materialize(images.where(F.col(key).isNotNull()).select(F.col(key).alias("id"), I.phash(F.col(pixels), side).alias("phash")), "phashes")
    groups = rows.where("phash IS NOT NULL").groupBy("phash").agg(F.min("id").alias("first"))
    near = near_classes(groups.select(F.col("phash").alias("id"), F.col("phash").alias("fp")), most)
    told = groups.join(near, groups["phash"] == near["node"], "left").select("phash", "first", F.coalesce("component", "phash").alias("component"))
    least = told.groupBy("component").agg(F.min("first").alias("class_id"))
    out = rows.join(told.join(least, "component").select("phash", "class_id"), "phash", "left")
    return out.select(F.col("id").alias(key), "phash", F.coalesce("class_id", "id").alias("class_id"))
