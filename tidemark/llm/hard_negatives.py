"""Hard negatives for contrastive training by exact integer inner products over bit planes.

A component x counts as the integer floor(256 * x), cut into two's-complement bit planes. Of a pair of rows the planes are
added most significant first: when the planes from k up are in, each component still to be added lies between 0 and 2^k - 1,
so the score lies between ``sum + (2^k - 1) * (negative part of the anchor)`` and ``sum + (2^k - 1) * (positive part)``. A
candidate whose interval can't reach what is needed any more is dropped; the intervals of the others close on exact scores.

The rows are written once as blocks of packed planes, the anchors as small blocks of integers, both into the shared scratch
folder. A task holds blocks up to a fixed size and streams all anchor blocks past them, so nothing is broadcast or
collected and memory doesn't grow with either side; only the best few of each anchor and task are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import files
from tidemark.shared import materialize, release

#: Rows in a block of planes, anchors in a block, and bytes of planes that a task holds at once.
ROWS, ANCHORS, HELD = 4096, 256, 24 << 20
#: Share of the pairs of a block below which they are followed one by one instead of as a matrix.
SPARSE = 1 / 16
FAR = np.int64(1) << 62


class Block(NamedTuple):
    """Rows in no order: ids, labels, packed planes (planes, rows, bytes), the most significant first."""

    ids: np.ndarray
    labels: np.ndarray
    planes: np.ndarray


class Anchors(NamedTuple):
    """ids, labels, prints of the rows, integer vectors; scores of each anchor's positives (-1: none that can have negatives)."""

    ids: np.ndarray
    labels: np.ndarray
    prints: np.ndarray
    vectors: np.ndarray
    goals: np.ndarray


def prepared(rows: DataFrame, key: str, vector: str, label: str) -> tuple[DataFrame, int, int]:
    """(id, label, v) of the rows that take part, once each, with integers for v; planes that hold every component; dimension."""
    x = F.transform(F.col(vector), lambda c: F.floor(256 * c.cast("double")))
    fine = F.forall(F.col(vector), lambda c: F.coalesce(F.abs(c.cast("double")) < 2.0**32, F.lit(False)))  # false for NaN, too
    own = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & fine)
    own = own.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), x.cast("array<long>").alias("v")).distinct()
    most = own.agg(F.max(F.size("v"))).first()[0] or 0
    # A sum of products of larger ones may not fit 64 bits; no embedding comes near it.
    bound = int((2**62 / max(most, 1)) ** 0.5)
    own = own.where((F.coalesce(F.array_max("v"), F.lit(0)) <= bound) & (F.coalesce(F.array_min("v"), F.lit(0)) >= -bound))
    high, low = (int(x or 0) for x in own.agg(F.max(F.array_max("v")), F.min(F.array_min("v"))).first())
    return own, 1 + max(high.bit_length(), (~low).bit_length() if low < 0 else 0), most


def _matrix(column, dim: int) -> np.ndarray:
    """Lists of a batch as rows of ``dim`` numbers; a shorter list ends in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offs = np.asarray(column.offsets)
    n = np.diff(offs)
    out = np.zeros((len(n), dim), np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)[offs[0] : offs[-1]]
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(offs[:-1] - offs[0], n)] = flat
    return out


def pack_planes(v: np.ndarray, n_planes: int) -> np.ndarray:
    """Two's-complement planes of the rows, packed eight components a byte, the sign plane first."""
    return np.stack([np.packbits(((v >> k) & 1).astype(np.uint8), axis=1) for k in range(n_planes - 1, -1, -1)])


def _blocks(batches: Iterator[pa.RecordBatch], n_planes: int, dim: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            planes = pack_planes(_matrix(part.column("v"), dim), n_planes)
            cell = lambda x: pa.array([x.tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([cell(part.column("id").to_numpy()), cell(part.column("label").to_numpy()), cell(planes)], ["ids", "labels", "planes"])


def _held(batches: Iterator[pa.RecordBatch], n_planes: int, dim: int) -> Iterator[list[Block]]:
    """Lists of blocks of about HELD bytes."""
    held, size = [], 0
    for batch in batches:
        for ids, labels, planes in zip(*(batch.column(c).to_pylist() for c in ("ids", "labels", "planes")), strict=True):
            own = np.frombuffer(ids, np.int64)
            held.append(Block(own, np.frombuffer(labels, np.int64), np.frombuffer(planes, np.uint8).reshape(n_planes, len(own), -(-dim // 8))))
            size += len(planes)
            if size >= HELD:
                yield held
                held, size = [], 0
    if held:
        yield held


def _anchors(folder: str, names: list[str], dim: int) -> Iterator[Anchors]:
    """The anchors in a folder of Parquet files, a block at a time."""
    for name in names:
        with files.read(f"{folder}/{name}") as f:
            for batch in pq.ParquetFile(f).iter_batches(ANCHORS):
                if not batch.num_rows:
                    continue
                goals = batch.column("goals") if "goals" in batch.schema.names else pa.array([[]] * batch.num_rows, pa.list_(pa.int64()))
                sizes = np.diff(np.asarray(goals.offsets))
                n = int(max(1, sizes.max()))
                scores = np.where(np.arange(n)[None] < sizes[:, None], _matrix(goals, n), -1)
                ids, labels, prints = (batch.column(c).to_numpy() for c in ("id", "label", "print"))
                yield Anchors(ids, labels, prints, _matrix(batch.column("v"), dim), scores)


def scored_pairs(block: Block, a: Anchors, able: np.ndarray, needed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, exact score) of the pairs of ``able`` whose interval ``needed`` never gave up.

    ``needed(rows, anchors, low, high)`` says which pairs may still matter; ``rows`` is None while all pairs are a matrix."""
    n_planes, n, dim = len(block.planes), len(block.ids), a.vectors.shape[1]
    exact = np.float32 if np.abs(a.vectors).sum(axis=1).max(initial=0) < 1 << 24 else np.float64
    side = a.vectors.T.astype(exact)
    up, down = np.maximum(a.vectors, 0).sum(axis=1), np.minimum(a.vectors, 0).sum(axis=1)
    total, pairs = np.zeros((n, len(a.ids)), np.int64), None
    for at in range(n_planes):
        k = n_planes - 1 - at
        weight, rest = (-(1 << k) if at == 0 else 1 << k), (1 << k) - 1
        bits = np.unpackbits(block.planes[at], axis=1, count=dim) if dim else np.zeros((n, 0), np.uint8)
        if pairs is None:
            total += weight * (bits.astype(exact) @ side).astype(np.int64)
            if rest * int((up - down).min(initial=0)) > int(np.ptp(total)):  # no interval can lie apart from another yet
                continue
            able &= needed(None, None, total + rest * down, total + rest * up)
            if (left := np.count_nonzero(able)) == 0:
                return (np.zeros(0, np.int64),) * 3
            if left < SPARSE * able.size:
                pairs = np.nonzero(able)
                total = total[pairs]
        else:
            r, c = pairs
            for x in range(0, len(r), 1 << 16):  # bounded temporaries
                s = slice(x, x + (1 << 16))
                total[s] += weight * np.einsum("ij,ij->i", bits[r[s]], a.vectors[c[s]])
            keep = needed(r, c, total + rest * down[c], total + rest * up[c])
            pairs, total = (r[keep], c[keep]), total[keep]
    if pairs is None:
        pairs = np.nonzero(able)
        total = total[pairs]
    return *pairs, total


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th greatest of each column; -FAR in columns of fewer rows."""
    return np.partition(values, len(values) - k, axis=0)[len(values) - k] if len(values) >= k else np.full(values.shape[1], -FAR)


class Best:
    """Best ``k`` (score, id) of each slot so far, the greatest score first and equal ones by the smaller id."""

    def __init__(self, slots: int, k: int):
        self.scores, self.ids = np.full((slots, k), -FAR), np.full((slots, k), FAR)

    def add(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        k = self.scores.shape[1]
        at = np.unique(slots)
        slots = np.concatenate([np.repeat(at, k), slots])
        scores, ids = np.concatenate([self.scores[at].reshape(-1), scores]), np.concatenate([self.ids[at].reshape(-1), ids])
        order = np.lexsort((ids, -scores, slots))
        slots, scores, ids = slots[order], scores[order], ids[order]
        nth = np.arange(len(slots)) - np.searchsorted(slots, slots)
        keep = nth < k
        self.scores[slots[keep], nth[keep]], self.ids[slots[keep], nth[keep]] = scores[keep], ids[keep]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        slot, nth = np.nonzero(self.scores > -FAR)
        return slot, self.ids[slot, nth], self.scores[slot, nth]


def best_positives(blocks: list[Block], a: Anchors, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, id, score) of the ``k`` best rows of each anchor's label, without the anchor."""
    best = Best(len(a.ids), k)
    for block in blocks:
        able = (block.labels[:, None] == a.labels[None]) & (block.ids[:, None] != a.ids[None])
        known = best.scores[:, -1]

        def needed(r, c, low, high):
            if r is not None:
                return high >= known[c]
            return high >= np.maximum(known, _kth(np.where(able, low, -FAR), k))[None]  # noqa: B023

        r, c, score = scored_pairs(block, a, able, needed)
        best.add(c, score, block.ids[r])
    return best.rows()


def best_negatives(blocks: list[Block], a: Anchors, k: int, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor * goals + goal, id, score) of the ``k`` best rows of other labels for each positive score of an anchor, at most
    that score and at least ``percent`` hundredths of it."""
    wide = a.goals.shape[1]
    least = np.where(a.goals >= 0, -(-percent * a.goals // 100), FAR)
    best = Best(a.goals.size, k)
    for block in blocks:
        able = block.labels[:, None] != a.labels[None]
        floor = np.maximum(least, best.scores[:, -1].reshape(a.goals.shape))

        def needed(r, c, low, high):
            out = np.zeros(low.shape, bool)
            for g in range(wide):
                top, bottom = a.goals[:, g], floor[:, g]  # noqa: B023
                if r is not None:
                    out |= (high >= bottom[c]) & (low <= top[c])
                    continue
                sure = able & (low >= bottom[None]) & (high <= top[None])  # noqa: B023
                out |= (high >= np.maximum(bottom, _kth(np.where(sure, low, -FAR), k))[None]) & (low <= top[None])
            return out

        r, c, score = scored_pairs(block, a, able, needed)
        for g in range(wide):
            fits = (score >= floor[c, g]) & (score <= a.goals[c, g])
            best.add(c[fits] * wide + g, score[fits], block.ids[r[fits]])
    return best.rows()


def _file_names(df: DataFrame) -> tuple[str, list[str]]:
    """The folder of a materialized frame and the names of its files."""
    paths = sorted(df.inputFiles())
    return (paths[0].rsplit("/", 1)[0] if paths else ""), [x.rsplit("/", 1)[1] for x in paths]


def hard_negatives(rows: DataFrame, is_anchor, key: str = "vec_id", vector: str = "embedding", label: str = "label", positives: int = 5, negatives: int = 5, percent: int = 80) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows that ``is_anchor``, a condition on
    ``id`` and ``label``, names.

    Of each anchor the ``positives`` best other rows of its label are its positives; each has the ``negatives`` best rows of
    other labels that score at most as much as the positive and at least ``percent`` hundredths of it. Scores are exact,
    greater ones come first, equal ones by the smaller key.

    Rows without a key, label or vector, or with a component that is null or not finite, take no part, nor do rows with a
    component so large that a score may not fit a long. Equal rows count once; rows of one key that differ are rows of their
    own, but none is its own anchor's positive. A shorter vector ends in zeros, an empty one scores 0. Other columns are
    ignored, whatever their names; an empty table gives no rows.
    """
    own, n_planes, dim = prepared(rows, key, vector, label)
    own = materialize(own, "integer-vectors")
    blocks = materialize(own.mapInArrow(lambda x: _blocks(x, n_planes, dim), "ids binary, labels binary, planes binary"), "bit-planes")

    def scan(side: DataFrame, run) -> DataFrame:
        folder, names = _file_names(side)

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held in _held(batches, n_planes, dim):
                for a in _anchors(folder, names, dim):
                    slot, ids, scores = run(held, a)
                    wide = len(slot) and (1 if run is find_positives else a.goals.shape[1])
                    at = slot // max(wide, 1)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a.ids[at], a.prints[at], a.goals.reshape(-1)[slot] if run is find_negatives else scores, ids, scores)], ["anchor_id", "print", "goal", "other_id", "score"])

        return blocks.mapInArrow(task, "anchor_id long, print long, goal long, other_id long, score long")

    find_positives = lambda held, a: best_positives(held, a, positives)
    find_negatives = lambda held, a: best_negatives(held, a, negatives, percent)
    # Rows of one key that differ are told apart by their print.
    anchors = materialize(own.where(is_anchor).select("id", "label", F.xxhash64("label", "v").alias("print"), "v"), "anchors")
    order = [F.desc("score"), "other_id"]
    found = scan(anchors, find_positives).withColumn("nth", F.row_number().over(Window.partitionBy("anchor_id", "print").orderBy(*order))).where(F.col("nth") <= positives)
    found = materialize(found.select("anchor_id", "print", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # No score is at most a negative one and at least a part of it.
    goals = found.where("positive_score >= 0").groupBy(F.col("anchor_id").alias("id"), "print").agg(F.array_sort(F.collect_set("positive_score")).alias("goals"))
    aimed = materialize(anchors.join(goals, ["id", "print"]), "anchor-goals")
    low = scan(aimed, find_negatives).withColumn("rank", F.row_number().over(Window.partitionBy("anchor_id", "print", "goal").orderBy(*order))).where(F.col("rank") <= negatives)
    low = low.select("anchor_id", "print", F.col("goal").alias("positive_score"), "rank", F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = found.join(low, ["anchor_id", "print", "positive_score"])
    out = materialize(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives")
    for done in (own, blocks, anchors, found, aimed):
        release(done)
    return out
