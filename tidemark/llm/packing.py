"""Sum-of-squares online packing of token documents into fixed windows.

A document's full windows stand alone; its remainder goes to the fill level that keeps the sum of squared counts of
partially filled windows smallest. Counts live in a level array with one entry per fill; the windows at a level are a
stack. What is open at the end of a lane is closed by cutting the least-filled windows into the gaps of the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrow_text import slices
from tidemark.llm.encoding import crc, encoder


#: Bytes of text that are encoded at once: the arrays over their bytes and ids take many times that.
SLICE = 2 << 20


class SumOfSquares:
    """Packs (doc, start, length) pieces; ``closed`` collects full windows as lists of pieces."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(window + 1)]
        self.closed: list[list] = []

    def level(self, size: int) -> int:
        """The fill to place ``size`` at: 0 opens a window. Least increase of the sum of squares; ties to the fullest."""
        free = self.window - size
        delta = 2 * (self.count[size : self.window + 1] - self.count[: free + 1] + 1)
        delta[0] = 2 * self.count[size] + 1
        delta[free] = 1 - 2 * self.count[free] if free else delta[0]
        delta[1:][self.count[1 : free + 1] == 0] = np.iinfo(np.int64).max
        return free - int(np.argmin(delta[::-1]))

    def add(self, doc: int, length: int) -> None:
        at = 0
        while length - at >= self.window:
            self.closed.append([(doc, at, self.window)])
            at += self.window
        if size := length - at:
            level = self.level(size)
            pieces = self.open[level].pop() if level else []
            self.count[level] -= level > 0
            pieces.append((doc, at, size))
            if level + size == self.window:
                self.closed.append(pieces)
            else:
                self.open[level + size].append(pieces)
                self.count[level + size] += 1

    def finish(self) -> list[list]:
        """Closes the open windows: the fullest are filled up by pieces, cut where needed, of the least filled. What is
        left, less than one window, is cut into windows of powers of two, which need no padding."""
        rest = [p for level in range(self.window - 1, 0, -1) for p in self.open[level]]
        fills = [level for level in range(self.window - 1, 0, -1) for _ in self.open[level]]
        tail: list[tuple] = []
        while rest:
            gap, pieces = self.window - fills.pop(0), rest.pop(0)
            while gap:
                if not tail:
                    if not rest:
                        break
                    tail = rest.pop()
                    fills.pop()
                doc, at, size = tail.pop()
                if size > gap:
                    tail.append((doc, at + gap, size - gap))
                    size = gap
                pieces.append((doc, at, size))
                gap -= size
            if not gap:
                self.closed.append(pieces)
            else:
                tail = pieces
        left = sum(p[2] for p in tail)
        tail = tail[::-1]
        for bit in range(left.bit_length() - 1, -1, -1):
            if left >> bit & 1:
                need, own = 1 << bit, []
                while need:
                    doc, at, size = tail.pop()
                    if size > need:
                        tail.append((doc, at + need, size - need))
                        size = need
                    own.append((doc, at, size))
                    need -= size
                self.closed.append(own)
        self.open, self.count = [[] for _ in range(self.window + 1)], np.zeros(self.window + 1, np.int64)
        closed, self.closed = self.closed, []
        return closed


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 2048, end_id: int = 1, lane_tokens: int = 4_000_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens) for each piece.

    A partition is read once and packed online in lanes of ``lane_tokens`` tokens, so memory is bounded at any size and
    nothing is shuffled; a lane is closed with less than one window left over. ``sequence_id`` holds the partition and
    the sequence within it. Rows are ordered by key within a partition first, so a retried task packs alike. Null and
    empty texts are one end id. Repeated rows and null keys are packed as they come. Further columns are ignored.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, keys, sizes, flats, held, sequence, part = SumOfSquares(window), [], [], [], 0, 0, 0
        encode = encoder(tokenizer, end_id).encode

        def lane() -> pa.RecordBatch:
            nonlocal packer, keys, sizes, flats, held, sequence
            ids, sized = np.concatenate(flats), np.array(sizes, np.int64)
            starts = np.cumsum(sized) - sized
            closed = packer.finish()
            rows = [(d, a, n, sequence + s, o) for s, own in enumerate(closed) for (d, a, n), o in zip(own, np.cumsum([0, *(p[2] for p in own[:-1])]).tolist(), strict=True)]
            doc, at, length, seq, off = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            fills = np.array([sum(p[2] for p in own) for own in closed], np.int64)
            sums = [crc(ids[a : a + n]) for a, n in zip((starts[doc] + at).tolist(), length.tolist(), strict=True)]
            out = pa.RecordBatch.from_arrays(
                [pa.concat_arrays(keys).take(pa.array(doc)), pa.array(at), pa.array(length), pa.array(sums, pa.int64()), pa.array(sized[doc]), pa.array(seq + (part << 32)), pa.array(off), pa.array(fills[seq - sequence])],
                names=[key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens"],
            )
            sequence += len(closed)
            keys, sizes, flats, held = [], [], [], 0
            return out

        for batch in batches:
            for piece in slices(batch, text, SLICE):
                part = piece.column(2)[0].as_py()
                ids, offs = encode(piece.column(1))
                own = np.diff(offs)
                for n in own.tolist():
                    packer.add(len(sizes), n)
                    sizes.append(n)
                keys.append(piece.column(0))
                flats.append(ids)
                held += len(ids)
                if held >= lane_tokens:
                    yield lane()
        if held:
            yield lane()

    rows = docs.select(key, text).sortWithinPartitions(key, text).withColumn("part", F.spark_partition_id().cast("long"))
    return rows.mapInArrow(run, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long")
