"""Token ids in fixed-width bit-packed files with random access.

File: a 40-byte header (magic, version, bits per id, documents, ids, block size, bytes of the keys), the documents' first-id
offsets as (documents + 1) 64-bit integers, the byte offset of each block as (blocks + 1) 64-bit integers, the documents'
keys as an Arrow stream of one column, then the blocks. So the files alone give the documents back.
Block: ``block`` ids (the last fewer), each in the fewest bits that hold the vocabulary, most significant bit first.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import files
from tidemark.llm.arrow_text import slices
from tidemark.llm.encoding import crc, encoder
from tidemark.shared import materialize, new_folder

MAGIC, HEAD = b"TMBP", struct.Struct("<4sHHQQQQ")
BLOCK = 1 << 16
#: Bounds of ranges are literals of the plan: 0.4 MB at most.
MOST_RANGES = 50_000


def width(vocabulary: int) -> int:
    """Fewest bits for ids 0 to ``vocabulary`` - 1."""
    return max(1, int(vocabulary - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    if bits == 16:
        return ids.astype(">u2").tobytes()
    wide = np.unpackbits(ids.astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
    return np.packbits(wide[:, 32 - bits :].reshape(-1)).tobytes()


def unpack_bits(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, ">u2", n).astype("<u4")
    wide = np.zeros((n, 32), np.uint8)
    wide[:, 32 - bits :] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    return np.packbits(wide, axis=1).view(">u4").reshape(-1).astype("<u4")


def encode_file(ids: np.ndarray, offsets: np.ndarray, bits: int, block: int = BLOCK, keys: pa.Array | None = None) -> Iterator[bytes]:
    """Parts of one file of documents ``ids[offsets[i] : offsets[i + 1]]``; without keys they are numbered."""
    keys = pa.array(range(len(offsets) - 1), pa.int64()) if keys is None else keys
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("key", keys.type)])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([keys], names=["key"]))
    told = sink.getvalue().to_pybytes()
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    parts = [pack_bits(ids[a : a + block], bits) for a in range(0, len(ids), block)]
    yield HEAD.pack(MAGIC, 2, bits, len(offsets) - 1, len(ids), block, len(told))
    yield np.asarray(offsets, "<i8").tobytes()
    yield np.cumsum([0, *map(len, parts)]).astype("<i8").tobytes()
    yield told
    yield from parts


class Reader:
    """Random access to one file: only the blocks that hold a document are read."""

    def __init__(self, file):
        self.file = file
        magic, version, self.bits, self.docs, self.ids, self.block, told = HEAD.unpack(file.read(HEAD.size))
        if magic != MAGIC or version != 2:
            raise ValueError("not a bit-packed id file")
        self.offsets = np.frombuffer(file.read(8 * (self.docs + 1)), "<i8")
        self.blocks = np.frombuffer(file.read(8 * (-(-self.ids // self.block) + 1)), "<i8")
        self.keys = pa.ipc.open_stream(file.read(told)).read_all().column(0).combine_chunks()
        self.body = HEAD.size + self.offsets.nbytes + self.blocks.nbytes + told

    def span(self, a: int, b: int) -> np.ndarray:
        """Ids a to b - 1 of the file."""
        if a >= b:
            return np.zeros(0, "<u4")
        p, q = a // self.block, (b - 1) // self.block
        self.file.seek(self.body + int(self.blocks[p]))
        data = self.file.read(int(self.blocks[q + 1] - self.blocks[p]))
        own = [unpack_bits(data[self.blocks[i] - self.blocks[p] : self.blocks[i + 1] - self.blocks[p]], self.bits, min(self.block, self.ids - i * self.block)) for i in range(p, q + 1)]
        return np.concatenate(own)[a - p * self.block : b - p * self.block]

    def document(self, i: int) -> np.ndarray:
        return self.span(int(self.offsets[i]), int(self.offsets[i + 1]))


def write_ids(docs: DataFrame, folder: str, tokenizer: str, vocabulary: int, end_id: int = 1, file_ids: int = 8_000_000, range_bytes: int = 256 << 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files of ``docs`` in ascending key order and returns their manifest (part, nth, path, docs, ids).

    Rows are dealt by key range and sorted within; range bounds come from the key column alone. A task cuts its range into files of about
    ``file_ids`` ids, so it holds one file's ids at most. Files are moved into place whole: a retried task replaces
    them by equal ones. Null keys come first; equal keys stay together in the order of their texts. There are as many
    ranges as shuffle partitions, and more where the scan's estimated size gives a range over ``range_bytes``.
    """
    bits = width(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ctx = TaskContext.get()
        part, attempt = ctx.partitionId(), f"{ctx.stageId()}-{ctx.taskAttemptId()}"
        encode, flat, own, held, nth = encoder(tokenizer, end_id).encode, [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal flat, own, held, nth
            sizes = np.concatenate(own)
            path = f"{folder}/ids-{part:06d}-{nth:06d}.bin"
            files.write(path, encode_file(np.concatenate(flat), np.append(0, np.cumsum(sizes)), bits, keys=pa.concat_arrays(keys)), attempt)
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "nth": pa.array([nth], pa.int64()), "path": [path], "docs": pa.array([len(sizes)], pa.int64()), "ids": pa.array([held], pa.int64())})
            flat, own, held, nth = [], [], 0, nth + 1
            keys.clear()
            return out

        keys: list = []
        for batch in batches:
            for piece in slices(batch, text):
                ids, offs = encode(piece.column(1))
                flat.append(ids)
                own.append(np.diff(offs))
                keys.append(piece.column(0))
                held += len(ids)
                if held >= file_ids:
                    yield flush()
        if own:
            yield flush()

    rows = docs.select(F.col(key), F.col(text))
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # of the files; the text is a few times as large
    n = min(max(1, docs.sparkSession._jsparkSession.sessionState().conf().numShufflePartitions(), 4 * size // range_bytes), MOST_RANGES)
    ranged = _by_range(rows, key, n).sortWithinPartitions(F.col(key).asc_nulls_first(), text)
    return ranged.mapInArrow(run, "part long, nth long, path string, docs long, ids long")


def _by_range(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Deals rows out by ranges of the key. For numeric keys the bounds are quantiles of the key column, which a scan reads alone;
    Spark's own range partitioner, which serves other keys, would run over the texts to sample them."""
    if not isinstance(rows.schema[key].dataType, T.NumericType):
        return rows.repartitionByRange(n, F.col(key).asc_nulls_first())
    bounds = sorted(set(rows.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    if not bounds:
        return rows.repartition(1)
    # Two levels of about sqrt(n) bounds each instead of one look at all n.
    k, x = math.isqrt(len(bounds)) + 1, F.col(key).cast("double")
    edges, coarse = F.lit(bounds), F.lit([*bounds[k - 1 :: k], float("inf")])
    rows = rows.withColumn("_c", F.coalesce(F.size(F.filter(coarse, lambda b: b <= x)), F.lit(0)))
    at = F.col("_c") * k + F.coalesce(F.size(F.filter(F.slice(edges, F.col("_c") * k + 1, k), lambda b: b <= x)), F.lit(0))
    return rows.repartitionById(len(bounds) + 1, at.cast("int")).drop("_c")


def read_ids(manifest: DataFrame, key: str, kind: str) -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of every document, from the files that the manifest lists.

    ``start`` counts the ids of all documents before. Files are read by the executors, document by document."""
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("n"))
    # One row per range: as many as there are partitions.
    before, total = {}, 0
    for r in parts.orderBy("part").collect():
        before[r.part] = total
        total += r.n
    spark = manifest.sparkSession
    base = spark.createDataFrame(list(before.items()) or [(0, 0)], "part long, base long")
    inner = Window.partitionBy("part").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    each = manifest.withColumn("skip", F.coalesce(F.sum("ids").over(inner), F.lit(0))).join(F.broadcast(base), "part").select("path", (F.col("base") + F.col("skip")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with files.read(path) as f:
                    reader = Reader(f)
                    offs, step, sums = reader.offsets, 4096, []
                    for a in range(0, reader.docs, step):
                        b = min(a + step, reader.docs)
                        ids = reader.span(int(offs[a]), int(offs[b]))
                        sums += [crc(ids[offs[i] - offs[a] : offs[i + 1] - offs[a]]) for i in range(a, b)]
                yield pa.RecordBatch.from_arrays([reader.keys, pa.array(offs[:-1] + start), pa.array(np.diff(offs)), pa.array(sums, pa.int64())], names=[key, "start", "n_tokens", "ids_crc32"])

    return each.mapInArrow(run, f"`{key}` {kind}, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, vocabulary: int = 49408, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes ``docs`` as id files in the shared scratch folder and reads them back: (key, start, n_tokens, ids_crc32).

    Null and empty texts are the end id alone; repeated rows are documents of their own; an empty table gives no rows;
    extra columns are ignored."""
    folder = new_folder(docs.sparkSession, "ids")
    manifest = materialize(write_ids(docs, folder, tokenizer, vocabulary, end_id, key=key, text=text), "ids-manifest")
    return read_ids(manifest, key, docs.schema[key].dataType.simpleString())
