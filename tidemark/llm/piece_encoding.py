"""SentencePiece encoding that keeps, for every piece, the bytes of the original text that it stands for.

A model file names its normalisation: a compiled character map (a double-array trie over UTF-8 prefixes), whether a blank is
put in front, and whether blanks are folded. Here the text is normalised by the longest prefix that the map holds at each place, noting for every
normalised byte where it came from; pieces are found on the normalised text and projected back through these notes.

The pieces themselves come from the sentencepiece library, given the normalised text and the model without its normalisation.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.arrow_text import buffers, slices

BLANK = "▁"
# Fields of the model file (pieces, trainer and normaliser settings; text, type and score of a piece; name, map and
# flags of a normaliser) and types of pieces.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_TYPE = 1, 3
TRAINER_SUFFIX = 24
MAP_NAME, MAP, MAP_PREFIX, MAP_FOLD, MAP_ESCAPE = 1, 2, 3, 4, 5
USER_DEFINED = 4


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protocol-buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or number()
        yield key >> 3, data[at : at + size]
        at += size


def message(pairs: list[tuple[int, int | bytes]]) -> bytes:
    """The message of (field, number or bytes)."""

    def number(x: int) -> bytes:
        out = bytearray()
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        return bytes([*out, x])

    return b"".join(number(k << 3) + number(v) if isinstance(v, int) else number(k << 3 | 2) + number(len(v)) + v for k, v in pairs)


class CharacterMap:
    """A compiled character map: ``longest(data, at)`` gives (replacement, bytes used) of the longest prefix there, or None.

    The map is the size of its trie in bytes (32 bits), the trie's units of 32 bits, and replacements that end in a zero byte.
    A unit holds the label of the arc that leads to it (bits 0 to 7 and 31), whether it has a value (bit 8) and how far away
    its children lie (from bit 10, times 256 where bit 9 is set); a value is the place of a replacement."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.texts = blob[4 + size :]
        first = [c for c in range(256) if self._child(0, c) is not None] if self.units else []
        self.may_start = re.compile(b"[" + b"".join(re.escape(bytes([c])) for c in first) + b"]") if first else None

    def _child(self, node: int, label: int) -> int | None:
        unit = self.units[node]
        to = node ^ ((unit >> 10) << ((unit & 0x200) >> 6)) ^ label
        return to if to < len(self.units) and self.units[to] & 0x800000FF == label else None

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        node, best = 0, None
        for i in range(at, len(data)):
            if (node := self._child(node, data[i])) is None:
                break
            unit = self.units[node]
            if unit & 0x100:
                value = self.units[node ^ ((unit >> 10) << ((unit & 0x200) >> 6))] & 0x7FFFFFFF
                best = value, i + 1 - at
        return best and (self.texts[best[0] : self.texts.index(b"\0", best[0])], best[1])


class Normalizer:
    """Normalised bytes, in which a blank stands for the mark of a blank, and where each came from."""

    def __init__(self, charmap: CharacterMap, prefix: bool, fold: bool, kept: list[bytes] = ()):
        self.map, self.prefix, self.fold = charmap, prefix, fold
        self.kept = re.compile(b"|".join(re.escape(x) for x in sorted(kept, key=len, reverse=True))) if kept else None
        self.plain = charmap.may_start is None and not fold

    def text(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised form of one text and n + 1 places in it: byte i came from ``places[i]`` on."""
        out, came, at = bytearray(), [], 0
        while at < len(data):
            part, used = self._prefix(data, at)
            if self.fold and (not out or out[-1] == 32):
                part = part.lstrip(b" ")
            out += part
            came += [at] * len(part)
            at += used
        end = len(data)
        if self.fold:
            while n := out.endswith(b" ") + 3 * out.endswith(BLANK.encode()):
                del out[-n:]
                end, came = came[-n], came[:-n]
        if self.prefix and out:
            out[:0], came[:0] = b" ", [came[0]]
        return bytes(out), np.array([*came, end], np.int64)

    def _prefix(self, data: bytes, at: int) -> tuple[bytes, int]:
        if self.kept and (m := self.kept.match(data, at)):
            return m[0], len(m[0])
        if self.map.may_start and self.map.may_start.match(data, at) and (found := self.map.longest(data, at)):
            return found
        size = 1 + (data[at] >= 0xC0) + (data[at] >= 0xE0) + (data[at] >= 0xF0)
        return data[at : at + size], size

    def batch(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, n + 1 offsets, places) of many texts; the places are counted from the start of each text, one more than bytes a text."""
        n = np.diff(offs)
        if not self.plain:
            raw = data.tobytes()
            each = [self.text(raw[a:b]) for a, b in zip(offs[:-1], offs[1:], strict=True)]
            out = np.frombuffer(b"".join(x for x, _ in each), np.uint8)
            return out, np.append(0, np.cumsum([len(x) for x, _ in each], dtype=np.int64)), np.concatenate([x for _, x in each] or [np.zeros(0, np.int64)])
        more = (n > 0) & self.prefix
        ends = np.cumsum(n + more)
        starts = np.append(0, ends)
        if self.prefix:
            data = np.insert(data, offs[:-1][more], 32)
        size = np.diff(starts) + 1
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) - np.repeat(more, size)
        return data, starts, np.maximum(place, 0)


class Encoded(NamedTuple):
    """Flat ids, the place in the original text where each one's piece ends, and n + 1 offsets of the texts."""

    ids: np.ndarray
    ends: np.ndarray
    first: np.ndarray


class PieceEncoder:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as f:
            model = list(fields(f.read()))
        own = dict(fields(next((v for k, v in model if k == NORMALIZER), b"")))
        trainer = dict(fields(next((v for k, v in model if k == TRAINER), b"")))
        if trainer.get(TRAINER_SUFFIX) or not own.get(MAP_ESCAPE, 1):
            raise ValueError("models with blanks after words, or without marks for blanks, aren't read")
        pieces = [dict(fields(v)) for k, v in model if k == PIECES]
        texts = [p[PIECE_TEXT].decode() for p in pieces]
        marked = [p[PIECE_TEXT] for p in pieces if p.get(PIECE_TYPE, 1) == USER_DEFINED]
        self.normalizer = Normalizer(CharacterMap(own.get(MAP, b"")), bool(own.get(MAP_PREFIX, 1)), bool(own.get(MAP_FOLD, 1)), marked)
        # The same model without a normalisation of its own.
        none = message([(MAP_NAME, b"identity"), (MAP_PREFIX, 0), (MAP_FOLD, 0), (MAP_ESCAPE, 1)])
        bare = message([(k, v) for k, v in model if k != NORMALIZER] + [(NORMALIZER, none)])
        self.bare, self.whole = SentencePieceProcessor(model_proto=bare), SentencePieceProcessor(model_file=path)
        # Bytes of a piece where a blank is one byte; a piece for a byte stands for one.
        self.sizes = np.array([1 if self.bare.is_byte(i) else len(t.replace(BLANK, " ").encode()) for i, t in enumerate(texts)], np.int64)

    def encode(self, column) -> Encoded:
        """Ids and projected ends of a string column; null counts as empty."""
        data, offs, places = self.normalizer.batch(*buffers(column))
        raw = data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(offs[:-1], offs[1:], strict=True)]
        each = self.bare.encode(texts, num_threads=1) if texts else []
        first = np.append(0, np.cumsum(np.fromiter(map(len, each), np.int64, len(each))))
        ids = np.fromiter(chain.from_iterable(each), np.int64, first[-1])
        sizes = self.sizes[ids]
        # Marks of blanks in a text, and characters that no piece has, aren't as long as the table says: the library tells.
        told = np.append(0, np.cumsum(sizes))[first]
        for i in np.flatnonzero(np.diff(told) != np.diff(offs)):
            sizes[first[i] : first[i + 1]] = np.diff([0, *(p.end for p in self.bare.encode(texts[i], return_type="proto").pieces)])
        # Ends in the normalised text; those inside a character (pieces of single bytes) fall back to its start.
        ends = np.cumsum(sizes)
        inside = np.flatnonzero(ends < len(data))
        while len(inside := inside[data[ends[inside]] & 0xC0 == 0x80]):
            ends[inside] -= 1
        text = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        return Encoded(ids, places[ends + text], first)

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode(ids)


_ENCODERS: dict[str, PieceEncoder] = {}


def piece_encoder(path: str) -> PieceEncoder:
    """The worker's encoder for a model file, kept between tasks."""
    if path not in _ENCODERS:
        if not os.path.exists(own := path):  # this machine may keep the public files elsewhere than the driver's
            import public_tokenizers

            own = str(public_tokenizers.path(os.path.basename(path)))
        _ENCODERS[path] = PieceEncoder(own)
    return _ENCODERS[path]


def encode_documents(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", batch_bytes: int = 4 << 20) -> DataFrame:
    """(key, ids, ends, decoded) of every row: the ids of its text, without begin and end ids, the place in the text's UTF-8 bytes where each
    piece ends, and the text that the library decodes from the ids.

    Piece i stands for the bytes from the end of piece i - 1 (0 for the first, but for blanks that the model drops in front) to its own; of a character that is
    spelt in bytes the last byte's piece holds it, those before it hold nothing. A null or empty text has no ids and decodes to an empty one. Rows
    stay one to one, repeated keys, null keys and ties included; other columns are dropped, whatever their names.
    """
    told = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = told.select("key").schema.add("ids", T.ArrayType(T.IntegerType())).add("ends", T.ArrayType(T.IntegerType())).add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(model)
        for whole in batches:
            for batch in slices(whole, "text", batch_bytes):
                got = encoder.encode(batch.column(1))
                first = pa.array(got.first.astype(np.int32))
                lists = [pa.ListArray.from_arrays(first, pa.array(x.astype(np.int32))) for x in (got.ids, got.ends)]
                ids = got.ids.tolist()
                texts = [encoder.decode(ids[a:b]) for a, b in zip(got.first[:-1], got.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.array(texts, pa.string())], ["key", "ids", "ends", "decoded"])

    return told.mapInArrow(run, schema).withColumnRenamed("key", key)
