"""Batch encoding with a public tokenizer file: each distinct chunk of text is encoded once per worker.

Byte-level and word-level BPE never merge across the start of a run of white space, so a text's ids are its chunks' ids in
order. Chunks come from a vectorised split and a dictionary; only new ones reach the ``tokenizers`` library.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa

from tidemark.llm.arrow_text import buffers, ragged, spaced_chunks

#: Chunks that a worker keeps, of so many bytes at most each, in two halves: when one is full, the other, with what was not met
#: since, goes. So memory is bounded, frequent chunks stay and no chunk goes without its ids.
CACHE, CACHE_BYTES = 600_000, 48
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: All of ASCII's but the apostrophe, which may begin an ending of its own.
MARKS = r"""!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~"""
PLAIN = re.compile(rf"([ \n]?)([{LETTERS}]+)([{MARKS}]*)")


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's printable stand-ins: printable Latin-1 bytes stand for themselves, the others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """``encode(column)`` gives flat ids and n + 1 offsets; the end id follows each text's ids if given."""

    def __init__(self, path: str, end_id: int | None = 1):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.end_id = end_id
        self.model = self.tokenizer.model
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.table = {k: v for k, v in _byte_alphabet().items()}
        kept = [x.ids for x in self.tokenizer.encode_batch([" a", "a", "A"], add_special_tokens=False)]
        self.spaced, self.lowers = kept[0] != kept[1], kept[1] == kept[2]

    def _ids(self, piece: str) -> bytes:
        """Ids of one pre-token by the model alone."""
        ids = [t.id for t in self.model.tokenize(piece)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, piece: str) -> bytes:
        return self._ids(piece.replace(" ", "Ġ") if piece.isascii() else piece.encode().decode("latin-1").translate(self.table))

    def _piece(self, piece: str) -> bytes:
        """Ids of marks or of a line's end, which are few."""
        if (got := self.pieces.get(piece)) is None:
            got = self.pieces[piece] = self._ids(piece.translate(self.table))
        return got

    def _chunk(self, text: str) -> bytes | None:
        """Ids of a chunk that is plainly a word and marks, where pre-tokenizing is known; else None."""
        if m := PLAIN.fullmatch(text):
            space, word, marks = m.groups()
            if self.lowers:
                word = word.lower()
            own = " " + word if space == " " or not self.spaced else word
            ids = None
            if own != text:  # the same word may be known without its marks
                ids = self.cache.get(known := own.encode()) or self.older.get(known)
            if ids is None:
                ids = self._word(own if self.spaced else word)
            if space == "\n" and self.spaced:
                ids = self._piece(space) + ids
            return ids + self._piece(marks) if marks else ids
        return None

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        data, offs = buffers(column)
        distinct, codes, first = spaced_chunks(data, offs)
        if len(self.cache) + len(distinct) > CACHE // 2:
            self.cache, self.older = {}, self.cache
        if len(self.pieces) > CACHE // 12:
            self.pieces = {}
        cache, older, hard, long = self.cache, self.older, [], []
        for c in [c for c in distinct if c not in cache]:
            if (ids := older.get(c)) is None:
                text = c.decode()
                if len(c) > CACHE_BYTES:
                    long.append(c)
                    hard.append(text)
                    continue
                if (ids := self._chunk(text)) is None:
                    hard.append(text)
                    continue
            cache[c] = ids
        for at in range(0, len(hard), 4096):
            part = hard[at : at + 4096]
            for text, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                cache[text.encode()] = np.array(e.ids, "<u4").tobytes()
        runs = list(map(cache.__getitem__, distinct))
        for c in long:
            del cache[c]
        lengths = np.fromiter(map(len, runs), np.int64, len(runs)) // 4
        values = np.frombuffer(b"".join(runs), "<u4")
        starts = np.cumsum(lengths) - lengths
        if self.end_id is None:
            return ragged(values, starts, lengths, codes), np.append(0, np.cumsum(lengths[codes]))[first]
        # The end id is one more chunk after each text's own.
        values, starts, lengths = np.append(values, np.uint32(self.end_id)), np.append(starts, len(values)), np.append(lengths, 1)
        codes = np.insert(codes.astype(np.int64), first[1:], len(runs))
        first = first + np.arange(len(first))
        return ragged(values, starts, lengths, codes), np.append(0, np.cumsum(lengths[codes]))[first]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int | None = 1) -> Encoder:
    """The worker's encoder for a file, kept between tasks."""
    if (path, end_id) not in _ENCODERS:
        if not os.path.exists(own := path):  # this machine may keep the public files elsewhere than the driver's
            import public_tokenizers

            own = str(public_tokenizers.path(os.path.basename(path)))
        _ENCODERS[path, end_id] = Encoder(own, end_id)
    return _ENCODERS[path, end_id]


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").data)
