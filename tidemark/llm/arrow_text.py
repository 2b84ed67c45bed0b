"""Vectorised views of Arrow string columns: byte buffers, word chunks and their dictionaries.

A chunk is a run of bytes of one text; dictionary-encoding the chunks of a batch means that Python
looks at each distinct chunk once, while everything per occurrence stays in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise, repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: White space outside blank, tab, newline and carriage return; Unicode-aware tokenizers may join it to a run of those.
OTHER_WHITE = re.compile(rb"[\x0b\x0c\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: The bytes that such white space begins with, and those that a chunk of ``spaced_chunks`` begins with.
OTHER_FIRST, SPACED = np.zeros(256, bool), np.zeros(256, bool)
OTHER_FIRST[[0x0B, 0x0C, *range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = True
SPACED[[9, 10, 13, 32]] = True


class Chunks(NamedTuple):
    """``distinct[codes[k]]`` is chunk k; text i has chunks ``first[i]`` to ``first[i + 1]``."""

    distinct: list[bytes]
    codes: np.ndarray
    first: np.ndarray


def buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and n + 1 offsets from zero; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if offs is not None and len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch of about ``limit`` bytes of text each (one row at least)."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def _encode(data: np.ndarray, offs: np.ndarray, starts: np.ndarray) -> Chunks:
    starts[offs[:-1][offs[:-1] < len(data)]] = True
    bounds = np.flatnonzero(starts)
    first = np.searchsorted(bounds, offs)
    array = pa.Array.from_buffers(pa.large_binary(), len(bounds), [None, pa.py_buffer(np.append(bounds, len(data)).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = array.dictionary_encode()
    _, ends, raw = coded.dictionary.buffers()
    ends, raw = np.frombuffer(ends, np.int64)[: len(coded.dictionary) + 1].tolist() if ends else [0], raw.to_pybytes() if raw else b""
    return Chunks([raw[a:b] for a, b in pairwise(ends)], coded.indices.to_numpy(zero_copy_only=False), first)


def word_chunks(data: np.ndarray, offs: np.ndarray) -> Chunks:
    """Chunks of one ASCII-white-space word with the white space after it (a text's leading white space is a chunk too)."""
    white = WHITE[data]
    starts = ~white
    starts[1:] &= white[:-1]
    return _encode(data, offs, starts)


def spaced_chunks(data: np.ndarray, offs: np.ndarray) -> Chunks:
    """Chunks of one word with the white space before it. No tokenizer that splits at white space joins two of them."""
    white = SPACED[data]
    starts = white.copy()
    starts[1:] &= ~white[:-1]
    raw = data.tobytes()
    at = np.flatnonzero(OTHER_FIRST[data])
    few = 16 * len(at) < len(raw)  # else, as in Japanese, the search itself is faster
    for m in filter(None, map(OTHER_WHITE.match, repeat(raw), at.tolist())) if few else OTHER_WHITE.finditer(raw):
        if m.end() < len(starts):
            starts[m.end()] = False
    return _encode(data, offs, starts)


def ragged(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The runs ``values[starts[c] : starts[c] + lengths[c]]`` for each c in ``codes``, one after the other."""
    n = lengths[codes]
    ends = np.cumsum(n)
    return values[np.repeat(starts[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]
