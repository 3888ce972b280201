"""Vectorised word handling on the UTF-8 buffers of Arrow string columns.

A word is a run of bytes other than 0x20 and 0x09-0x0D. Bytes of multi-byte
characters are all at least 0x80, so this equals the character class
``[^\\x20\\x09-\\x0D]+``. Everything here runs inside Spark tasks.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = U64(0x9E3779B97F4A7C15)
_POWERS = np.multiply.accumulate(np.full(1 << 12, _BASE, U64))
_STEP = 1 << 20


class Words(NamedTuple):
    start: np.ndarray  # byte offsets into the data
    end: np.ndarray
    doc: np.ndarray  # row within the slice
    hash: np.ndarray  # 64 bits a word


def mix(h: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit values."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def text_slices(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of rows with at
    most ``most`` bytes, or of one longer row. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Polynomial of each word's bytes, mixed; words are apart and in order."""
    if not len(start):
        return np.zeros(0, U64)
    lo = int(start[0])
    part = data[lo : int(end[-1])]
    begin = start - lo
    seg = np.diff(np.append(begin, len(part)))
    at = np.arange(len(part), dtype=np.int64)
    at -= np.repeat(begin, seg)
    value = part.astype(U64)
    value += U64(1)
    value *= _POWERS[at & 0xFFF]
    if int(seg.max()) > 0x1000:  # very long words: a second power for each 4096 bytes
        high = np.full(int(at.max() >> 12) + 1, U64(0xD6E8FEB86659FD93), U64)
        high[0] = 1  # shorter words have the same hash whatever stands beside them
        high = np.multiply.accumulate(high)
        value *= high[at >> 12]
    value[at >= np.repeat(end - start, seg)] = 0
    return mix(np.add.reduceat(value, begin) + (end - start).astype(U64))


def segment_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for each of the non-empty byte ranges, which are apart and in order."""
    cuts = [0]
    while cuts[-1] < len(start):  # pieces of about _STEP bytes, so that a very long text needs little room
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(end, start[cuts[-1]] + _STEP, "right"))))
    parts = [_hashes(data, start[a:b], end[a:b]) for a, b in zip(cuts, cuts[1:])]
    return np.concatenate(parts) if parts else np.zeros(0, U64)


def words(data: np.ndarray, offsets: np.ndarray, hashed: bool = True) -> Words:
    """The words of the rows of one slice, in order."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, z, np.zeros(0, U64))
    letter = ~SEPARATOR[data]
    begins, ends = letter.copy(), letter
    begins[1:] &= ~letter[:-1]
    edge = offsets[(offsets > 0) & (offsets < n)]
    begins[edge] = letter[edge]
    ends = letter.copy()
    ends[:-1] &= ~letter[1:]
    ends[edge - 1] = letter[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    if not hashed:
        return Words(start, end, doc, np.zeros(0, U64))
    return Words(start, end, doc, segment_hashes(data, start, end))


def runs(doc: np.ndarray, rows: int) -> np.ndarray:
    """First word of each row, and the number of words at the end."""
    return np.searchsorted(doc, np.arange(rows + 1))


_ODD = mix(np.arange(1, 257, dtype=U64)) | U64(1)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words; len(h) - k + 1 of them, or none."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = h[:n] * _ODD[0]
    for i in range(1, k):
        out += h[i : i + n] * _ODD[i]
    return mix(out)


def release() -> None:
    """Gives memory back between the tasks of a worker that Spark keeps: what
    the allocators hold, and the token encoder's tables of an earlier operator."""
    if encode := sys.modules.get(f"{__package__}.encode"):
        encode.forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def sliced(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of slices of all batches."""
    release()
    for b in batches:
        for lo, hi, data, offsets in text_slices(b.column(b.schema.get_field_index(column))):
            yield b.slice(lo, hi - lo), data, offsets
    release()


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
