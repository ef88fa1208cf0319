"""Vectorised words, windows and hashes over whole Arrow batches of texts.

A batch of documents is one UTF-8 buffer. Word borders, 64-bit word hashes,
window hashes and re-joined texts are numpy expressions over that buffer, so no
Python loop runs per word or per window and memory is a few arrays of the
batch's size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Java and Python spelling of a word: code points other than space and TAB..CR.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _RNG.integers(0, 2**64, 256, np.uint64)
_PLACE = _RNG.integers(0, 2**64, 4096, np.uint64) | np.uint64(1)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text. Offsets start at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """Words of a batch: byte borders, and for document k the words first[k]:first[k+1]."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def document(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def words(raw: np.ndarray, offsets: np.ndarray) -> Words:
    """Word borders; a word never runs from one document into the next."""
    inside = ~_IS_SPACE[raw]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(raw)]
    begins[inner] = inside[inner]
    ends = inside.copy()  # the last byte of a word
    ends[:-1] &= ~inside[1:]
    before = inner[inner > 0] - 1
    ends[before] = inside[before]
    start = np.flatnonzero(begins)
    return Words(raw, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective avalanche of 64-bit values (the public splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit multilinear hash of each word's bytes, avalanched."""
    if not len(w.start):
        return np.zeros(0, np.uint64)
    lengths = w.end - w.start
    place = np.arange(len(w.raw), dtype=np.int64)
    place -= np.repeat(np.append(0, w.start), np.diff(np.concatenate(([0], w.start, [len(w.raw)]))))
    far = place >= len(_PLACE)
    weight = _PLACE[place & (len(_PLACE) - 1)]
    if far.any():  # very long words: another weight for each further stretch
        weight = np.where(far, mixed(weight + (place >> 12).astype(np.uint64)) | np.uint64(1), weight)
    value = _BYTE[w.raw] * weight
    value[_IS_SPACE[w.raw]] = 0
    return mixed(np.add.reduceat(value, w.start) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def window_hashes(h: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Order-sensitive hash of every `length` consecutive entries of h (len(h)-length+1 of them).

    Built by doubling: windows of 2m come from two windows of m, so the cost is
    O(log length) array passes instead of `length`.
    """
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, step = mixed(h + np.uint64(seed)), 1
    out, done, left = None, 0, length
    while left:
        if left & 1:
            piece = power[done : done + n]
            out = piece.copy() if out is None else mixed(out * np.uint64(0x9E3779B97F4A7C15) + piece)
            done += step
        left >>= 1
        if left:
            power = mixed(power[:-step] * np.uint64(0xD6E8FEB86659FD93) + power[step:])
            step *= 2
    return out


def gathered(raw: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte ranges start:end of each document joined by one space: (bytes, document offsets).

    Ranges first[k]:first[k+1] belong to document k; nothing follows a document's last range.
    """
    lengths = end - start + 1
    total = np.concatenate(([0], np.cumsum(lengths)))
    source = np.arange(total[-1], dtype=np.int64) + np.repeat(start - total[:-1], lengths)
    out = raw[np.minimum(source, max(len(raw) - 1, 0))] if len(raw) else np.zeros(0, np.uint8)
    out[total[1:] - 1] = 0x20
    filled = first[1:] > first[:-1]
    keep = np.ones(len(out), bool)
    keep[total[first[1:][filled]] - 1] = False
    offsets = total[first] - np.concatenate(([0], np.cumsum(filled)))
    return out[keep], offsets


def strings(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string column over the bytes."""
    column = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))
    return column.cast(pa.string()) if len(raw) < 2**31 else column
