"""Words, lines and their hashes for whole Arrow batches of texts, as numpy arrays over the UTF-8 bytes.

A batch's texts lie one after the other in one buffer, so finding words, hashing them and counting code
points are a few vector passes over that buffer instead of a loop over words. Offsets are bytes inside a
chunk; `Chunk.code_points` turns them into code points. A null text counts as empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
"""Texts are taken in chunks of about this size; a longer text is a chunk of its own."""

_MASK = (1 << 64) - 1


def _splitmix(state: int) -> int:
    state = (state + 0x9E3779B97F4A7C15) & _MASK
    state = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    state = ((state ^ (state >> 27)) * 0x94D049BB133111EB) & _MASK
    return state ^ (state >> 31)


def mix(values: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values, so that any of their bits can be used on their own."""
    out = values.astype(np.uint64)
    out ^= out >> np.uint64(30)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(31)
    return out


@cache
def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of 256 booleans, true inside the given byte ranges (ends included)."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
NON_SPACE = ~SPACE
ALNUM = byte_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
"""ASCII letters and digits and every byte of a non-ASCII character."""

FOLD = np.arange(256, dtype=np.uint8)
FOLD[0x41:0x5B] += 32
AS_IS = np.arange(256, dtype=np.uint8)


@cache
def _byte_values(salt: int, fold: bool) -> np.ndarray:
    values = np.array([_splitmix(salt * 256 + k) | 1 for k in range(256)], dtype=np.uint64)
    return values[FOLD if fold else AS_IS]


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(salt: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64; kept for chunks of the usual size."""
    kept = _POWERS.get(salt)
    if kept is not None and len(kept[0]) >= length:
        return kept
    base = _splitmix(salt + 7) & ~7 | 3
    made = tuple(_geometric(x, max(length, CHUNK_BYTES + 1)) for x in (base, pow(base, -1, 1 << 64)))
    if length <= CHUNK_BYTES + 1:
        _POWERS[salt] = made
    return made


def _geometric(ratio: int, length: int) -> np.ndarray:
    out = np.ones(length, dtype=np.uint64)
    filled = 1
    while filled < length:
        step = min(filled, length - filled)
        out[filled : filled + step] = out[:step] * np.uint64(pow(ratio, filled, 1 << 64))
        filled += step
    return out


class SpanHash:
    """64-bit hashes of any byte ranges of a chunk, from one running sum."""

    def __init__(self, data: np.ndarray, fold: bool, salt: int):
        self._powers, self._inverse = _powers(salt, len(data) + 1)
        self._sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_byte_values(salt, fold)[data] * self._powers[: len(data)], out=self._sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[start]) * self._inverse[start] + (end - start).astype(np.uint64))


class Chunk:
    """Neighbouring texts of a batch: rows `first` to `first + len(self)` of it."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray):
        self.first, self.data, self.offsets = first, data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of the class inside one text, and how many each text has."""
        inside = table[self.data]
        edge = np.zeros(len(self.data) + 1, dtype=bool)
        edge[self.offsets] = True
        before = np.zeros(len(self.data) + 1, dtype=bool)
        before[1:] = inside
        starts = np.flatnonzero(inside & (~before[:-1] | edge[:-1]))
        after = np.zeros(len(self.data), dtype=bool)
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends, np.diff(np.searchsorted(starts, self.offsets))

    def hasher(self, fold: bool = False, salt: int = 0) -> SpanHash:
        return SpanHash(self.data, fold, salt)

    def code_points(self) -> np.ndarray:
        """Number of code points that begin before each byte."""
        out = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=out[1:])
        return out

    def count(self, table: np.ndarray) -> np.ndarray:
        """How many bytes of each text are in the class."""
        return np.diff(np.searchsorted(np.flatnonzero(table[self.data]), self.offsets))


def chunks(texts: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The texts of an Arrow column, in order, in chunks of about `limit` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):  # no chunk at all
        texts = pa.array([], pa.string())
    if texts.null_count:
        texts = texts.fill_null("")
    wide = texts.cast(pa.large_string())
    buffers = wide.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[wide.offset : wide.offset + len(wide) + 1] if len(wide) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    low = 0
    while low < len(wide):
        high = int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1
        high = min(max(high, low + 1), len(wide))
        yield Chunk(low, data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        low = high


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def pieces(text: bytes, limit: int | None = None) -> Iterator[bytes]:
    """A text in pieces of about `limit` bytes (`CHUNK_BYTES`) that end before a blank, so that no word is cut."""
    low, limit = 0, limit or CHUNK_BYTES
    while low < len(text):
        blank = _BLANK.search(text, low + limit) if low + limit < len(text) else None
        high = blank.start() if blank else len(text)
        yield text[low:high]
        low = high


def within(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes laid end to end: each element's group, and its place in the group."""
    group = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return group, np.arange(len(group)) - begin[group] if len(group) else np.zeros(0, dtype=np.int64)


def windows(hashes: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `width` neighbouring words inside one text, and each text's number of windows.

    A window's hash stands at the place of its first word: windows of text k are the first
    `max(0, counts[k] - width + 1)` of that text's words.
    """
    number = np.maximum(counts - width + 1, 0)
    text, place = within(number)
    begin = (np.cumsum(counts) - counts)[text] + place
    total = np.zeros(len(begin), dtype=np.uint64)
    for step in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + hashes[begin + step]
    return mix(total + np.uint64(width)), number
