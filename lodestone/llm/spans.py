"""Vectorised word and line work over the raw UTF-8 bytes of an Arrow text column.

An Arrow string column is one byte buffer with offsets, so word boundaries, ASCII case folding and 64-bit
rolling hashes of words and word windows are whole-array numpy operations; no Python object is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: `[^\x20\x09-\x0D]`
NON_SPACE = ~SPACE
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` on lower-cased text: digits, a-z and all bytes of non-ASCII code points.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
#: A-Z to a-z; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, _U), np.ones(1, _U)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words (the finaliser of splitmix64)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=_U) * _U(_BASE))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 65536)
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, _U)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def hash_spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[s:e] for each span, from one prefix sum of a polynomial over the whole array."""
    up, down = _powers_to(len(values) + 1)
    sums = np.zeros(len(values) + 1, _U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * down[starts]
    return mix(h + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts end to end and the offset of each; a null text has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def chunked(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row past the last, bytes, offsets) over runs of whole rows of about `limit` bytes; one long text makes a longer run."""
    data, at = text_buffers(column)
    low, n = 0, len(at) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(at, at[low] + limit, "right")) - 1)
        yield low, high, data[at[low] : at[high]], at[low : high + 1] - at[low]
        low = high
    release_memory()


def release_memory() -> None:
    """Give freed memory back to the system: Python workers live on between tasks, and an executor's memory is shared."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not glibc
        pass


def word_spans(data: np.ndarray, at: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text (and the end) the index of its first word."""
    n = len(data)
    inside = is_word[data]
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[at[at < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[at[at > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, at)


def line_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all \\n-split lines (an empty text has one empty line), and the first line of each text."""
    breaks = np.flatnonzero(data == 0x0A)
    counts = np.searchsorted(breaks, at[1:]) - np.searchsorted(breaks, at[:-1]) + 1
    first = np.zeros(len(at), np.int64)
    np.cumsum(counts, out=first[1:])
    starts = np.empty(first[-1], np.int64)
    ends = np.empty(first[-1], np.int64)
    opens = np.zeros(first[-1], bool)
    opens[first[:-1]] = True
    starts[first[:-1]] = at[:-1]
    starts[~opens] = breaks + 1
    closes = np.zeros(first[-1], bool)
    closes[first[1:] - 1] = True
    ends[first[1:] - 1] = at[1:]
    ends[~closes] = breaks
    return starts, ends, first


def strip_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The spans without white space at both ends; a blank span becomes empty."""
    solid = np.flatnonzero(NON_SPACE[data])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = a < b
    if not len(solid):
        return starts, starts.copy()
    low = np.where(full, solid[np.minimum(a, len(solid) - 1)], starts)
    high = np.where(full, solid[np.maximum(b - 1, 0)] + 1, starts)
    return low, high


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words with A-Z lower-cased."""
    return hash_spans(BYTE_VALUE[LOWER[data]], starts, ends)


def order_by_text(text: np.ndarray, h: np.ndarray) -> np.ndarray:
    """np.lexsort((h, text)), by two sorts that numpy does faster where the texts fit in 16 bits."""
    if len(text) and text.max() >= 1 << 16:
        return np.lexsort((h, text))
    order = np.argsort(h)
    return order[np.argsort(text[order].astype(np.uint16), kind="stable")]


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Indices of the words at which a window of `width` words of one text begins."""
    n = int(first[-1])
    room = np.repeat(first[1:], np.diff(first)) - np.arange(n)
    return np.flatnonzero(room >= width)


def per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of a per-word (or per-line) array over each text."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
