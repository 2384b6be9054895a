"""Vectorised work on batches of texts: byte views of Arrow columns, word spans, word and n-gram keys.

A word is a run of bytes other than the six ASCII blanks (0x20, 0x09-0x0D). Texts stay UTF-8 bytes, so a whole
batch is handled by a few numpy passes and no Python string is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLANK = np.zeros(256, dtype=bool)
BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: Bytes of text handled at once; a longer text is a slice of its own.
SLICE_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values, one after another, and the ``n + 1`` offsets into them. A null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = SLICE_BYTES, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds about ``most`` bytes of the text column and at most ``rows`` rows, so memory follows
    neither text length nor the number of short texts."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = utf8(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
            to = min(max(to, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def release() -> None:
    """Give memory that a finished piece of work has freed back to the system, as a worker waits for its next task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def word_spans(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and text number of each word, in order. ``blank`` tells the bytes that part words."""
    full = ~blank[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    before = np.zeros(len(data) + 1, dtype=bool)
    before[1:] = full
    after = np.zeros(len(data) + 1, dtype=bool)
    after[:-1] = full
    starts = np.flatnonzero(after & (~before | cut))
    ends = np.flatnonzero(before & (~after | cut))
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, as many as a stretch of two slices needs."""
    if not _POWERS:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(2 * SLICE_BYTES + 1, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def _sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomials of spans that lie in at most two slices."""
    up, down = _powers()
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:len(data)], out=sums[1:])
    return (sums[ends] - sums[starts]) * down[starts]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit key of each byte span: a polynomial in the bytes, then mixed. Equal spans have equal keys on any machine. Starts
    ascend. Long data is taken in stretches, each from the first start behind the last one, so memory does not follow its length."""
    sizes = (ends - starts).astype(np.uint64)
    if len(data) <= 2 * SLICE_BYTES:
        return mix(_sums(data, starts, ends) + sizes)
    out = np.zeros(len(starts), dtype=np.uint64)
    k = 0
    while k < len(starts):
        a = int(starts[k])
        to = int(np.searchsorted(starts, a + SLICE_BYTES, side="right"))
        inside = np.flatnonzero(ends[k:to] <= a + 2 * SLICE_BYTES) + k
        piece = data[a:a + 2 * SLICE_BYTES]
        out[inside] = _sums(piece, starts[inside] - a, ends[inside] - a)
        for j in np.setdiff1d(np.arange(k, to), inside):
            # Horner's rule over the span's own slices, from the last to the first.
            total, step = 0, pow(_BASE, SLICE_BYTES, 1 << 64)
            for at in reversed(range(int(starts[j]), int(ends[j]), SLICE_BYTES)):
                part = data[at:min(at + SLICE_BYTES, int(ends[j]))]
                total = (total * step + int(_sums(part, np.zeros(1, np.int64), np.full(1, len(part)))[0])) % (1 << 64)
            out[j] = total
        k = to
    return mix(out + sizes)


def combine(keys: np.ndarray, n: int) -> np.ndarray:
    """Key of each run of ``n`` keys; one entry per possible start."""
    size = max(0, len(keys) - n + 1)
    out = np.zeros(size, dtype=np.uint64)
    for j in range(n):
        out = mix(out * np.uint64(_BASE) + keys[j:j + size])
    return out
