"""Vectorised text primitives over Arrow string columns.

Everything here works on the UTF-8 bytes of a slice of rows at once, so that a
Python worker spends its time in numpy rather than in per-word Python code.
Memory is bounded by ``SLICE_BYTES`` of text (or one row, if that is longer).
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

#: ASCII white space that separates words: 0x09-0x0D and 0x20.
WS = np.zeros(256, bool)
WS[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        size = 1 + (1 << max(20, (n - 2).bit_length()))
        a = np.full(size, _BASE, np.uint64)
        b = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        a[0] = b[0] = 1
        _pow, _inv = np.cumprod(a), np.cumprod(b)
    return _pow[:n], _inv[:n]


class Spans:
    """Hashes of byte spans of one buffer, by prefix sums of a polynomial modulo 2**64."""

    def __init__(self, buf: np.ndarray):
        power, self.inv = _powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE[buf] * power[: len(buf)], out=self.sums[1:])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inv[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def release() -> None:
    """Gives what this worker no longer uses back to the system: workers wait for other tasks with what they have once taken."""
    global _pow, _inv
    if len(_pow) > 1 << 21:  # a very long row was there
        _pow = _inv = np.ones(1, np.uint64)
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """f over a task's batches, releasing memory when they end."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            release()

    return run


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    """The column as strings; null reads as empty."""
    c = batch.column(batch.schema.get_field_index(name))
    return (c if pa.types.is_string(c.type) else c.cast(pa.string())).fill_null("")


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows on end, and where each row starts (one more entry than rows)."""
    offs = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4).astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and offs[-1] > offs[0] else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE_BYTES):
    """The batch in runs of rows of about ``limit`` bytes of text, at least a row each."""
    if not batch.num_rows:
        return
    offs = raw(column(batch, name))[1]
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def code_points(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code points whose UTF-8 starts at each place."""
    lead = buf[at].astype(np.int64)
    out = lead.copy()
    for size, least, mask in ((2, 0xC0, 0x1F), (3, 0xE0, 0x0F), (4, 0xF0, 0x07)):
        k = np.flatnonzero((lead >= least) & (lead < {2: 0xE0, 3: 0xF0, 4: 0x100}[size]))
        code = lead[k] & mask
        for j in range(1, size):
            code = code << 6 | (buf[at[k] + j] & 0x3F)
        out[k] = code
    return out


def cut_out(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The spans of a buffer as strings."""
    size = end - start
    offs = np.concatenate([[0], np.cumsum(size)])
    take = np.arange(offs[-1]) + np.repeat(start - offs[:-1], size)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf[take])))


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the first word of each row (one more entry than rows)."""
    ink = ~WS[buf]
    before = np.empty_like(ink)
    before[:1], before[1:] = False, ink[:-1]
    after = np.empty_like(ink)
    after[-1:], after[:-1] = False, ink[1:]
    first = offs[:-1][offs[:-1] < offs[1:]]
    before[first] = False
    after[first[1:] - 1] = False
    start, end = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
    return start, end, np.searchsorted(start, offs)


def per_row(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of ``mask`` between consecutive bounds."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def ngrams(h: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each n-word window inside a row, and the first window of each row."""
    count = np.maximum(np.diff(bounds) - n + 1, 0)
    first = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(first[-1]) + np.repeat(bounds[:-1] - first[:-1], count)
    g = h[at]
    for k in range(1, n):
        g = mix(g * np.uint64(3) + h[at + k])
    return g, first


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
