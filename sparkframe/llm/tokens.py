"""Vectorised words and hashes of whole Arrow string columns, for use inside Python workers.

Hashes are 64 bits wide and seeded by fixed constants, so every task and every run agrees.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa

U64 = np.uint64
_RNG = np.random.Generator(np.random.PCG64(20240607))
#: A random 64-bit value for each byte, and an odd base for polynomial hashes with its inverse.
BYTE_CODES = _RNG.integers(1, 2**64, 256, dtype=np.uint64)
_BASE = int(_RNG.integers(1, 2**63, dtype=np.uint64)) * 2 + 1
_INVERSE = pow(_BASE, -1, 2**64)

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers = {}

#: Tables that operators keep in a worker from one task to the next.
KEPT: list[dict] = []
try:
    _trim = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # not glibc
    _trim = None


def give_back() -> None:
    """Return to the machine what allocators hold in vain: a worker serves the tasks of all operators, and would else hold the most that any of them took."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def forget() -> None:
    """Drop the tables that other operators keep in this worker."""
    if any(KEPT):
        for x in KEPT:
            x.clear()
        give_back()


def lean(run):
    """``run``, a method on batches, without others' tables; after it, its worker gives back what it holds in vain."""
    return lambda batches: _lean(run, batches)


def _lean(run, batches):
    # A function of the module, so that it sees the worker's own tables, not the driver's.
    forget()
    yield from run(batches)
    give_back()


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first ``n`` powers of the base (or its inverse) modulo 2^64."""
    have = _powers.get(inverse)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), _INVERSE if inverse else _BASE, U64)
        step[0] = 1
        have = _powers[inverse] = np.multiply.accumulate(step)
        if n > 1 << 24:  # a rare long text's table isn't kept
            _powers.pop(inverse)
    return have[:n]


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ U64(salt)
    x = (x ^ (x >> U64(31))) * U64(0x7FB5D329728EA185)
    x = (x ^ (x >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all strings of an Arrow array, and where each begins; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int):
    """Ranges (i, j) of rows that hold about ``most`` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word in ``data``, and the first word of each row (one more at the end)."""
    solid = ~BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = False
        before[1:] = solid[:-1]
        before &= ~edge[:-1]
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(len(data), bool)
    if len(data):
        after[-1] = False
        after[:-1] = solid[1:]
        after &= ~edge[1:]
    ends = np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Bytes of a span that are hashed eight at a time; a longer one is rare and hashed by itself.
_LANES = 64 * 8
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], U64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes: a chain of scramblings, eight bytes a step, so no sums or products of bytes cancel."""
    sizes = ends - starts
    out = mix(sizes.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(0x6A09E667F3BCC909))
    if not len(starts):
        return out
    lanes = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    left = np.flatnonzero((sizes > 0) & (sizes <= _LANES))
    at = 0
    while len(left):
        rest = sizes[left] - at
        out[left] = mix(out[left] ^ (lanes[starts[left] + at].view("<u8").ravel() & _LOW[np.minimum(rest, 8)]), 0x2545F4914F6CDD1D)
        left, at = left[rest > 8], at + 8
    for k in np.flatnonzero(sizes > _LANES):
        digest = hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8, key=b"sparkframe").digest()
        out[k] = int.from_bytes(digest, "little")
    return out


class Substrings:
    """Hashes of any stretch of a sequence of 64-bit symbols, from one prefix sum."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(symbols * powers(n), out=self.sums[1:])
        self.back = powers(n + 1, inverse=True)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(U64))

    def windows(self, length: int) -> np.ndarray:
        """The hash of the stretch of ``length`` symbols from every place on."""
        n = len(self.sums) - length
        return mix((self.sums[length:] - self.sums[:n]) * self.back[:n]) if n > 0 else np.zeros(0, U64)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if have < width else out


def spread(firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first, first + 1, ... (count of them) for each pair, one after another."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    begin = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) + np.repeat(firsts - begin, counts)


def column_of(data: np.ndarray, offsets: np.ndarray, binary: bool = False) -> pa.Array:
    """An Arrow string or binary array over packed bytes."""
    n = len(offsets) - 1
    kind = pa.binary() if binary else pa.string()
    return pa.Array.from_buffers(kind, n, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def spans_of(mark: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal marked stretches within each row: begin, end (both within the row) and each row's first stretch."""
    edge = np.zeros(len(mark) + 1, bool)
    edge[bounds] = True
    begin = mark.copy()
    begin[1:] &= ~mark[:-1] | edge[1:-1]
    last = mark.copy()
    last[:-1] &= ~mark[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
    first = np.searchsorted(starts, bounds)
    base = np.repeat(bounds[:-1], np.diff(first))
    return starts - base, ends - base, first


def span_column(begin: np.ndarray, end: np.ndarray, first: np.ndarray) -> pa.Array:
    """array<struct<begin, end>> with each row's stretches."""
    pairs = pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(end, pa.int64())], ["begin", "end"])
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pairs)
