"""Vectorised views of Arrow text columns: UTF-8 bytes, words, hashes.

Helpers of the operators; they run inside tasks on one Arrow batch, cut into slices of bounded size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of text worked on at once in a task; a longer document is a slice of its own.
SLICE = 512 << 10
#: Ranges hashed at once, and the length from which a range is hashed by itself.
_AT_ONCE, _LONG = 1 << 16, 256

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def _table(is_in) -> np.ndarray:
    return np.array([is_in(b) for b in range(256)], bool)


#: Bytes of a word: all but ASCII space and the five controls from tab to carriage return.
GRAPHIC = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Bytes of a word once lower-cased: digits, a-z and everything beyond ASCII.
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
#: A-Z to a-z, all else unchanged.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


Batches = Iterator[pa.RecordBatch]


def released(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A task's function that hands memory it no longer needs back when it ends.

    Python workers live on between tasks and stages; what their allocators keep would add up beside the JVM.
    """

    @wraps(run)
    def task(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
            if trim:
                trim(0)

    return task


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (one more than rows); null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(at: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold at most ``limit`` bytes, one row at least."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n. Only tables of a slice's size are kept."""
    if len(_powers[0]) >= n:
        return _powers[0][:n], _powers[1][:n]
    tables = []
    for b in (_BASE, pow(_BASE, -1, 2**64)):
        run = np.full(max(n, SLICE + 1024), b, _U)
        run[0] = 1
        tables.append(np.multiply.accumulate(run))
    if n <= 4 * SLICE:
        _powers[:] = tables
    return tables[0][:n], tables[1][:n]


def prefix_hashes(buf: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] standing for bytes i..j, up to a factor base^i (see ``range_hashes``)."""
    out = np.zeros(len(buf) + 1, _U)
    up, _ = powers(len(buf))
    np.cumsum((buf.astype(_U) + _U(1)) * up, out=out[1:])
    return out


def range_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges from their prefix hashes.

    For short ranges that are looked at again byte by byte, or whose meeting costs nothing: polynomials modulo a power
    of two give one hash to some long strings that differ.
    """
    _, down = powers(len(h))
    return mix((h[end] - h[start]) * down[start])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit words (a bijection)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_HEADS = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], _U)


def hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges: eight bytes at a time are stirred into a state that begins with the length."""
    buf = np.ascontiguousarray(np.append(buf, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
    out = np.empty(len(start), _U)
    for a in range(0, len(start), _AT_ONCE):
        at = start[a : a + _AT_ONCE]
        left = end[a : a + _AT_ONCE] - at
        state = mix(left.astype(_U) + _U(_BASE))
        for k in np.flatnonzero(left > _LONG):
            state[k] = int.from_bytes(blake2b(buf[at[k] : at[k] + left[k]].tobytes(), digest_size=8).digest(), "little")
        todo = np.flatnonzero((left > 0) & (left <= _LONG))
        done = 0
        while len(todo):
            rest = left[todo] - done
            state[todo] = mix((state[todo] * _U(_BASE)) ^ (eight[at[todo] + done] & _HEADS[np.minimum(rest, 8)]))
            done += 8
            todo = todo[rest > 8]
        out[a : a + len(at)] = state
    return out


def words(buf: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends, and per row the index of its first word (one more than rows).

    ``kind`` marks the bytes of a word; words never cross rows.
    """
    inside = kind[buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = at[:-1][np.diff(at) > 0]
    first[edge] = inside[edge]
    edge = at[1:][np.diff(at) > 0] - 1
    last[edge] = inside[edge]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, at)


def word_hashes(buf: np.ndarray, at: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words in order, and per row the index of its first word."""
    low = LOWER[buf]
    start, end, first = words(low, at, kind)
    return hashes(low, start, end), first


def lists(values: np.ndarray, at: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column: row i holds values[at[i]:at[i + 1]]."""
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values, kind))
