"""Words of whole Arrow batches as 64-bit hashes, without a Python loop over words.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``. Hashes are polynomials over a table of
fixed pseudo-random byte values, finished with a 64-bit mixer; equal words have equal hashes
in every process. All arithmetic wraps modulo 2**64.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken in runs of about this many bytes, so memory follows the longest text only.
CHUNK_BYTES = 256 << 10

_caches: list[Callable[[], None]] = []


def register_cache(clear: Callable[[], None]) -> None:
    """``clear`` empties a cache that a worker process keeps from task to task."""
    _caches.append(clear)


def release_memory() -> None:
    """Give back what earlier tasks of this worker hold: caches of other operators, and freed memory that wasn't returned."""
    for clear in _caches:
        clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finisher (the 64-bit mixer of splitmix)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_PLAIN = mix((np.arange(256, dtype=_U) + _U(1)) * _U(0x9E3779B97F4A7C15))
_FOLDED = _PLAIN.copy()
_FOLDED[65:91] = _PLAIN[97:123]

_BYTE_BASE, _WORD_BASE = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, _U)
    steps[:1] = 1
    return np.multiply.accumulate(steps)


_byte_powers = _powers(_BYTE_BASE, 1024)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a text column; null is taken as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return at, raw


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, offsets from 0, bytes) for runs of rows of about ``limit`` bytes."""
    at, raw = buffers(texts)
    n, lo = len(at) - 1, 0
    while lo < n:
        hi = max(lo + 1, min(n, int(np.searchsorted(at, at[lo] + limit, "right")) - 1), lo + 1)
        yield lo, hi, at[lo : hi + 1] - at[lo], raw[at[lo] : at[hi]]
        lo = hi


@dataclass
class Words:
    """Words of a run of texts: byte ranges, hashes, and each text's first word index."""

    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray  # one more than there are texts
    hashes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def split(offsets: np.ndarray, raw: np.ndarray, fold: bool = False) -> Words:
    """``fold`` takes A-Z as a-z."""
    global _byte_powers
    inside = ~SPACE[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(raw))]
    first[edge] = inside[edge]
    last[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    length = ends - starts
    if len(starts):
        longest = int(length.max())
        if longest > len(_byte_powers):
            _byte_powers = _powers(_BYTE_BASE, 2 * longest)
        before = np.cumsum(length) - length
        value = (_FOLDED if fold else _PLAIN)[raw[inside]]
        value *= _byte_powers[np.arange(len(value)) - np.repeat(before, length)]
        hashes = mix(np.add.reduceat(value, before) + length.astype(_U))
    else:
        hashes = np.zeros(0, _U)
    return Words(starts, ends, np.searchsorted(starts, offsets), hashes)


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of ``length`` values from each start, doubling the length; starts that run over the end are left out."""
    if len(hashes) < length:
        return np.zeros(0, _U)
    power = _powers(_WORD_BASE, length + 1)
    out, done, level, span, left = None, 0, hashes, 1, length
    while left:
        if left & 1:
            part = level[done:]
            out = part.copy() if out is None else out[: len(part)] + part * power[done]
            done += span
        left >>= 1
        if left:
            level = level[:-span] + level[span:] * power[span]
            span *= 2
    return mix(out[: len(hashes) - length + 1] + _U(length))


def fits(words: Words, length: int) -> np.ndarray:
    """For each start that ``windows`` returns, whether the window ends within its text."""
    n = max(0, len(words.hashes) - length + 1)
    end = np.repeat(words.first[1:], words.counts)[:n]
    return np.arange(n) + length <= end


def sliding(values: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over ``width`` values from each start (np.minimum or np.maximum), by doubling."""
    if len(values) < width:
        return values[:0]
    span = 1
    while 2 * span <= width:
        values = op(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return op(values[:-rest], values[rest:]) if rest else values


def signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(hashes).view(np.int64))
