"""Static 3-wise binary fuse filters over 64-bit keys, built with array operations.

The table is cut into segments; a key's three cells lie in three neighbouring segments. Keys
are peeled from cells that only one key uses, all such cells at once, and fingerprints are
assigned in the opposite order. No key of the set is ever missed; other keys pass at about
one in 256.
"""

from __future__ import annotations

import math
import struct

import numpy as np

from logtide.llm.words import mix

_U = np.uint64
_HEAD = struct.Struct("<QIII")
_GOLDEN = 0x9E3779B97F4A7C15


def _shape(n: int) -> tuple[int, int]:
    """(segment length, number of segments a first cell may lie in) for n keys."""
    length = 1 << max(2, math.floor(math.log(max(n, 2)) / math.log(3.33) + 2.25))
    factor = max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 3)))
    return length, max(1, math.ceil(n * factor / length) - 1)


def _cells(keys: np.ndarray, seed: int, length: int, spread: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys + _U(seed * _GOLDEN & 0xFFFFFFFFFFFFFFFF))
    first = ((h >> _U(32)) * _U(spread * length)) >> _U(32)
    low = _U(length - 1)
    cells = np.stack([first, (first + _U(length)) ^ ((h >> _U(18)) & low), (first + _U(2 * length)) ^ (h & low)]).astype(np.int64)
    return cells, ((h ^ (h >> _U(32))) & _U(255)).astype(np.uint8)


def build(keys: np.ndarray) -> bytes:
    """The filter of a set of 64-bit keys; repeated keys count once."""
    keys = np.unique(keys.astype(_U))
    n = len(keys)
    length, spread = _shape(n)
    for seed in range(1, 1000):
        cells, prints = _cells(keys, seed, length, spread)
        size = (spread + 2) * length
        used = np.bincount(cells.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        np.bitwise_xor.at(owner, cells.ravel(), np.tile(np.arange(n), 3))
        peeled, single = [], np.flatnonzero(used == 1)
        while len(single):
            key, at = np.unique(owner[single], return_index=True)
            peeled.append((key, single[at]))
            gone = cells[:, key].ravel()
            np.subtract.at(used, gone, 1)
            np.bitwise_xor.at(owner, gone, np.tile(key, 3))
            gone = np.unique(gone)
            single = gone[used[gone] == 1]
        if sum(len(key) for key, _ in peeled) == n:
            break
        if seed % 8 == 0:
            spread += max(1, spread // 8)
    else:
        raise RuntimeError("no seed peels this set")
    table = np.zeros(size, np.uint8)
    for key, cell in reversed(peeled):
        a, b, c = cells[:, key]
        table[cell] = prints[key] ^ table[a] ^ table[b] ^ table[c]
    return _HEAD.pack(n, seed, length, spread) + table.tobytes()


def contains(filter_bytes: bytes, keys: np.ndarray) -> np.ndarray:
    n, seed, length, spread = _HEAD.unpack_from(filter_bytes)
    if not n:
        return np.zeros(len(keys), bool)
    table = np.frombuffer(filter_bytes, np.uint8, offset=_HEAD.size)
    (a, b, c), prints = _cells(keys.astype(_U), seed, length, spread)
    return (table[a] ^ table[b] ^ table[c]) == prints
