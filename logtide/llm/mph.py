"""Minimal perfect hash over 64-bit keys by levels of bit arrays.

On each level the keys that remain hash into an array of twice their number; a key alone in
its place sets the bit, the others go to the next level. A key's number is the count of bits
before its own, so n keys get the numbers 0 to n - 1. A look-up probes fewer than two levels
on average. Keys outside the set may get any number or none; fingerprints tell them apart.
"""

from __future__ import annotations

import struct

import numpy as np

from logtide.llm.words import mix

_U = np.uint64
_STEP = 0xD6E8FEB86659FD93
_SPREAD = 2


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys ^ _U((level + 1) * _STEP & 0xFFFFFFFFFFFFFFFF)) % _U(size)).astype(np.int64)


class PerfectHash:
    def __init__(self, sizes: list[int], bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits  # bits: 64 to a word, levels one after another
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits))]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys`` must be distinct."""
        left, sizes, levels = keys.astype(_U), [], []
        while len(left):
            size = -(-max(64, _SPREAD * len(left)) // 64) * 64
            at = _place(left, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = left[~alone[at]]
            if len(sizes) > 200:
                raise ValueError("the keys are not distinct")
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, "<u8"))

    def numbers(self, keys: np.ndarray) -> np.ndarray:
        """A number for each key, -1 for one that no level has."""
        keys = keys.astype(_U)
        out = np.full(len(keys), -1, np.int64)
        open_, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            at = base + _place(keys[open_], level, size)
            word, bit = at >> 6, (at & 63).astype(_U)
            hit = (self.bits[word] >> bit) & _U(1) == 1
            below = np.bitwise_count(self.bits[word[hit]] & ((_U(1) << bit[hit]) - _U(1)))
            out[open_[hit]] = self.before[word[hit]] + below
            open_, base = open_[~hit], base + size
        return out

    def to_bytes(self) -> bytes:
        return struct.pack(f"<I{len(self.sizes)}Q", len(self.sizes), *self.sizes) + self.bits.astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        (n,) = struct.unpack_from("<I", raw)
        return cls(list(struct.unpack_from(f"<{n}Q", raw, 4)), np.frombuffer(raw, "<u8", offset=4 + 8 * n))
