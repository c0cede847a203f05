"""A minimal perfect hash over 128-bit keys with numpy (after BBHash, Limasset et al., 2017)."""

from __future__ import annotations

import numpy as np

from ripple.llm.common import mix

GAMMA = 2.0


def _slots(lo: np.ndarray, hi: np.ndarray, level: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(lo, 2 * level + 1) + mix(hi, 2 * level + 2)) % np.uint64(bits)


def build(lo: np.ndarray, hi: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(bits of each level, all levels' bits in bytes) for distinct keys.

    On each level the keys that land alone are placed there; the others go on
    to the next.  A key's number is the count of set bits before its own.
    """
    sizes, levels = [], []
    while len(lo):
        bits = (int(GAMMA * len(lo)) // 64 + 1) * 64
        at = _slots(lo, hi, len(sizes), bits)
        once = np.bincount(at.astype(np.int64), minlength=bits) == 1
        sizes.append(bits)
        levels.append(np.packbits(once, bitorder="little"))
        left = ~once[at.astype(np.int64)]
        lo, hi = lo[left], hi[left]
    return sizes, np.concatenate(levels) if levels else np.empty(0, np.uint8)


def lookup(sizes: list[int], levels: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Each key's number; for keys that were not in ``build`` any number, or -1."""
    words = levels.view(np.uint64)
    before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])
    out, left, base = np.full(len(lo), -1, dtype=np.int64), np.arange(len(lo)), 0
    for level, bits in enumerate(sizes):
        at = _slots(lo[left], hi[left], level, bits)
        word, bit = base + (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        value = words[word]
        here = (value >> bit) & np.uint64(1) == 1
        below = value & ((np.uint64(1) << bit) - np.uint64(1))
        out[left[here]] = (before[word] + np.bitwise_count(below))[here]
        left, base = left[~here], base + bits // 64
    return out
