"""Word-shingle sets of whole texts, as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from ripple.llm.common import Hashes, mix


def shingle_sets(texts: list[bytes], k: int, words: Hashes) -> list[np.ndarray]:
    """For each UTF-8 text its distinct k-word shingles, as sorted hashes.

    Words are the runs without ASCII white space, A-Z lower-cased.  A text of
    fewer than k words, but not none, has its whole word sequence as its one
    shingle; a text without words has none.
    """
    split = [x.lower().split() for x in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    hashed = words.of([w for x in split for w in x])
    ends = np.cumsum(counts)

    def rolled(values: np.ndarray, width: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            acc = mix(values[: len(values) - width + 1], width)
            for j in range(1, width):
                acc = mix(acc + values[j : len(values) - width + 1 + j], j)
        return acc

    whole = rolled(hashed, k) if len(hashed) >= k else hashed[:0]
    out = []
    for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
        if n >= k:
            out.append(np.unique(whole[end - n : end - k + 1]))
        else:
            out.append(rolled(hashed[end - n : end], n) if n else hashed[:0])
    return out


def set_key(tokens: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return xxhash.xxh3_128_digest(tokens.tobytes())
