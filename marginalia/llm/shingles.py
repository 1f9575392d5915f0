"""Word shingles of whole texts as 64-bit hashes, computed on blocks of words with numpy.

Words are runs of bytes other than 0x20 and 0x09-0x0D after lower-casing A-Z. A
text of at least ``width`` words gives its distinct runs of ``width`` words, a
shorter one its whole sequence of words, a text without words nothing.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 16  # words hashed at a time
WIDTH = 5


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """One 64-bit hash per word: a random linear form of its bytes, mixed."""
    out = np.empty(len(words), np.uint64)
    for at in range(0, len(words), BLOCK):
        block = words[at : at + BLOCK]
        buffer = np.frombuffer(b" ".join(block) + b" ", np.uint8)
        ends = np.flatnonzero(buffer == 32)
        starts = np.empty_like(ends)
        starts[0], starts[1:] = 0, ends[:-1] + 1
        inside = np.arange(len(buffer)) - np.repeat(starts, ends - starts + 1)
        weights = mix(np.arange(1, int(inside.max()) + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(buffer.astype(np.uint64) * weights[inside], starts)
        out[at : at + len(block)] = mix(sums)
    return out


def shingle_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    split = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    hashed = word_hashes([w for words in split for w in words]) if any(split) else np.empty(0, np.uint64)
    factors = mix(np.arange(101, 101 + width, dtype=np.uint64)) | np.uint64(1)
    out, at = [], 0
    for words in split:
        own = hashed[at : at + len(words)]
        at += len(words)
        take = min(width, len(own))
        if not take:
            out.append(own)
            continue
        count = len(own) - take + 1
        with np.errstate(over="ignore"):
            sums = np.full(count, np.uint64(take), np.uint64)
            for j in range(take):
                sums += own[j : j + count] * factors[j]
        out.append(np.unique(mix(sums)))
    return out


def linked(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Exact test ``100 * intersection >= percent * union`` of two sorted sets."""
    small, large = (one, two) if len(one) <= len(two) else (two, one)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common = int(np.count_nonzero(large[at] == small))
    return 100 * common >= percent * (len(one) + len(two) - common)
