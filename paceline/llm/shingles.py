"""Sets of hashed word shingles, for the operators that compare texts."""

from __future__ import annotations

import numpy as np

from paceline.llm.common import WordHashes, grams, hash_words, mixed


def shingle_sets(rows: list[list[bytes]], size: int, known: WordHashes, short_whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row, sorted, one row after another, and their number in each row.

    short_whole: a row of fewer words than size is one shingle of all its words (of a hash of its own length); else it
    has none. A row without words has none.
    """
    lengths = np.fromiter(map(len, rows), np.int64, len(rows))
    ids = hash_words([w for row in rows for w in row], known)
    every = grams(ids, size)
    ends = np.cumsum(lengths)
    parts, counts = [], np.zeros(len(rows), np.int64)
    for i, (end, n) in enumerate(zip(ends.tolist(), lengths.tolist(), strict=True)):
        if n >= size:
            own = every[end - n : end - size + 1].copy()
            own.sort()
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
        elif n and short_whole:
            own = grams(ids[end - n : end], n)
        else:
            continue
        counts[i] = len(own)
        parts.append(own)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), counts


def fingerprints(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """One 64-bit hash of each set, whatever its order; 0 for the empty set."""
    out = np.zeros(len(counts), np.uint64)
    some = counts > 0
    if some.any():
        starts = (np.cumsum(counts) - counts)[some]
        total = np.add.reduceat(mixed(values), starts)
        out[some] = mixed(total ^ (counts[some].astype(np.uint64) << np.uint64(40))) | np.uint64(1)
    return out
