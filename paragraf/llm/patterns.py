"""Where a text can match a known pattern at all: the exact prefix filter of set-similarity joins.

A window that matches a pattern holds at least a share t of the weight of the pattern's n-grams. Whichever n-grams
of more than 1 - t of that weight are chosen, it therefore holds one of them. The longest (rarest) are chosen as the
pattern's anchors; windows without an anchor are not looked at, and none of them could have matched.
"""

from __future__ import annotations

import numpy as np

from .textvec import Words, column_bytes, grams


def anchors(shingles: np.ndarray, mass: np.ndarray, rank: np.ndarray, share: float) -> np.ndarray:
    """Of distinct shingles with their mass: those of highest rank that together hold more than 1 - share of it."""
    order = np.lexsort((shingles, -rank))
    held = np.cumsum(mass[order])
    return shingles[order[: int(np.searchsorted(held, (1 - share) * held[-1] * (1 + 1e-9), "right")) + 1]]


class Lookup:
    """Which of many hashes are among the given ones; most are turned away by a table of 2**20 bits."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.known = np.unique(np.asarray(hashes, np.uint64))
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.known >> np.uint64(44)).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Places of hashes that are known."""
        at = np.flatnonzero(self.table[(hashes >> np.uint64(44)).astype(np.int64)])
        if not len(at) or not len(self.known):
            return at[:0]
        place = np.minimum(np.searchsorted(self.known, hashes[at]), len(self.known) - 1)
        return at[self.known[place] == hashes[at]]


def pattern_words(text: str, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and byte lengths of a text's words (lower-cased here)."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    hashes, starts, ends, _ = words(data, np.array([0, len(data)]))
    return hashes, ends - starts


def row_grams(hashes: np.ndarray, lengths: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n-gram hash from each word on (0 if its row ends before) and the bytes of the n-gram's words."""
    shingles, ok = grams(hashes, rows, n)
    run = np.concatenate([[0], np.cumsum(lengths)])
    weight = np.zeros(len(hashes), np.int64)
    weight[ok] = (run[n:] - run[:-n])[ok[: len(run) - n]] if len(hashes) >= n else 0
    return shingles, weight


__all__ = ["Lookup", "anchors", "column_bytes", "pattern_words", "row_grams"]
