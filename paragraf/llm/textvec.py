"""Words, word hashes and word n-grams of whole Arrow string columns, in numpy over the column's bytes.

A word is a longest run of ASCII letters, digits and bytes beyond ASCII; everything else separates. Texts come
lower-cased. A batch is cut into slices of whole documents of about SLICE bytes, so memory follows the longest
document and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE, ROWS = 1 << 20, 8192
_P = 0x9E3779B97F4A7C15
_Q = pow(_P, -1, 1 << 64)
_CODES = np.random.RandomState(20_011).randint(0, 1 << 32, (2, 256)).astype(np.uint64)
_CODES = (_CODES[0] << np.uint64(32)) | _CODES[1]
_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
_MULTIPLIERS = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is the empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if offsets and len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(offsets: np.ndarray, size: int = SLICE, rows: int = ROWS) -> Iterator[tuple[int, int]]:
    """Ranges of at most that many rows of about size bytes in all; a row beyond that is one by itself."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = min(n, at + rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1))
        yield at, to
        at = to


class Words:
    """Hashes words; keeps the powers of its base between calls."""

    def __init__(self) -> None:
        self.down = self.up = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.down) < n:
            for name, base in (("down", _Q), ("up", _P)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first byte and end of every word, and the offsets of the rows among the words."""
        n, base = len(data), int(offsets[0])
        inner = offsets - base
        if not n:
            zero = np.zeros(0, np.int64)
            return np.zeros(0, np.uint64), zero, zero, np.zeros(len(offsets), np.int64)
        word = _WORD[data]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        last[:-1] &= ~word[1:]
        edges = inner[(inner > 0) & (inner < n)]
        first[edges] = word[edges]
        last[edges - 1] = word[edges - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self._powers(n)
        each = _CODES[data] * self.down[:n]
        run = np.cumsum(each)
        hashes = mix((run[ends - 1] - run[starts] + each[starts]) * self.up[starts])
        return hashes, starts + base, ends + base, np.searchsorted(starts, inner)


def grams(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each word on, 0 where its row ends before; and for each word whether it begins one."""
    total = len(hashes)
    out, ok = np.zeros(total, np.uint64), np.zeros(total, bool)
    if total >= n:
        acc = np.zeros(total - n + 1, np.uint64)
        for k in range(n):
            acc = (acc ^ hashes[k : total - n + 1 + k]) * _MULTIPLIERS[k % 5] + np.uint64(k + 1)
        out[: total - n + 1] = mix(acc)
        ok[: total - n + 1] = True
        for k in range(1, n):
            at = rows[1:-1] - k
            ok[at[(at >= 0)]] = False
        # rows shorter than n - 1 words: what is cut above may reach into rows before, which end there as well
        out[~ok] = 0
    return out, ok


def gram_sets(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of every row, one after another, and the rows' offsets. A row of fewer words has one, of all of them."""
    out, ok = grams(hashes, rows, n)
    counts = np.diff(rows)
    short = np.flatnonzero((counts > 0) & (counts < n))
    for r in short:
        a, b = rows[r], rows[r + 1]
        one, _ = grams(hashes[a:b], np.array([0, b - a]), int(b - a))
        out[a], ok[a] = one[0] ^ np.uint64(b - a), True
    at = np.flatnonzero(ok)
    return out[at], np.searchsorted(at, rows)


def distinct_sorted(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct values in order, and the rows' offsets."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[keep], row[keep]
    return values, np.searchsorted(row, np.arange(len(rows)))


def text_words(text: str, words: Words) -> np.ndarray:
    """Word hashes of one text, lower-cased here."""
    data = np.frombuffer(text.lower().encode(), np.uint8)
    return words(data, np.array([0, len(data)]))[0]
