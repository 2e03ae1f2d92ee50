"""Benchmark decontamination by SimHash windows of an item's own size.

A window is as many consecutive words as the item has (the whole text where it has fewer), at every position. Its
64-bit SimHash sums its word n-grams (n = 3, or the item's words if fewer), each with the bytes of its words as its
weight. A window at the threshold differs from its item in a share acos(2 t / (1 + t)) / pi of the bits, on average;
radius() is the Hamming distance within which RECALL of such windows lie, and more similar ones lie closer.

Fingerprints are looked up in a multi-index of BLOCKS blocks of 16 bits: two within the radius differ by at most
radius // BLOCKS bits in some block, so looking at all items that near in a block finds all of them; nothing within the
radius is lost. Each candidate is verified by the exact weighted Jaccard similarity of the n-gram multisets, at least
THRESHOLD. Windows that could not reach it (patterns.py) are not fingerprinted, and items of which a slice of texts
holds no anchor are not looked up in it. Windows are looked up so many at a time that they and the items make at
most CELLS pairs.

The items of one pass travel to the tasks; at most ITEMS_PER_PASS do, and a larger benchmark takes several passes
over the documents. Items that are null, without an item_id or without words match nothing; so do null and empty
texts. Of an item_id with several texts each is searched, and the best told; so with rows that repeat a doc_id. Ties are
won by the first window. Rows without a doc_id are in no result and stay in clean(). Other columns are left out by
contaminated() and stay in clean().
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, free_name, narrow, written
from .patterns import Lookup, anchors, pattern_words, row_grams
from .textvec import Words, column_bytes, slices

N, THRESHOLD, RECALL, ITEMS_PER_PASS, BLOCKS, CELLS = 3, 0.6, 0.99, 20_000, 4, 1 << 22
_ONES = np.array([bin(i).count("1") for i in range(1 << 16)], np.uint8)


def radius(threshold: float, recall: float = RECALL) -> int:
    """The Hamming distance within which fingerprints of that weighted Jaccard similarity lie with that probability."""
    p, upto = math.acos(2 * threshold / (1 + threshold)) / math.pi, 0.0
    for bits in range(65):
        upto += math.comb(64, bits) * p**bits * (1 - p) ** (64 - bits)
        if upto >= recall:
            return bits
    return 64


def fingerprints(bit_sums: np.ndarray) -> np.ndarray:
    """(windows, 64) weighted sums -> (windows, BLOCKS) numbers of 16 bits."""
    return np.packbits(bit_sums > 0, axis=1).view(np.uint16)


def signed_bits(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(shingles, 64): weight where the hash has the bit, -weight elsewhere."""
    bits = np.unpackbits(np.ascontiguousarray(shingles).view(np.uint8).reshape(-1, 8), axis=1)
    w = weights.astype(np.int32)[:, None]
    return bits * (2 * w) - w


class Class:
    """The items of one number of words: their fingerprints, block index and n-grams."""

    def __init__(self, size: int, n: int, radius: int) -> None:
        self.size, self.n, self.radius, self.items = size, min(n, size), radius, []

    def add(self, item: int, shingles: np.ndarray, weights: np.ndarray, threshold: float) -> None:
        known, first, count = np.unique(shingles, return_index=True, return_counts=True)
        w = weights[first]
        self.items.append((item, known, count, w, int((count * w).sum()), fingerprints(signed_bits(shingles, weights).sum(0)[None])[0], anchors(known, count * w, w, threshold)))

    def close(self) -> None:
        self.prints = np.stack([x[5] for x in self.items])
        held = [x[6] for x in self.items]
        self.lookup = Lookup(np.concatenate(held))
        # which items each of the lookup's hashes is an anchor of
        of = np.searchsorted(self.lookup.known, np.concatenate(held))
        order = np.argsort(of, kind="stable")
        self.holders, self.first = np.repeat(np.arange(len(held)), [len(h) for h in held])[order], np.searchsorted(of[order], np.arange(len(self.lookup.known) + 1))

    def anchored(self, hashes: np.ndarray) -> np.ndarray:
        """The items that have one of these anchors."""
        at = np.unique(np.searchsorted(self.lookup.known, hashes))
        return np.unique(np.concatenate([self.holders[self.first[k] : self.first[k + 1]] for k in at]))

    def candidates(self, prints: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) within the radius, of these items."""
        found, items, step = [], self.prints[some], max(1, CELLS // len(some))
        for k in range(0, len(prints), step):
            part = prints[k : k + step]
            apart = [_ONES[part[:, None, b] ^ items[None, :, b]] for b in range(BLOCKS)]
            w, i = np.nonzero(np.minimum.reduce(apart) <= self.radius // BLOCKS)
            close = sum(x[w, i].astype(int) for x in apart) <= self.radius
            found.append((w[close] + k, some[i[close]]))
        w, i = zip(*found)
        return np.concatenate(w), np.concatenate(i)


def index(items: list[tuple[int, str]], n: int, threshold: float, reach: int) -> list[Class]:
    words, classes = Words(), {}
    for item, text in sorted(set(items)):
        hashes, lengths = pattern_words(text, words)
        if len(hashes):
            c = classes.setdefault(len(hashes), Class(len(hashes), n, reach))
            shingles, weights = row_grams(hashes, lengths, np.array([0, len(hashes)]), c.n)
            end = len(hashes) - c.n + 1
            c.add(item, shingles[:end], weights[:end], threshold)
    for c in classes.values():
        c.close()
    return list(classes.values())


def _spans(lo: np.ndarray, hi: np.ndarray, total: int) -> np.ndarray:
    """All numbers of the ranges lo..hi, each once."""
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, lo, 1)
    np.add.at(edge, hi + 1, -1)
    return np.flatnonzero(np.cumsum(edge) > 0)


def match_class(c: Class, shingles: np.ndarray, weights: np.ndarray, rows: np.ndarray, hits: np.ndarray, threshold: float) -> dict[tuple[int, int], tuple[float, int, int]]:
    """(row, item) -> (similarity, -first word, words) of the best window."""
    row = np.searchsorted(rows, hits, "right") - 1
    begin, last = rows[row], rows[row + 1] - c.size
    lo = np.maximum(begin, hits - c.size + c.n)
    hi = np.maximum(np.minimum(hits, last), begin)
    lo = np.minimum(lo, hi)
    starts = _spans(lo, hi, len(shingles))
    ends = np.minimum(starts + c.size, rows[np.searchsorted(rows, starts, "right")]) - c.n + 1
    keep = ends > starts
    starts, ends = starts[keep], ends[keep]
    if not len(starts):
        return {}
    at = _spans(starts, ends - 1, len(shingles))
    a, b = np.searchsorted(at, starts), np.searchsorted(at, ends)
    sums = np.zeros((len(at) + 1, 64), np.int32)
    np.cumsum(signed_bits(shingles[at], weights[at]), axis=0, out=sums[1:])
    mass = np.concatenate([[0], np.cumsum(weights[at])])
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for w, i in zip(*c.candidates(fingerprints(sums[b] - sums[a]), c.anchored(shingles[hits]))):
        item, known, count, weight, total, _, _ = c.items[i]
        own = shingles[starts[w] : ends[w]]
        place = np.minimum(np.searchsorted(known, own), len(known) - 1)
        both = int((np.minimum(np.bincount(place[known[place] == own], minlength=len(known)), count) * weight).sum())
        value = both / (total + int(mass[b[w]] - mass[a[w]]) - both)
        if value >= threshold:
            r = int(np.searchsorted(rows, starts[w], "right") - 1)
            found = value, int(rows[r] - starts[w]), int(min(c.size, rows[r + 1] - starts[w]))
            best[r, item] = max(best.get((r, item), found), found)
    return best


def _match(classes: list[Class], threshold: float):
    sizes = sorted({c.n for c in classes})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        lookups = {n: Lookup(np.concatenate([c.lookup.known for c in classes if c.n == n])) for n in sizes}
        for batch in batches:
            ids, (data, offsets), out = batch.column(0), column_bytes(batch.column(1)), []
            for lo, hi in slices(offsets):
                hashes, first, end, rows = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1])
                for n in sizes:
                    shingles, weights = row_grams(hashes, end - first, rows, n)
                    hits = lookups[n](shingles)
                    for c in classes if len(hits) else ():
                        own = hits[c.lookup(shingles[hits])] if c.n == n else hits[:0]
                        if len(own):
                            out += [(ids[lo + r].as_py(), i, -s, k, v) for (r, i), (v, s, k) in match_class(c, shingles, weights, rows, own, threshold).items()]
            columns = list(zip(*out)) or [()] * 5
            kinds = pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names=["doc_id", "item_id", "first_word", "n_words", "similarity"])

    return each


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, items_per_pass: int = ITEMS_PER_PASS) -> DataFrame:
    """doc_id, item_id, first_word, n_words, similarity (6 digits): the best window of each document and item that match."""
    schema = "doc_id BIGINT, item_id BIGINT, first_word INT, n_words INT, similarity DOUBLE"
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    count, texts, passes = items.count(), documents(docs).withColumn("text", F.lower("text")), []
    parts = max(1, -(-count // items_per_pass))
    for k in range(parts):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        classes = index([tuple(r) for r in part.collect()], n, threshold, radius(threshold, recall))
        if classes:
            passes.append(texts.mapInArrow(_match(classes, threshold), schema))
    if not passes:
        return docs.sparkSession.createDataFrame([], schema)
    found = reduce(DataFrame.unionByName, passes)
    # an item_id or doc_id that repeats can be found more than once
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("first_word")).alias("f"), "n_words")).alias("m"))
    return best.select("doc_id", "item_id", (-F.col("m.f")).alias("first_word"), "m.n_words", F.round("m.similarity", 6).alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs whose doc_id isn't contaminated, with all columns. Rows without a doc_id stay."""
    name = free_name(docs, "_gone")
    gone = contaminated(docs, benchmark, **options).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(narrow(written(gone, "contaminated")), F.col("doc_id").cast("bigint") == F.col(name), "left_anti")
