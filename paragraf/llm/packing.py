"""Best-fit packing planned on the histogram of lengths.

A document is its white-space separated tokens and one end token. Those over CAPACITY are cut in pieces of CAPACITY and
a rest. Best-fit decreasing then packs counts of equal lengths and not pieces: the plan takes the histogram, of at
most CAPACITY numbers whatever the corpus, and gives slots to ranks of a length. Each piece takes the slot of its
rank within its length.

Tokens are counted once. The tasks that count them also number the pieces of each length as they come; the numbered
pieces are written, and what the tasks before hold is added to their numbers. Nothing is sorted or shuffled by length or
document, so neither a frequent length nor a frequent doc_id is a hot key. Which of two pieces of one length comes
first follows the order of the table.

Null and empty texts and those of white space alone have no tokens and take no slot; rows without a doc_id take none.
Rows that repeat a doc_id are packed each. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, narrow, written

CAPACITY = 2048


def plan(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, first bin, pieces a bin, offset in the bin) of best-fit decreasing, in order."""
    free: dict[int, list[tuple[int, int]]] = {}  # space left -> runs (first bin, bins)
    mask, bins, rows = 0, 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            fits = mask >> length
            space = (fits & -fits).bit_length() - 1 + length if fits else capacity
            per = space // length
            if fits:
                start, n = free[space].pop()
                if not free[space]:
                    mask ^= 1 << space
                full = min(n, left // per)
                rest = left - full * per if full < n else 0
                if full + bool(rest) < n:
                    free.setdefault(space, []).append((start + full + bool(rest), n - full - bool(rest)))
                    mask |= 1 << space
            else:
                start, full = bins, left // per
                rest = left - full * per
                bins += full + bool(rest)
            rows.append((length, rank, start, per, capacity - space))
            for k, n, put in ((start, full, per), (start + full, int(bool(rest)), rest)):
                if n and (remains := space - put * length):
                    free.setdefault(remains, []).append((k, n))
                    mask |= 1 << remains
            rank, left = rank + full * per + rest, left - full * per - rest
    return np.array(rows, np.int64).reshape(-1, 5)


def _slots(rows: np.ndarray):
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    #: length and first rank in one number each, for one as-of search
    keys = (rows[:, 0] << 48) + rows[:, 1]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4))
            _, first, start, per, offset = rows[np.searchsorted(keys, (n.astype(np.int64) << 48) + rank, "right") - 1].T
            place = rank - first
            out = [batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(start + place // per), pa.array((offset + place % per * n).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "first_token", "n_tokens", "bin_id", "bin_offset"])

    return each


def _pieces(capacity: int):
    """Of (doc_id, n): the pieces, with the task's number and the piece's own within the task and its length."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            many = (n + capacity - 1) // capacity
            of = np.repeat(np.arange(len(n)), many)
            piece = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            length = np.minimum(n[of] - piece * capacity, capacity)
            order, counts = np.argsort(length, kind="stable"), np.bincount(length, minlength=capacity + 1)
            own = np.empty(len(of), np.int64)
            own[order] = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
            own += seen[length]
            seen += counts
            numbers = [piece.astype(np.int32), piece * capacity, length.astype(np.int32), np.full(len(of), part, np.int32), own]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *map(pa.array, numbers)], names=["doc_id", "piece", "first_token", "n_tokens", "part", "own"])

    return each


def pieces(docs: DataFrame, capacity: int) -> DataFrame:
    """doc_id, piece, first_token, n_tokens, part, own."""
    total = F.regexp_count(F.col("text"), F.lit(r"[^ \t\n\r\f]+"))
    counted = documents(docs).select("doc_id", total.alias("n")).where("n > 0").select("doc_id", (F.col("n") + 1).alias("n"))
    return counted.mapInArrow(_pieces(capacity), "doc_id BIGINT, piece INT, first_token BIGINT, n_tokens INT, part INT, own BIGINT")


def pack(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, first_token, n_tokens, bin_id, bin_offset: where each piece goes."""
    cut = written(pieces(docs, capacity), "pieces")
    counts = written(cut.groupBy("n_tokens", "part").agg((F.max("own") + 1).alias("count")), "counts")
    plans = plan({n: c for n, c in counts.groupBy("n_tokens").agg(F.sum("count")).collect()}, capacity)
    schema = "doc_id BIGINT, piece INT, first_token BIGINT, n_tokens INT, bin_id BIGINT, bin_offset INT"
    if not len(plans):
        return docs.sparkSession.createDataFrame([], schema)
    before = Window.partitionBy("n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("n_tokens", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = cut.join(narrow(offsets), ["n_tokens", "part"])
    rows = ranked.select("doc_id", "piece", "first_token", "n_tokens", (F.col("before") + F.col("own")).alias("rank"))
    return rows.mapInArrow(_slots(plans), schema)
