"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes of a text; where BITS of its bits are zero a chunk ends, 2**BITS bytes apart on
average. The hash sees the last WINDOW bytes only, so an insertion changes the chunks around it and no others.
Chunks are equal if their 64-bit digests and lengths are. The first of equal chunks, by (doc_id, place), is kept; one
whose first is in another document is a copy. Runs of consecutive copies are the repeated passages, where their distinct
chunks hold MIN_BYTES or more in all, or where they are their whole document, however short. What repeats inside one
document counts once, so that a word said a hundred times is no passage, and what a document says twice itself is left.

No chunk ends inside a UTF-8 character or within WINDOW bytes of a text's beginning; there are no other bounds on its
length. Null and empty texts have no chunks. Rows without a doc_id are left out. Rows that repeat a doc_id with the same
text are one document; with other texts they are documents of their own, told by a number of the text (0 where a doc_id
is no more than once, which packs better). Other columns are left out by repeated() and stay in without_repeats().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import documents, free_name, narrow, written
from .textvec import _CODES, Words, column_bytes, mix, slices

BITS, WINDOW, MIN_BYTES = 5, 16, 128
_GEAR = np.random.RandomState(5).randint(0, 1 << 16, 256).astype(np.uint16)


def boundaries(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Ends of all chunks, the ends of texts among them; data are the bytes of texts, which begin at offsets."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):  # sums of gear << age over 2, 4, 8 and 16 bytes
        h[step:] = h[step:] + (h[:-step] << np.uint16(step))
    cut = (h >> np.uint16(16 - bits)) == 0
    cut[:-1] &= (data[1:] & 0xC0) != 0x80
    near = (offsets[:-1, None] + np.arange(WINDOW - 1)).ravel()
    cut[near[near < len(data)]] = False
    ends = offsets[1:][np.diff(offsets) > 0] - 1
    cut[ends] = True
    return np.flatnonzero(cut) + 1


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Words) -> np.ndarray:
    """64-bit digests of spans of bytes, which lie side by side."""
    powers._powers(len(data))
    each_byte = _CODES[data] * powers.down[: len(data)]
    run = np.cumsum(each_byte)
    return mix((run[ends - 1] - run[starts] + each_byte[starts]) * powers.up[starts])


def _text_numbers(data: np.ndarray, offsets: np.ndarray, powers: Words) -> np.ndarray:
    """Of each text a number below 2**31 that tells it from other texts of its doc_id."""
    out, full = np.zeros(len(offsets) - 1, np.int64), np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = (_digests(data, offsets[:-1][full], offsets[1:][full], powers) >> np.uint64(33)).astype(np.int64)
    return out


def _chunks(bits: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Words()
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for lo, hi in slices(offsets):
                part, own = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
                if not len(part):
                    continue
                ends = boundaries(part, own, bits)
                starts = np.concatenate([[0], ends[:-1]])
                digest = _digests(part, starts, ends, powers)
                row = np.searchsorted(own, starts, "right") - 1
                ids = batch.column(0).slice(lo, hi - lo).take(pa.array(row))
                numbers = _text_numbers(part, own, powers) * batch.column(2).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                place = (numbers[row] << 32) + starts - own[row]
                # the last chunk says so by a negative length
                closes = np.zeros(len(part) + 1, bool)
                closes[own[1:]] = True
                size = np.where(closes[ends], starts - ends, ends - starts)
                yield pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64)), pa.array(size.astype(np.int32)), ids, pa.array(place)], names=["digest", "size", "doc_id", "place"])

    return each


AGAIN = "_again"


def _numbered(docs: DataFrame, name: str = AGAIN) -> tuple[DataFrame, bool]:
    """docs with a column of whether their doc_id is there more than once, and whether any is."""
    doc_id = F.col("doc_id").cast("bigint")
    again = written(docs.groupBy(doc_id.alias(name)).count().where(f"count > 1 AND `{name}` IS NOT NULL").select(name), "again")
    if again.isEmpty():
        return docs.withColumn(name, F.lit(False)), False
    of = free_name(docs, name + "_of")
    return docs.join(narrow(again.withColumnRenamed(name, of)), doc_id == F.col(of), "left").withColumn(name, F.col(of).isNotNull()).drop(of), True


def chunks(docs: DataFrame, bits: int = BITS) -> tuple[DataFrame, bool]:
    """digest, n (bytes), doc_id, place (the text's number << 32 and the first byte), last (of its text) of every chunk; whether any text has a number."""
    numbered, some = _numbered(documents(docs))
    rows = numbered.select("doc_id", "text", AGAIN).mapInArrow(_chunks(bits), "digest BIGINT, size INT, doc_id BIGINT, place BIGINT")
    return rows.select("digest", F.abs("size").alias("n"), "doc_id", "place", (F.col("size") < 0).alias("last")), some


def _runs(docs: DataFrame, bits: int, min_bytes: int) -> DataFrame:
    """doc_id, text (the number of its text), start, n_bytes, n_chunks, first_docs."""
    every, some = chunks(docs, bits)
    text, start = F.shiftright("place", 32), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    # Counted with map-side combining, so a chunk of a billion copies is no hot key; the join's skew AQE splits.
    # Where no text has a number ids alone tell documents, and numbers aggregate faster than structs.
    who = F.struct("doc_id", text.alias("text")) if some else F.col("doc_id")
    first = every.groupBy("digest", "n").agg(F.min(who).alias("first"), F.max(who).alias("final")).where("first <> final").drop("final")
    copies = every.join(first, ["digest", "n"]).where(who != F.col("first")).withColumn("first_doc", F.col("first.doc_id" if some else "first"))
    copies = copies.select("doc_id", text.alias("text"), start.alias("start"), "n", "digest", "last", "first_doc")
    order = Window.partitionBy("doc_id", "text").orderBy("start")
    # rows that repeat a document have each of its places several times
    fresh = F.coalesce(F.col("start") > F.max(F.col("start") + F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    runs = copies.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kinds = runs.groupBy("doc_id", "text", "run", "digest", "n").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("end"), (F.count_distinct("start") if some else F.count("*")).alias("times"), F.max("last").alias("last"), F.min("first_doc").alias("first_doc"))
    found = kinds.groupBy("doc_id", "text", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("distinct"), F.sum("times").alias("n_chunks"), F.max("last").alias("last"), F.array_sort(F.collect_set("first_doc")).alias("first_docs"))
    whole = (F.col("start") == 0) & F.col("last")
    return found.where((F.col("distinct") >= min_bytes) | whole).select("doc_id", "text", "start", (F.col("end") - F.col("start")).alias("n_bytes"), "n_chunks", "first_docs")


def repeated(docs: DataFrame, bits: int = BITS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """doc_id, start, n_bytes, n_chunks, first_docs: runs of chunks that are copies, with the documents that keep them (sorted)."""
    return _runs(docs, bits, min_bytes).drop("text")


def without_repeats(docs: DataFrame, bits: int = BITS, min_bytes: int = MIN_BYTES) -> DataFrame:
    """docs with the repeated passages cut from text; all columns stay."""
    of, cuts, again = free_name(docs, "_of"), free_name(docs, "_spans"), free_name(docs, AGAIN)
    spans = _runs(docs, bits, min_bytes).groupBy(F.col("doc_id").alias(of)).agg(F.collect_list(F.struct("text", "start", "n_bytes")).alias(cuts))
    named, _ = _numbered(docs, again)
    joined = named.join(narrow(written(spans, "spans"), 2 + 3 * F.size(cuts)), F.col("doc_id").cast("bigint") == F.col(of), "left")

    @F.pandas_udf(StringType())
    def without(texts: pd.Series, spans: pd.Series, again: pd.Series) -> pd.Series:
        (data, offsets), out = column_bytes(pa.array(texts, pa.large_string())), []
        numbers = _text_numbers(data, offsets, Words()) * again.to_numpy()
        for t, number, cut in zip(texts, numbers, spans):
            raw, at, kept = t.encode(), 0, []
            for s in sorted((s for s in cut if s["text"] == number), key=lambda s: s["start"]):
                kept.append(raw[at : s["start"]])
                at = s["start"] + s["n_bytes"]
            out.append(b"".join([*kept, raw[at:]]).decode())
        return pd.Series(out)

    # The CASE isn't left to guard the UDF, which Spark evaluates for all rows: no spans give the text itself.
    cut = without(F.coalesce(F.col("text"), F.lit("")), F.coalesce(cuts, F.array().cast("array<struct<text: bigint, start: int, n_bytes: int>>")), F.col(again))
    return joined.withColumn("text", F.when(F.col(of).isNull(), F.col("text")).otherwise(cut)).select(*docs.columns)
