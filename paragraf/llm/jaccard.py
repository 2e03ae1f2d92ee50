"""N-gram Jaccard join by MinHash banding, and the classes of near duplicates it makes.

1. One pass over the texts gives each document the digest of its n-gram set and one hash per band; this narrow
   table is written.
2. Documents of equal sets are copies. Only one of each set goes on, with their number, so that a passage copied a
   million times is compared once.
3. Sets are shuffled on their band hashes; those that share one are candidates. Bands and rows are chosen so that a
   pair at the threshold meets with the target probability, a more similar one more often. No pairs are made: the
   least set of a band hash is its leader, and each set goes once to each of its leaders (at most one a band).
4. What meets at a leader is verified on the full n-gram sets, all against all, in blocks of BLOCK sets: a leader of m
   sets makes (m / BLOCK)**2 units of work, each of bounded size. Two sets that meet at several leaders are counted at
   the least. A unit returns counts and spanning edges (links.py), not its pairs.

A document's links are the other documents with a Jaccard similarity of at least the threshold, copies included; a
class is what links connect, named by its least doc_id.

Null, empty and word-less texts have no n-grams and no links. A text of fewer than n words has one n-gram, all of its
words. Rows that repeat a doc_id with the same n-grams are one; with other n-grams they are documents of their own,
linked with each other only if they are similar. Null doc_ids are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, free_name, narrow, written
from .links import FOUND, components, counted, found_batch, node
from .textvec import Words, column_bytes, distinct_sorted, gram_sets, mix, slices

N, THRESHOLD, RECALL, MAX_HASHES = 3, 0.5, 0.99, 128
#: Sets of one block of a leader, about; bytes of n-grams that one task of the verification gets, about.
BLOCK, TASK_BYTES = 512, 32 << 20
#: Up to so many sets, a unit is verified pair by pair.
FEW = 6


def choose_bands(threshold: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows (fewest false candidates) whose bands meet the recall at the threshold."""
    best = None
    for rows in range(1, max_hashes + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else int(np.ceil(np.log1p(-recall) / np.log1p(-p)))
        if bands * rows <= max_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no bands of so few hashes meet that recall")
    return best


def _digests(sets: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Two numbers that tell each of the sets (of distinct n-grams, beginning at starts)."""
    return [np.add.reduceat(mix(sets ^ np.uint64(salt)), starts).view(np.int64) for salt in (0x51ED270B, 0xB5297A4D)]


def _signatures(n: int, bands: int, rows: int):
    factors = np.random.RandomState(7).randint(1, 1 << 62, bands * rows).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            data, offsets = column_bytes(batch.column(1))
            for a, b in slices(offsets):
                hashes, _, _, at = words(data[offsets[a] : offsets[b]], offsets[a : b + 1])
                sets, ends = distinct_sorted(*gram_sets(hashes, at, n))
                counts = np.diff(ends)
                full, none = np.flatnonzero(counts), counts == 0
                bits, out = np.zeros((2, b - a), np.int64), np.zeros((len(full), bands), np.uint64)
                if len(full):
                    starts = ends[:-1][full]
                    bits[:, full] = _digests(sets, starts)
                    for band in range(bands):
                        acc = np.full(len(full), band + 1, np.uint64)
                        for k in range(rows):
                            acc = mix(acc ^ np.minimum.reduceat(sets * factors[band * rows + k], starts))
                        out[:, band] = acc
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(~none * bands)]).astype(np.int32)), pa.array(out.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(x, mask=none) for x in bits), pa.array(counts.astype(np.int32)), lists], names=["doc_id", "d1", "d2", "n_grams", "bands"])

    return each


def _sets(n: int):
    """Of (doc_id, d1, d2, copies, leaders, units, text): the same with the text's n-grams for the text, where they are those of the digest."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            data, offsets = column_bytes(batch.column(6))
            for a, b in slices(offsets):
                hashes, _, _, at = words(data[offsets[a] : offsets[b]], offsets[a : b + 1])
                sets, ends = distinct_sorted(*gram_sets(hashes, at, n))
                own = np.zeros((2, b - a), np.int64)
                if len(full := np.flatnonzero(np.diff(ends))):
                    own[:, full] = _digests(sets, ends[:-1][full])
                part = batch.slice(a, b - a)
                same = (own[0] == part.column(1).to_numpy()) & (own[1] == part.column(2).to_numpy()) & (np.diff(ends) > 0)
                raw = pa.Array.from_buffers(pa.large_binary(), b - a, [None, pa.py_buffer((ends * 8).astype(np.int64)), pa.py_buffer(sets)]).cast(pa.binary())
                columns = [*(part.column(k) for k in range(6)), raw]
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(same)) for c in columns], names=["doc_id", "d1", "d2", "copies", "leaders", "units", "grams"])

    return each


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common values of two sorted arrays of distinct values."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


def common(sets: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """How many values each two of the sets (arrays of distinct values) have in common: products of 0/1 matrices of width values at a time."""
    m = len(sets)
    values, who = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(values, kind="stable")
    values, who = values[order], who[order]
    fresh = np.concatenate([[True], values[1:] != values[:-1]]) if len(values) else np.zeros(0, bool)
    group = np.cumsum(fresh) - 1
    often = np.bincount(group)[group] > 1 if len(group) else fresh
    group, who = group[often], who[often]
    column = np.cumsum(np.concatenate([[True], group[1:] != group[:-1]])) - 1 if len(group) else group
    both = np.zeros((m, m), np.float32)
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [k, k + width])
        part = np.zeros((m, width), np.float32)
        part[who[a:b], column[a:b] - k] = 1
        both += part @ part.T
    return both


def similar_in(sets: list[np.ndarray], earlier: list[np.ndarray], side: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i < j: places of sets with a Jaccard similarity of at least threshold, of unlike sides if there are any, that have none of their earlier leaders in common."""
    m, size = len(sets), np.array([len(s) for s in sets])
    if m <= FEW:
        found = []
        for i in range(m):
            for j in range(i + 1, m):
                if min(size[i], size[j]) >= threshold * max(size[i], size[j]) and (side is None or side[i] != side[j]):
                    both = overlap(sets[i], sets[j])
                    if both >= threshold * (size[i] + size[j] - both) and not overlap(earlier[i], earlier[j]):
                        found.append((i, j))
        return tuple(np.array(found, np.int64).reshape(-1, 2).T)
    both = common(sets).astype(np.float64)
    ok = both >= threshold * (size[:, None] + size - both)
    if side is not None:
        ok &= side[:, None] != side
    if any(map(len, earlier)):
        ok &= common(earlier) == 0
    return np.nonzero(np.triu(ok, 1))


def _verify(threshold: float):
    """Of rows (leader, i, j, block, doc_id, d1, d2, copies, leaders, grams), those of a unit (leader, i, j) together: FOUND."""

    def unit(rows: list[tuple], leader: int, split: bool) -> pa.RecordBatch:
        rows = list({r[1:4]: r for r in rows}.values())  # rows that repeat a document
        sets = [np.frombuffer(r[6], np.uint64) for r in rows]
        earlier = [r[5][r[5] < leader] for r in rows]
        i, j = similar_in(sets, earlier, np.array([r[0] for r in rows]) if split else None, threshold)
        copies = np.array([r[4] for r in rows])
        counts = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
        return found_batch(np.array([r[1:4] for r in rows], np.int64).reshape(-1, 3), counts, i, j)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ready, size = None, [], [], 0
        for batch in batches:
            heads = list(zip(*(batch.column(k).to_pylist() for k in range(3))))
            numbers = list(zip(*(batch.column(k).to_pylist() for k in range(3, 8))))
            leaders, ends = batch.column(8).flatten().to_numpy(), np.concatenate([[0], np.cumsum(batch.column(8).value_lengths().to_numpy())])
            for r, (head, own) in enumerate(zip(heads, numbers)):
                if head != key:
                    if len(held) > 1:
                        ready.append(unit(held, key[0], key[1] != key[2]))
                        size += ready[-1].num_rows
                        if size > 50_000:
                            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()
                            ready, size = [], 0
                    key, held = head, []
                held.append((*own, np.sort(leaders[ends[r] : ends[r + 1]]), batch.column(9)[r].as_py()))
        if len(held) > 1:
            ready.append(unit(held, key[0], key[1] != key[2]))
        if ready:
            yield from pa.Table.from_batches(ready).combine_chunks().to_batches()

    return each


def signatures(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, set digest (d1, d2; null without n-grams), n_grams and the band hashes of all documents."""
    bands, rows = choose_bands(threshold, recall, MAX_HASHES)
    lower = documents(docs).withColumn("text", F.lower("text"))
    return lower.mapInArrow(_signatures(n, bands, rows), "doc_id BIGINT, d1 BIGINT, d2 BIGINT, n_grams INT, bands ARRAY<BIGINT>")


def linked(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, counts, edges): members are the distinct (doc_id, d1, d2) with node and copies of their set; counts and edges are of nodes."""
    spark = docs.sparkSession
    sigs = written(signatures(docs, n, threshold, recall), "signatures")
    ids = sigs.select("doc_id", "d1", "d2", "n_grams").distinct()
    known = ids.where("d1 IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("n_grams").alias("n_grams"))
    sets = written(known.select(node("id", "d1", "d2").alias("node"), "copies", "n_grams"), "sets")
    bands = sigs.where("d1 IS NOT NULL").groupBy("d1", "d2").agg(F.first("bands").alias("bands"))
    rows = bands.select("d1", F.explode("bands").alias("hash"))
    buckets = rows.groupBy("hash").agg(F.min("d1").alias("leader"), F.count("*").alias("many")).where("many > 1").drop("many")
    meets = written(rows.join(buckets, "hash").select("d1", "leader").distinct(), "leaders")
    parts = meets.groupBy("leader").agg(F.count("*").alias("m")).where("m > 1").select("leader", F.ceil(F.col("m") / block).cast("int").alias("parts"))
    place = F.pmod(F.xxhash64("d1"), F.col("parts")).cast("int")
    units = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda k: F.struct("leader", F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j"), "block"))
    work = meets.join(parts, "leader").withColumn("block", place).select("d1", "leader", units.alias("units"))
    work = work.groupBy("d1").agg(F.collect_set("leader").alias("leaders"), F.flatten(F.collect_list("units")).alias("units"))
    needed = sets.select("node.*", "copies", "n_grams").join(work, F.col("x") == F.col("d1")).select(F.col("id").alias("doc_id"), F.col("x").alias("d1"), F.col("y").alias("d2"), "copies", "leaders", "units", "n_grams")
    needed = written(needed, "needed")
    texts = documents(docs).withColumn("text", F.lower("text")).join(narrow(needed.drop("n_grams"), 3 + F.size("leaders") + 2 * F.size("units")), "doc_id").select("doc_id", "d1", "d2", "copies", "leaders", "units", "text")
    kinds = "doc_id BIGINT, d1 BIGINT, d2 BIGINT, copies BIGINT, leaders ARRAY<BIGINT>, units ARRAY<STRUCT<leader: BIGINT, i: INT, j: INT, block: INT>>, grams BINARY"
    each = texts.mapInArrow(_sets(n), kinds).select(F.explode("units").alias("u"), "doc_id", "d1", "d2", "copies", "leaders", "grams")
    # The bytes that will be shuffled, known beforehand: tasks of a size whatever the table's.
    size = needed.agg(F.sum(F.size("units") * (8 * F.col("n_grams") + 64))).first()[0] or 0
    tasks = max(2 * spark.sparkContext.defaultParallelism, int(size) // TASK_BYTES)
    order = ["leader", "i", "j"]
    flat = each.select("u.leader", "u.i", "u.j", "u.block", "doc_id", "d1", "d2", "copies", "leaders", "grams").repartition(tasks, *order).sortWithinPartitions(*order)
    found = written(flat.mapInArrow(_verify(threshold), FOUND), "found")
    counts, edges = counted(found)
    members = ids.drop("n_grams").join(sets.select(F.col("node.x").alias("d1"), F.col("node.y").alias("d2"), "node", "copies"), ["d1", "d2"], "left")
    return members, counts, edges


def jaccard_join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, class_id, n_links: one row for each document, its class (named by its least doc_id) and how many documents it is linked with."""
    members, counts, edges = linked(docs, n, threshold, recall)
    told = members.join(counts, "node", "left").join(components(edges), "node", "left")
    own = F.coalesce(F.col("copies") - 1 + F.coalesce("n_links", F.lit(0)), F.lit(0))
    return told.select("doc_id", F.coalesce("root.id", "node.id", "doc_id").alias("class_id"), own.cast("bigint").alias("n_links"))


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of docs but for those of classes of near duplicates that aren't of the class's least doc_id.

    All columns stay. Rows without a doc_id or without n-grams stay. Of rows that repeat a doc_id with the same n-grams
    one stays, that of least text; such with other n-grams are judged each.
    """
    members, _, edges = linked(docs, n, threshold, recall)
    x, y, z, one = (free_name(docs, c) for c in ("_gone", "_d1", "_d2", "_row"))
    root = F.coalesce("root", "node")
    gone = members.join(components(edges), "node", "left").where(root.isNotNull() & (node("doc_id", "d1", "d2") != root))
    gone = written(gone.select(F.col("doc_id").alias(x), F.col("d1").alias(y), F.col("d2").alias(z)), "gone")
    doc_id = F.col("doc_id").cast("bigint")
    again = written(docs.where("doc_id IS NOT NULL").groupBy(doc_id.alias(x)).count().where("count > 1").select(x), "again")
    if again.isEmpty():
        return docs.join(narrow(gone.select(x)), doc_id == F.col(x), "left_anti")
    once = docs.join(narrow(again), doc_id == F.col(x), "left_anti").join(narrow(gone.select(x).distinct()), doc_id == F.col(x), "left_anti")

    @F.pandas_udf("a BIGINT, b BIGINT")
    def digest(texts: pd.Series) -> pd.DataFrame:
        words, (data, offsets) = Words(), column_bytes(pa.array(texts, pa.large_string()))
        out = np.zeros((len(texts), 2), np.int64)
        for lo, hi in slices(offsets):
            hashes, _, _, at = words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1])
            sets, ends = distinct_sorted(*gram_sets(hashes, at, n))
            if len(full := np.flatnonzero(np.diff(ends))):
                out[lo + full] = np.stack(_digests(sets, ends[:-1][full]), 1)
        return pd.DataFrame(out, columns=["a", "b"])

    twice = docs.join(narrow(again), doc_id == F.col(x), "left_semi").withColumn(one, digest(F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    # A text without n-grams has the digest 0, 0 and is no copy.
    none = (F.col(f"{one}.a") == 0) & (F.col(f"{one}.b") == 0)
    bare = twice.where(none).select(*docs.columns)
    twice = twice.where(~none).join(gone, (doc_id == F.col(x)) & (F.col(f"{one}.a") == F.col(y)) & (F.col(f"{one}.b") == F.col(z)), "left_anti")
    ordered = [F.col(c) for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()]
    least = twice.groupBy("doc_id", one).agg(F.min_by(F.struct(*docs.columns), F.struct(F.col("text"), *ordered)).alias(x))
    return once.unionByName(bare).unionByName(least.select(f"{x}.*"))
