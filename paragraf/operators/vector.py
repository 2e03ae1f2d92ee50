"""Nearest chunks by cosine distance: exact, of one query or of many at once.

A distance is 1 - cosine in double precision. Vectors that are null, empty, of another length than the query, of
length 0 or with a null, NaN or infinite entry have no distance and are left out. Ties go to the least key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LIMIT, TILE, BROADCAST_BYTES, SAMPLE_ROWS = 10, 1024, 64 << 20, 20_000


def checked(vector: Sequence[float]) -> list[float]:
    if not len(vector):
        raise ValueError("a vector must not be empty")
    if not all(math.isfinite(x) for x in vector):
        raise ValueError("a vector must be finite")
    return [float(x) for x in vector]


def vector_literal(vector: Sequence[float]) -> str:
    """[a,b,...]: the shortest decimals of single precision, without exponents."""
    return "[" + ",".join(np.format_float_positional(np.float32(x), trim="-") for x in checked(vector)) + "]"


def usable(v: Column, dims: int | None = None) -> Column:
    """Whether the array has a direction, and that many entries."""
    good = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    return good if dims is None else good & (F.size(v) == dims)


def cosine_distance(v: Column, query: Sequence[float]) -> Column:
    """v: ARRAY<DOUBLE> as long as the query."""
    q = checked(query)
    dot = F.aggregate(F.zip_with(v, F.lit(q), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    return 1 - dot / (norm * math.sqrt(sum(x * x for x in q)))


def similar(rows: DataFrame, query: Sequence[float], limit: int = LIMIT, keys: Sequence[str] = ("document_id", "section_index", "chunk_index"), vector: str = "embedding") -> DataFrame:
    """The columns of rows but the vector, and distance: the nearest rows first. A limit of 0 or less is LIMIT.

    Sort and limit become one top-k: each task sends its best rows only.
    """
    v = F.col(vector).cast("array<double>")
    near = rows.where(usable(v, len(query))).withColumn("distance", cosine_distance(v, query)).drop(vector)
    return near.orderBy("distance", *keys).limit(limit if limit > 0 else LIMIT)


def _packed(size: int):
    """(id, v) in blocks of at most size rows, as bytes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, size):
                part = batch.slice(k, size)
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy().astype(np.int64).tobytes()], pa.binary()), pa.array([x.tobytes()], pa.binary())], names=["ids", "v"])

    return each


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


class _Best:
    """Of a block of queries the nearest rows so far, and some more, which may tie."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, limit: int) -> None:
        self.ids, self.x, self.more = ids, x, limit + 16
        self.far, self.named = np.full((len(ids), 0), np.inf), np.zeros((len(ids), 0), np.int64)

    def meet(self, ids: np.ndarray, y: np.ndarray) -> None:
        far = 1 - self.x @ y.T
        far[self.ids[:, None] == ids] = np.inf
        far, named = np.concatenate([self.far, far], 1), np.concatenate([self.named, np.broadcast_to(ids, far.shape)], 1)
        if far.shape[1] > self.more:
            at = np.argpartition(far, self.more - 1, axis=1)[:, : self.more]
            far, named = np.take_along_axis(far, at, 1), np.take_along_axis(named, at, 1)
        self.far, self.named = far, named

    def batch(self) -> pa.RecordBatch:
        i, j = np.nonzero(np.isfinite(self.far))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[i]), pa.array(self.named[i, j]), pa.array(self.far[i, j])], names=["query_id", "id", "distance"])


def _nearest_to(sent: Broadcast, limit: int, tile: int):
    """Of rows (id, v), as they come, the nearest to each of the queries that were broadcast (ids, vectors of length 1)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, x = sent.value
        best = [_Best(q[k : k + tile], x[k : k + tile], limit) for k in range(0, len(q), tile)]
        for batch in batches:
            for k in range(0, batch.num_rows, tile):
                part = batch.slice(k, tile)
                ids = part.column(0).to_numpy()
                y = _unit(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1))
                for b in best:
                    b.meet(ids, y)
        yield from (b.batch() for b in best)

    return each


def _nearest(limit: int):
    """The same of blocks of queries (b, q_ids, q_v) and of rows (ids, v) that were shuffled to meet, read where they lie."""

    def matrix(raw: pa.Scalar, n: int) -> np.ndarray:
        return _unit(np.frombuffer(raw.as_buffer(), np.float64).reshape(n, -1))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, _Best] = {}
        for batch in batches:
            names, q_ids, q_v, row_ids, v = batch.columns
            for r, b in enumerate(names.to_pylist()):
                if b not in best:
                    q = np.frombuffer(q_ids[r].as_py(), np.int64)
                    best[b] = _Best(q, matrix(q_v[r], len(q)), limit)
                ids = np.frombuffer(row_ids[r].as_buffer(), np.int64)
                best[b].meet(ids, matrix(v[r], len(ids)))
        yield from (b.batch() for b in best.values())

    return each


def _good(rows: DataFrame, key: str, vector: str) -> DataFrame:
    v = F.col(vector).cast("array<double>")
    return rows.select(F.col(key).cast("bigint").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))


def similar_to_all(rows: DataFrame, limit: int = LIMIT, key: str = "vec_id", vector: str = "embedding", tile: int = TILE, queries: DataFrame | None = None) -> DataFrame:
    """query_id, rank (from 1), id, distance: of every query (a row of queries, else of rows) the nearest rows. Rows of equal keys aren't each other's.

    Each task sends on its best only. Queries up to BROADCAST_BYTES of them are broadcast once, and rows are compared as they
    are read, without a copy for each block of queries; beyond that blocks of both are shuffled to meet. Keys are whole numbers; vectors meet those
    of their own length, one length after the other.
    """
    found, good, asked = None, _good(rows, key, vector), _good(rows if queries is None else queries, key, vector)
    context = rows.sparkSession.sparkContext
    for n, count in sorted((r["n"], r["count"]) for r in asked.groupBy(F.size("v").alias("n")).count().collect()):
        if count * (n + 1) * 8 <= BROADCAST_BYTES:
            held = asked.where(F.size("v") == n).toArrow().combine_chunks()
            x = _unit(np.asarray(held.column(1).combine_chunks().flatten(), np.float64).reshape(-1, n))
            sent = context.broadcast((held.column(0).to_numpy(), x))
            near = good.where(F.size("v") == n).mapInArrow(_nearest_to(sent, limit, tile), "query_id BIGINT, id BIGINT, distance DOUBLE")
            found = near if found is None else found.unionByName(near)
            continue
        blocks = max(1, -(-count // tile))
        q = asked.where(F.size("v") == n).repartition(blocks, F.xxhash64("id")).mapInArrow(_packed(tile), "ids BINARY, v BINARY")
        # A block's number is its digest, taken modulo the numbers that rows are sent to.
        q = q.select(F.pmod(F.xxhash64("ids"), F.lit(blocks)).cast("int").alias("part"), F.xxhash64("ids").alias("b"), F.col("ids").alias("q_ids"), F.col("v").alias("q_v"))
        own = good.where(F.size("v") == n).mapInArrow(_packed(tile), "ids BINARY, v BINARY").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        pairs = own.join(q, "part").select("b", "q_ids", "q_v", "ids", "v")
        near = pairs.mapInArrow(_nearest(limit), "query_id BIGINT, id BIGINT, distance DOUBLE")
        found = near if found is None else found.unionByName(near)
    if found is None:
        return rows.sparkSession.createDataFrame([], "query_id BIGINT, rank INT, id BIGINT, distance DOUBLE")
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("query_id", "rank", "id", "distance")


# Cells: an index for approximate search


@dataclass(frozen=True)
class Cells:
    """Centres (rows of length 1): a row belongs to the cell of its nearest centre."""

    centres: np.ndarray

    def nearest(self, query: Sequence[float], probes: int) -> list[int]:
        return [int(k) for k in np.argsort(-(self.centres @ np.asarray(checked(query))), kind="stable")[:probes]]

    def indexed(self, rows: DataFrame, vector: str = "embedding") -> DataFrame:
        """rows with cell, null where a vector has no direction or another length. Written with partitionBy("cell"), searches read their cells only."""
        centres = self.centres

        @F.pandas_udf("int")
        def cell(v: pd.Series) -> pd.Series:
            x = np.stack(v.to_numpy()) if len(v) else np.zeros((0, centres.shape[1]))
            return pd.Series((x @ centres.T).argmax(1).astype(np.int32))

        v, blank = F.col(vector).cast("array<double>"), F.array(*[F.lit(0.0)] * centres.shape[1])
        good = usable(v, centres.shape[1])
        return rows.withColumn("cell", F.when(good, cell(F.when(good, v).otherwise(blank))))


def fit_cells(rows: DataFrame, cells: int, sample_rows: int = SAMPLE_ROWS, key: str = "vec_id", vector: str = "embedding", rounds: int = 12, seed: int = 5) -> Cells:
    """k-means by cosine on at most sample_rows rows of the most frequent length, those of least hashed key."""
    good = _good(rows, key, vector)
    sizes = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if not sizes:
        raise ValueError("no vectors to fit cells on")
    sample = good.where(F.size("v") == sizes["n"]).orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(sample_rows).collect()
    x = np.array([r["v"] for r in sample])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    centres = x[: max(1, cells)].copy()
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        length = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
    return Cells(centres)


def similar_in_cells(indexed: DataFrame, query: Sequence[float], cells: Cells, probes: int, limit: int = LIMIT, keys: Sequence[str] = ("document_id", "section_index", "chunk_index"), vector: str = "embedding") -> DataFrame:
    """As similar(), over the rows of the nearest cells only. With as many probes as cells it is exact."""
    return similar(indexed.where(F.col("cell").isin(cells.nearest(query, probes))), query, limit, keys, vector).drop("cell")


def probes_for(indexed: DataFrame, cells: Cells, recall: float = 0.9, queries: int = 64, limit: int = LIMIT, key: str = "vec_id", vector: str = "embedding") -> int:
    """The least number of cells that holds that share of the limit nearest rows, measured by exact search of at most queries rows against all."""
    asked = indexed.where("cell IS NOT NULL").orderBy(F.xxhash64(F.col(key)), key).limit(queries).select(key, vector).collect()
    if not asked:
        return 1
    vectors = {r[0]: r[1] for r in asked}
    sample = indexed.where(F.col(key).isin(list(vectors)))
    near = similar_to_all(indexed, limit, key, vector, queries=sample).join(indexed.where("cell IS NOT NULL").select(F.col(key).cast("bigint").alias("id"), "cell"), "id").collect()
    ranks = sorted(cells.nearest(vectors[r["query_id"]], len(cells.centres)).index(r["cell"]) + 1 for r in near)
    return ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))) - 1)] if ranks else 1
