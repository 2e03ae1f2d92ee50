"""Links between nodes as counts and spanning edges, and the classes that they make.

A node is a struct (id, x, y) of BIGINTs, ordered by them. A task that finds links between nodes doesn't return them
pair by pair: of each node it returns how many links it found (n), and as many edges as connect what the links
connect. Its result so grows with the nodes it holds and not with their pairs. Each link must be found by one task only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Edges up to which components are found on the driver (some 50 bytes each); beyond it, by rounds of joins.
LOCAL_EDGES = 400_000
FOUND = "a_id BIGINT, a_x BIGINT, a_y BIGINT, b_id BIGINT, b_x BIGINT, b_y BIGINT, n BIGINT"
NODE = "struct<id: bigint, x: bigint, y: bigint>"


def node(*columns: str) -> Column:
    """Three columns as a node."""
    return F.struct(*(F.col(c).cast("bigint").alias(name) for c, name in zip(columns, ("id", "x", "y"))))


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Of n places that i and j link, the least place that each is connected with."""
    least = np.arange(n)
    while len(i):
        low = np.minimum(least[i], least[j])
        before = least.copy()
        # the places that i and j have come to hang on are joined as well
        for k in (i, j, least[i], least[j]):
            np.minimum.at(least, k, low)
        while (least[least] != least).any():
            least = least[least]
        if (least == before).all():
            break
    return least


def found_batch(ids: np.ndarray, counts: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    """FOUND for nodes ids (places, 3) with counts of links, of which (i, j) are enough to connect what all connect."""
    order = np.lexsort((ids[:, 2], ids[:, 1], ids[:, 0]))
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    least = spanning(place[i], place[j], len(ids))
    own, hangs = ids[order], np.flatnonzero(least != np.arange(len(ids)))
    have = np.flatnonzero(counts)
    a = np.concatenate([ids[have], own[hangs]])
    b = np.concatenate([np.zeros((len(have), 3), np.int64), own[least[hangs]]])
    edge = np.arange(len(a)) < len(have)
    columns = [pa.array(a[:, k]) for k in range(3)] + [pa.array(b[:, k], mask=edge) for k in range(3)]
    return pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate([counts[have], np.zeros(len(hangs))]).astype(np.int64))], names=[c.split()[0] for c in FOUND.split(", ")])


def counted(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of a FOUND table: (node, n_links) and edges (u, v)."""
    a, b = node("a_id", "a_x", "a_y"), node("b_id", "b_x", "b_y")
    counts = found.where("b_id IS NULL").select(a.alias("node"), "n").groupBy("node").agg(F.sum("n").alias("n_links"))
    return counts, found.where("b_id IS NOT NULL").select(a.alias("u"), b.alias("v")).distinct()


def _local_components(edges: DataFrame) -> DataFrame:
    ends = edges.select("u.*", "v.*").toDF(*"abcdef").toArrow()
    flat = np.stack([c.to_numpy() for c in ends.columns], 1) if ends.num_rows else np.zeros((0, 6), np.int64)
    nodes, place = np.unique(flat.reshape(-1, 3), axis=0, return_inverse=True)
    place = place.reshape(-1, 2)
    least = spanning(place[:, 0], place[:, 1], len(nodes))
    hangs = np.flatnonzero(least != np.arange(len(nodes)))
    columns = [pa.array(x[:, k]) for x in (nodes[hangs], nodes[least[hangs]]) for k in range(3)]
    names = ["u_id", "u_x", "u_y", "v_id", "v_x", "v_y"]
    found = edges.sparkSession.createDataFrame(pa.Table.from_arrays(columns, names=names))
    return found.select(node(*names[:3]).alias("node"), node(*names[3:]).alias("root"))


def components(edges: DataFrame, local: int = LOCAL_EDGES) -> DataFrame:
    """node, root: the least node that edges (u, v) connect each of their nodes with, but for the roots themselves.

    Large star and small star by turns (Kiveris et al., 2014): a round is two aggregations by node, and rounds grow
    with the logarithm of the longest path. Each round is a written table. At most local edges, counted, are connected
    on the driver instead.
    """
    edges = written(edges, "links")
    if edges.count() <= local:
        return _local_components(edges)
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        sides = now.select("u", "v").union(now.select("v", "u"))
        least = sides.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = sides.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: u and all its smaller neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").distinct(), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
