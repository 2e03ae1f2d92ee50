"""Quotation linking: conversations in reply order, without what they quote.

A line of a message is quoted as deep as it begins with > signs. A passage is a longest run of lines of one depth. It
is normalised (lower case, white space runs as one space) and hashed, as a whole and line by line; so is what each
message says itself, as a whole and line by line. A hash of a passage links to the last earlier message of its
conversation that says the same. A message's parent is the earlier message with the most linked characters, at the
least depth that has any links (ties: the later message); a message that links to none replies to the one before it.

Conversations are put in reply order: each message, then its replies by turn, each with its own replies. The text
that remains has no quoted lines, no line that announces a quotation ("On ... wrote:") and no blank lines around it.

Messages are sorted by ranges, which a conversation may reach over, and numbered (seq) and parsed once; from then on only
numbers and hashes are joined, and texts once more at the end. Conversations of up to LOCAL messages are ordered each in
one row of numbers. Longer ones are ordered by list ranking: pointers along the tour around the reply tree double in
every round, so no task holds a conversation; and their links are looked up in stretches of a partition's STRETCH messages,
with what the stretches before say last carried over.

Messages without a conv_id or turn are left out. Null text is empty text; a null role stays. Rows that repeat a turn
are messages of their own, ordered by role and text. Other columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from .common import narrow, small_batches, written

LOCAL, STRETCH = 100_000, 1 << 20
_LINE, _QUOTED, _SPACES = re.compile("\r?\n"), re.compile(r"((?:[ \t]*>)+)[ \t]?(.*)\Z", re.S), re.compile("[ \t\r\n\f]+")
_ANNOUNCED = re.compile(r"(?i)[ \t]*(on|am|le|el)[ \t].*(wrote|schrieb|écrit|escribió)[ \t]?:[ \t]*\Z")
_ASK = "STRUCT<passage: INT, depth: INT, h: BIGINT, size: INT>"
_PARSED = f"conv_id BIGINT, seq BIGINT, turn BIGINT, role STRING, said STRING, n_quotes INT, asks ARRAY<{_ASK}>, answers ARRAY<STRUCT<h: BIGINT, size: INT>>"


def _normal(text: str) -> str:
    return _SPACES.sub(" ", text.lower()).strip(" ")


def parse(text: str) -> tuple[str, list[tuple[int, int]], set[tuple[int, int, str]], set[str]]:
    """What a message says itself, the (passage, depth) of what it quotes, the units it asks for, (passage, depth, unit), and those it answers with."""
    lines, own, passages, asks = [], [], [], set()
    for line in _LINE.split(text):
        m = _QUOTED.match(line)
        lines.append((m[1].count(">"), m[2]) if m else (0, line))
    units: list[str] = []

    def close() -> None:
        if passages and units:
            asks.update((len(passages), passages[-1][1], u) for u in [_normal(" ".join(units)), *units] if u)
        units.clear()

    last = 0
    for k, (depth, body) in enumerate(lines):
        if depth != last:
            close()
            if depth:
                passages.append((len(passages) + 1, depth))
        last = depth
        if depth:
            units.append(_normal(body))
        elif not (k + 1 < len(lines) and lines[k + 1][0] > 0 and _ANNOUNCED.match(body)):
            own.append(body)
    close()
    said = "\n".join(own).strip(" \t\r\n\f")
    return said, passages, asks, {u for u in (_normal(x) for x in [said, *said.split("\n")]) if u}


def _hash(unit: str) -> int:
    return int.from_bytes(hashlib.blake2b(unit.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ask, answer = pa.struct([("passage", pa.int32()), ("depth", pa.int32()), ("h", pa.int64()), ("size", pa.int32())]), pa.struct([("h", pa.int64()), ("size", pa.int32())])
    for batch in batches:
        rows = [parse(t) for t in batch.column(4).to_pylist()]
        asks = [[{"passage": p, "depth": d, "h": _hash(u), "size": len(u)} for p, d, u in sorted(a)] for _, _, a, _ in rows]
        answers = [[{"h": _hash(u), "size": len(u)} for u in sorted(b)] for *_, b in rows]
        columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([len(r[1]) for r in rows], pa.int32()), pa.array(asks, pa.list_(ask)), pa.array(answers, pa.list_(answer))]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), *columns], names=["conv_id", "seq", "turn", "role", "said", "n_quotes", "asks", "answers"])


@F.pandas_udf(ArrayType(StructType().add("rank", IntegerType()).add("depth", IntegerType()).add("parent", IntegerType())))
def _reply_order(messages: pd.Series, parents: pd.Series) -> pd.Series:
    """Of each conversation's messages, by seq, with the seq of each one's linked parent (-1: none): rank in reply order, depth, place of the parent."""
    out = []
    for seq, linked in zip(messages, parents):
        seq, linked = np.asarray(seq, np.int64), np.asarray(linked, np.int64)
        up = np.where(linked >= 0, np.searchsorted(seq, linked), np.arange(len(seq)) - 1).tolist()
        replies: dict[int, list[int]] = {}
        for i, p in enumerate(up):
            replies.setdefault(p, []).append(i)
        found, stack, rank = [(0, 0)] * len(up), [(i, 0) for i in reversed(replies.get(-1, []))], 0
        while stack:
            i, depth = stack.pop()
            found[i] = (rank, depth)
            rank += 1
            stack += [(j, depth + 1) for j in reversed(replies.get(i, []))]
        out.append([{"rank": r, "depth": d, "parent": p} for (r, d), p in zip(found, up)])
    return pd.Series(out)


def _sources(messages: DataFrame, stretched: bool) -> DataFrame:
    """seq, passage, depth, size, source: the last message before that says what a passage quotes."""
    keys, none = ["conv_id", "h", "size"], F.lit(None).cast("int")
    asks = messages.select("conv_id", "seq", F.explode("asks").alias("a")).select("conv_id", "a.h", "a.size", "seq", "a.passage", "a.depth", F.lit(None).cast("bigint").alias("source"))
    answers = messages.select("conv_id", "seq", F.explode("answers").alias("a")).select("conv_id", "a.h", "a.size", "seq", none.alias("passage"), none.alias("depth"), F.col("seq").alias("source"))
    both = asks.unionByName(answers)
    if stretched:
        both = both.withColumn("stretch", F.floor(F.col("seq") / STRETCH).cast("bigint"))
    by = [*keys, "stretch"] if stretched else keys
    # An as-of join, of rows that meet on conversation and hash.
    before = Window.partitionBy(*by).orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    links = both.withColumn("source", F.last("source", ignorenulls=True).over(before)).where("passage IS NOT NULL")
    if stretched:
        ends = both.where("passage IS NULL").groupBy(*by).agg(F.max("seq").alias("last"))
        stretches = both.select(*by).distinct().join(ends, by, "left")
        carried = stretches.withColumn("carried", F.last("last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)))
        links = links.join(carried.where("carried IS NOT NULL").select(*by, "carried"), by, "left").withColumn("source", F.coalesce("source", "carried"))
    return links.where("source IS NOT NULL").select("seq", "passage", "depth", "size", "source")


def _toured(nodes: DataFrame) -> DataFrame:
    """seq, rank, depth of nodes (conv_id, seq, up: the parent's seq, null at the root), by list ranking of the tours around the trees."""
    children = nodes.where("up IS NOT NULL")
    first = children.groupBy(F.col("up").alias("seq")).agg(F.min("seq").alias("child"))
    after = children.select("seq", F.lead("seq").over(Window.partitionBy("up").orderBy("seq")).alias("sibling"))
    linked = nodes.join(first, "seq", "left").join(after, "seq", "left")
    # An element of a tour is a message entered (2 seq) or left (2 seq + 1).
    enters = linked.select((F.col("seq") * 2).alias("e"), F.coalesce(F.col("child") * 2, F.col("seq") * 2 + 1).alias("next"), F.lit(1).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("d"))
    leaves = linked.select((F.col("seq") * 2 + 1).alias("e"), F.coalesce(F.col("sibling") * 2, F.col("up") * 2 + 1).alias("next"), F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("d"))
    tour = written(enters.unionByName(leaves), "tour")
    while not tour.where("next IS NOT NULL").isEmpty():
        then = tour.select(F.col("e").alias("f"), F.col("next").alias("further"), F.col("n").alias("n2"), F.col("d").alias("d2"))
        jumped = tour.join(then, F.col("next") == F.col("f"), "left")
        tour = written(jumped.select("e", F.col("further").alias("next"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d")), "tour")
    ranks = tour.where("e % 2 = 0").select((F.col("e") / 2).cast("bigint").alias("seq"), "n", "d")
    total = nodes.groupBy("conv_id").agg(F.count("*").alias("total"))
    return nodes.join(narrow(total), "conv_id").join(ranks, "seq").select("seq", (F.col("total") - F.col("n")).cast("int").alias("rank"), (-F.col("d")).cast("int").alias("depth"))


def _previous(messages: DataFrame) -> DataFrame:
    """seq, before: the first message of each partition and the one before it; all others follow on seq - 1."""
    spans = messages.groupBy(F.shiftright("seq", 33).alias("p")).agg(F.min("seq").alias("low"), F.max("seq").alias("high")).orderBy("p").collect()
    return messages.sparkSession.createDataFrame([(b["low"], a["high"]) for a, b in zip(spans, spans[1:])], "seq BIGINT, before BIGINT")


def reply_ordered(messages: DataFrame, local: int = LOCAL) -> DataFrame:
    """conv_id, reply_rank (from 0), turn, role, text (without quotes), parent_turn, depth, n_quotes, n_linked."""
    small_batches(messages.sparkSession)
    named = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = ["conv_id", "turn", "role", "text"]
    placed = named.where("conv_id IS NOT NULL AND turn IS NOT NULL").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.select("conv_id", F.monotonically_increasing_id().alias("seq"), "turn", "role", "text")
    parsed = written(placed.mapInArrow(_parsed, _PARSED), "messages")

    sizes = parsed.groupBy("conv_id").agg(F.count("*").alias("size"), F.min("seq").alias("root"))
    long = written(sizes.where(F.col("size") > local), "long")
    none_long = long.isEmpty()
    links = written(_sources(parsed, not none_long), "links")
    votes = links.groupBy("seq", "depth", "source").agg(F.sum("size").alias("chars"))
    parent = votes.groupBy("seq").agg(F.min(F.struct("depth", (-F.col("chars")).alias("c"), (-F.col("source")).alias("s"))).alias("b")).select("seq", (-F.col("b.s")).alias("linked"))
    joined = links.groupBy("seq").agg(F.count_distinct("passage").cast("int").alias("n_linked"))
    rows = parsed.select("conv_id", "seq", "turn").join(parent.join(joined, "seq"), "seq", "left")

    short = rows if none_long else rows.join(narrow(long), "conv_id", "left_anti")
    threads = short.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("linked", F.lit(-1)).alias("linked"), "turn", "n_linked"))).alias("m"))
    ordered = threads.withColumn("o", _reply_order(F.col("m.seq"), F.col("m.linked")))
    each = ordered.select(F.explode(F.transform("m", lambda x, i: F.struct(x.alias("x"), F.get("o", i).alias("o"), F.get("m", F.get("o", i)["parent"])["turn"].alias("parent_turn")))).alias("e"))
    told = each.select("e.x.seq", "e.o.rank", "e.o.depth", "e.parent_turn", "e.x.n_linked")
    if not none_long:
        nodes = rows.join(narrow(long), "conv_id").join(narrow(_previous(parsed)), "seq", "left")
        up = F.coalesce("linked", F.when(F.col("seq") != F.col("root"), F.coalesce("before", F.col("seq") - 1)))
        nodes = written(nodes.select("conv_id", "seq", "turn", "n_linked", up.alias("up")), "nodes")
        turns = nodes.select(F.col("seq").alias("up"), F.col("turn").alias("parent_turn"))
        toured = nodes.join(turns, "up", "left").select("seq", "parent_turn", "n_linked").join(_toured(nodes.select("conv_id", "seq", "up")), "seq")
        told = told.unionByName(toured.select(*told.columns))
    return parsed.join(told, "seq").select("conv_id", F.col("rank").alias("reply_rank"), "turn", "role", F.col("said").alias("text"), "parent_turn", "depth", "n_quotes", F.coalesce("n_linked", F.lit(0)).alias("n_linked"))
