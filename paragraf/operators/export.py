"""Documents and graphs as JSON and JSON lines.

Lines are made in the JVM: nulls are kept, map keys sorted, <, > and & escaped, times in RFC 3339 in UTC (the session
must be in UTC). Null arrays and maps are null, empty ones empty. A null document is the line null.
"""

from __future__ import annotations

import json
import os
import tempfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .graph import Graph

_OPTIONS = {"ignoreNullFields": "false"}
#: Rows that one string on the driver takes at most.
MOST = 100_000
_UNBOUNDED = "0001-01-01T00:00:00Z"


def _escaped(line: Column) -> Column:
    """These characters stand in JSON inside strings only."""
    for sign, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), (" ", "\\u2028"), (" ", "\\u2029")):
        line = F.replace(line, F.lit(sign), F.lit(code))
    return line


def _time(c: Column) -> Column:
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.regexp_replace(F.date_format(c, ".SSSSSS"), "[.]?0+$", "")
    return F.concat(whole, part, F.lit("Z"))


def _sorted_map(c: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(c)))


def document_json(prefix: str = "") -> Column:
    """One compact line of the document columns. prefix: of a struct that holds them, like "document."."""
    c = lambda n: F.col(prefix + n)
    refs = lambda s: F.transform(s["refs"], lambda r: F.struct(r["type"].alias("Type"), r["target"].alias("Target")))
    chains = lambda s: F.transform(s["norm_chains"], lambda x: F.struct(x["source"].alias("Source"), x["target"].alias("Target")))
    sections = F.transform(c("sections"), lambda s: F.struct(s["identifier"].alias("Identifier"), s["heading"].alias("Heading"), s["content"].alias("Content"), refs(s).alias("References"), chains(s).alias("NormChains")))
    versions = F.transform(c("versions"), lambda v: F.struct(F.coalesce(_time(v["valid_from"]), F.lit(_UNBOUNDED)).alias("ValidFrom"), _time(v["valid_to"]).alias("ValidTo")))
    names = [("ID", "id"), ("Title", "title"), ("ShortTitle", "short_title"), ("Jurisdiction", "jurisdiction"), ("Type", "type")]
    times = [("PublishedAt", "published_at"), ("EffectiveFrom", "effective_from"), ("EffectiveTo", "effective_to")]
    whole = F.struct(*[F.coalesce(c(k), F.lit("")).alias(n) for n, k in names], *[_time(c(k)).alias(n) for n, k in times], F.coalesce(c("source_url"), F.lit("")).alias("SourceURL"), sections.alias("Sections"), versions.alias("Versions"), _sorted_map(c("metadata")).alias("Metadata"))
    return _escaped(F.to_json(whole, _OPTIONS))


@F.pandas_udf(StringType())
def _indented(lines: pd.Series) -> pd.Series:
    def one(line: str | None) -> str | None:
        if line is None:
            return None
        out = json.dumps(json.loads(line), indent=2, ensure_ascii=False)
        for sign, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026"), (" ", "\\u2028"), (" ", "\\u2029")):
            out = out.replace(sign, code)
        return out

    return lines.map(one).astype(object)


def document_json_pretty(prefix: str = "") -> Column:
    """The same on several lines, two spaces a level."""
    return _indented(document_json(prefix))


def document_lines(docs: DataFrame) -> DataFrame:
    """line: each document as one. Distributed; the order of rows is that of docs."""
    return docs.select(F.coalesce(document_json(), F.lit("null")).alias("line"))


def write_document_lines(docs: DataFrame, path: str) -> None:
    document_lines(docs).write.text(path)


def _few(lines: DataFrame, most: int) -> list[str]:
    """Lines for one string on the driver; ValueError beyond so many."""
    found = [r["line"] for r in lines.limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} rows: export them as lines")
    return found


def documents_json(docs: DataFrame, order: str = "id", most: int = MOST) -> str:
    """One array of all documents, on the driver; of at most so many. Tables are exported as lines."""
    return "[" + ",".join(_few(docs.orderBy(order).select(document_json().alias("line")), most)) + "]"


def _number(c: Column) -> Column:
    """Whole numbers without a decimal point."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def node_json() -> Column:
    fields = [F.col(k).alias(n) for n, k in (("ID", "id"), ("Type", "type"), ("Label", "label"), ("Jurisdiction", "jurisdiction"))]
    meta = F.when(F.size("metadata") > 0, _sorted_map(F.col("metadata")))
    return _escaped(F.to_json(F.struct(*fields, meta.alias("Metadata")), _OPTIONS))


def edge_json() -> Column:
    mark = "\u0000weight\u0000"
    fields = [F.col(k).alias(n) for n, k in (("From", "from"), ("To", "to"), ("Type", "type"))]
    meta = F.when(F.size("metadata") > 0, _sorted_map(F.col("metadata")))
    raw = F.to_json(F.struct(*fields, F.lit(mark).alias("Weight"), meta.alias("Metadata")), _OPTIONS)
    return _escaped(F.replace(raw, F.lit('"\\u0000weight\\u0000"'), _number(F.col("weight"))))


def node_lines(graph: Graph) -> DataFrame:
    return graph.sorted_nodes().select(node_json().alias("line"))


def edge_lines(graph: Graph) -> DataFrame:
    return graph.sorted_edges().select(edge_json().alias("line"))


def write_graph_lines(graph: Graph, nodes_path: str, edges_path: str) -> None:
    """Sorted over all part files, which their names keep in order."""
    node_lines(graph).write.text(nodes_path)
    edge_lines(graph).write.text(edges_path)


def graph_json(graph: Graph, most: int = MOST) -> str:
    """{"nodes": [...], "edges": [...]}, on the driver, of at most so many each; large graphs are exported as lines."""
    sides = [",".join(_few(rows, most)) for rows in (node_lines(graph), edge_lines(graph))]
    return '{"nodes":[' + sides[0] + '],"edges":[' + sides[1] + "]}"


def write_json_file(path: str, value: object) -> None:
    """An indented JSON file on the driver's disk that is there whole or not at all."""
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    fd, part = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), suffix=".tmp")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        f.write(json.dumps(value, indent=2, ensure_ascii=False))
    os.replace(part, path)
