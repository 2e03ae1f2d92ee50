"""The corpus as a property graph: documents, sections and what they cite are nodes; citations and the like are edges.

Every document emits its nodes and edges in one generator each; where the same node or edge comes up again, what came
first or last is told by (order, place in the document). Merging is aggregation by key with map-side combining, so a
law that everything cites is no hot key.

Order is a column of the documents that says which comes first, their id unless named; equal orders tie by node id.
Null documents' fields count as blank, null arrays as empty. Rows that repeat are merged like any others: nodes stay,
weights add up. An empty table gives an empty graph. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_non_blank, node_token, split_list, trimmed

_MAP, _NODE, _EDGE = "map<string,string>", "array<struct<id:string,type:string,label:string,jurisdiction:string,metadata:map<string,string>>>", "array<struct<from:string,to:string,type:string,weight:double,metadata:map<string,string>>>"
#: The columns that are read; others are ignored, whatever their names.
MODEL = ("id", "title", "short_title", "jurisdiction", "type", "source_url", "sections", "metadata")
#: Where documents say what they replace; the first that isn't blank counts.
REPLACING = ("replaces", "ersetzt", "abloesung", "ablösung")


@dataclass(frozen=True)
class Kinds:
    """Which edges are built."""

    concretizes: bool = True
    cites: bool = True
    references: bool = True
    replaces: bool = True


@dataclass(frozen=True)
class Graph:
    """nodes (id, type, label, jurisdiction, metadata) by id; edges (from, to, type, weight, metadata) by the first three; documents: the ids of nodes that are documents, without merging nodes."""

    nodes: DataFrame
    edges: DataFrame
    documents: DataFrame | None = None

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("id") == trimmed(F.lit(node_id)))

    def sorted_nodes(self) -> DataFrame:
        return self.nodes.orderBy("id")

    def sorted_edges(self) -> DataFrame:
        return self.edges.orderBy("from", "to", "type")

    def outgoing(self, node_id: str) -> DataFrame:
        return self.edges.where(F.col("from") == trimmed(F.lit(node_id))).orderBy("to", "type")

    def incoming(self, node_id: str) -> DataFrame:
        return self.edges.where(F.col("to") == trimmed(F.lit(node_id))).orderBy("from", "type")

    def neighbours(self, ids: DataFrame, side: str = "from") -> DataFrame:
        """Edges whose side ("from" or "to") is among ids.id: the lookup of many nodes at once, as a join."""
        return self.edges.join(ids.select(trimmed("id").alias(side)).distinct(), side, "left_semi")


def document_node(doc_id: Column | str, short: Column | str, title: Column | str, url: Column | str, kind: Column | str) -> Column:
    token = node_token(first_non_blank(doc_id, short, title, url))
    kind = F.col(kind) if isinstance(kind, str) else kind
    return F.concat(F.when(kind == "ruling", "ruling:").otherwise("law:"), F.when(token == "", "unknown").otherwise(token))


def section_node(document: Column, index: Column, identifier: Column, heading: Column) -> Column:
    """index: the section's place among all, from 0."""
    numbered = F.concat(F.lit("section-"), (index + 1).cast("string"))
    token = node_token(first_non_blank(identifier, heading, numbered))
    return F.concat(F.lit("paragraph:"), document, F.lit(":"), F.when(token == "", numbered).otherwise(token))


def reference_node(kind: Column, target: Column) -> Column:
    prefix = F.when(kind == "law", "law:").when(kind.isin("paragraph", "article"), "paragraph:").otherwise("reference:")
    return F.concat(prefix, node_token(target))


def external_node(label: Column) -> Column:
    return F.concat(F.lit("paragraph:"), node_token(label))


def reference_type(kind: Column) -> Column:
    """The type of the node that a reference of that kind cites."""
    return F.when(kind == "law", "law").when(kind.isin("paragraph", "article"), "paragraph").otherwise("unknown")


def replaced_targets(metadata: Column) -> Column:
    """What the metadata say is replaced: parts between , ; and |, once each, letter case aside."""
    raw = first_non_blank(*[F.try_element_at(metadata, F.lit(name)) for name in REPLACING])
    return split_list(raw)


def _none() -> Column:
    return F.create_map().cast(_MAP)


def _node(node_id: Column, kind: Column | str, label: Column, place: Column | None = None, metadata: Column | None = None) -> Column:
    return F.struct(node_id.alias("id"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), label.alias("label"), (F.lit("") if place is None else place).alias("jurisdiction"), (_none() if metadata is None else metadata).alias("metadata"))


def _edge(start: Column, end: Column, kind: str, metadata: Column | None = None) -> Column:
    return F.struct(start.alias("from"), end.alias("to"), F.lit(kind).alias("type"), F.lit(1.0).alias("weight"), (_none() if metadata is None else metadata).alias("metadata"))


def _blank(c: Column | str) -> Column:
    return trimmed(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def emitted(docs: DataFrame, kinds: Kinds = Kinds(), order: str = "id") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as the documents mention them, each with seq, its place in the whole."""
    d = document_node("id", "short_title", "title", "source_url", "type")
    refs = lambda s: F.filter(F.coalesce(s["refs"], F.array().cast("array<struct<type:string,target:string>>")), lambda r: _blank(r["target"]) != "")
    ends = lambda s: F.filter(F.coalesce(s["norm_chains"], F.array().cast("array<struct<source:string,target:string>>")), lambda c: (_blank(c["source"]) != "") & (_blank(c["target"]) != "") & (_blank(c["source"]) != _blank(c["target"])))
    label = lambda s, i: first_non_blank(s["identifier"], s["heading"], F.concat(F.lit("section-"), (i + 1).cast("string")))
    linked = lambda c: F.struct(external_node(c["source"]).alias("from"), _blank(c["source"]).alias("source"), external_node(c["target"]).alias("to"), _blank(c["target"]).alias("target"))
    cited = lambda r: F.struct(reference_node(r["type"], r["target"]).alias("node"), reference_type(r["type"]).alias("kind"), F.coalesce(r["type"], F.lit("")).alias("type"), _blank(r["target"]).alias("label"))

    def prepared(s: Column, i: Column) -> Column:
        """Ids and tokens of a section, each worked out once."""
        fields = [section_node(F.col("_d"), i, s["identifier"], s["heading"]).alias("node"), label(s, i).alias("label"), _blank(s["identifier"]).alias("identifier"), _blank(s["heading"]).alias("heading")]
        return F.struct(*fields, *([F.transform(refs(s), cited).alias("refs")] if kinds.cites else []), *([F.transform(ends(s), linked).alias("chains")] if kinds.references else []))

    targets = F.coalesce(replaced_targets(F.coalesce("metadata", _none())), F.array().cast("array<string>"))
    sections = F.coalesce(F.col("sections"), F.array().cast(docs.schema["sections"].dataType))
    named = docs.select(d.alias("_d"), F.col(order).alias("_o"), *[F.col(c) for c in MODEL])
    named = named.select("_d", "_o", *[c for c in MODEL if c not in ("sections", "metadata")], targets.alias("_t"), F.transform(sections, prepared).alias("_s"))
    doc, place = F.col("_d"), _blank("jurisdiction")
    fields = [F.lit("document_id"), _blank("id"), F.lit("source_url"), _blank("source_url"), F.lit("title"), _blank("title"), F.lit("short_title"), _blank("short_title")]
    own = F.array(_node(doc, F.when(F.col("type") == "ruling", "ruling").otherwise("law"), first_non_blank("short_title", "title", doc), place, F.create_map(*fields))).cast(_NODE)

    def section_nodes(s: Column) -> Column:
        about = F.create_map(F.lit("document_node_id"), doc, F.lit("identifier"), s["identifier"], F.lit("heading"), s["heading"])
        found = [F.array(_node(s["node"], "paragraph", s["label"], place, about)).cast(_NODE)]
        if kinds.cites:
            found.append(F.transform(s["refs"], lambda r: _node(r["node"], r["kind"], r["label"])).cast(_NODE))
        if kinds.references:
            found.append(F.flatten(F.transform(s["chains"], lambda c: F.array(_node(c["from"], "paragraph", c["source"]), _node(c["to"], "paragraph", c["target"])))).cast(_NODE))
        return F.concat(*found)

    def section_edges(s: Column) -> Column:
        found = [F.array().cast(_EDGE)]
        if kinds.concretizes:
            found.append(F.array(_edge(s["node"], doc, "concretizes")).cast(_EDGE))
        if kinds.cites:
            found.append(F.transform(s["refs"], lambda r: _edge(s["node"], r["node"], "cites", F.create_map(F.lit("reference_type"), r["type"]))).cast(_EDGE))
        if kinds.references:
            found.append(F.transform(s["chains"], lambda c: _edge(c["from"], c["to"], "references")).cast(_EDGE))
        return F.concat(*found)

    nodes, edges = [own], [F.array().cast(_EDGE)]
    if kinds.replaces:
        nodes.append(F.transform("_t", lambda t: _node(external_node(t), "law", t)).cast(_NODE))
        edges.append(F.transform("_t", lambda t: _edge(doc, external_node(t), "replaces")).cast(_EDGE))
    nodes.append(F.flatten(F.transform("_s", section_nodes)))
    edges.append(F.flatten(F.transform("_s", section_edges)))
    out = []
    for rows in (nodes, edges):
        each = named.select("_o", "_d", F.posexplode(F.concat(*rows)).alias("_at", "_x"))
        out.append(each.select("_x.*", F.struct(F.col("_o").alias("o"), F.col("_d").alias("d"), F.col("_at").alias("at")).alias("seq")))
    return out[0], out[1]


def _last_map(rows: DataFrame) -> tuple[Column, Column]:
    """Of rows with metadata and seq: their names, to group by beside the key, and the last entries (seq, e) of such a group."""
    entries = F.when(F.size("metadata") > 0, F.struct("seq", F.map_entries("metadata").alias("e")))
    return F.map_keys("metadata").alias("_names"), F.max(entries).alias("_last")


def _merged_map() -> Column:
    """Of groups of equal key and other names each: of each name the value that came last."""
    flat = F.flatten(F.transform(F.sort_array(F.collect_list("_last")), lambda x: x["e"]))
    last = lambda all_, k: F.element_at(F.filter(all_, lambda x: x["key"] == k), -1)
    one = F.when(F.count("_last") > 1, F.transform(F.array_distinct(F.transform(flat, lambda x: x["key"])), lambda k: last(flat, k))).otherwise(flat)
    return F.coalesce(F.map_from_entries(F.sort_array(one)), _none()).alias("metadata")


def merged_nodes(rows: DataFrame) -> DataFrame:
    """One row an id: the first type but unknown, the first label and jurisdiction that aren't blank, the last metadata.

    Two aggregations, by id and the names of its metadata and then by id, in one pass over rows: of rows with the same names the last holds them all.
    """
    clean = rows.select(trimmed("id").alias("id"), F.coalesce("type", F.lit("unknown")).alias("type"), _blank("label").alias("label"), _blank("jurisdiction").alias("jurisdiction"), F.coalesce("metadata", _none()).alias("metadata"), "seq").where("id <> ''")
    facts = {"type": "unknown", "label": "", "jurisdiction": ""}
    names, last = _last_map(clean)
    by_names = clean.groupBy("id", names).agg(last, *[F.min(F.when(F.col(c) != blank, F.struct("seq", F.col(c).alias("x")))).alias(c) for c, blank in facts.items()])
    return by_names.groupBy("id").agg(*[F.coalesce(F.min(c)["x"], F.lit(blank)).alias(c) for c, blank in facts.items()], _merged_map())


def merged_edges(rows: DataFrame, metadata: bool = True) -> DataFrame:
    """One row for from, to and type: the sum of weights (of 0 and less: 1), the last metadata if asked for. No loops, no blank ends."""
    keys = ["from", "to", "type"]
    clean = rows.select(trimmed("from").alias("from"), trimmed("to").alias("to"), F.coalesce("type", F.lit("")).alias("type"), F.when(F.col("weight") > 0, F.col("weight")).otherwise(1.0).alias("weight"), F.coalesce("metadata", _none()).alias("metadata"), "seq")
    clean = clean.where("`from` <> '' AND `to` <> '' AND `from` <> `to`")
    if not metadata:
        return clean.groupBy(*keys).agg(F.sum("weight").alias("weight"), _none().alias("metadata"))
    names, last = _last_map(clean)
    return clean.groupBy(*keys, names).agg(last, F.sum("weight").alias("weight")).groupBy(*keys).agg(F.sum("weight").alias("weight"), _merged_map())


def build(docs: DataFrame, kinds: Kinds = Kinds(), order: str = "id", metadata: bool = True) -> Graph:
    """docs: id, title, short_title, jurisdiction, type, source_url, sections and metadata of the document model.

    Without metadata those of edges stay empty, which spares an aggregation.
    """
    nodes, edges = emitted(docs, kinds, order)
    own = docs.select(document_node("id", "short_title", "title", "source_url", "type").alias("id")).distinct()
    return Graph(merged_nodes(nodes), merged_edges(edges, metadata), own)
