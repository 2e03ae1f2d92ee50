"""Markup to documents: generic XML, generic and portal HTML, federal XML.

Each parser is a column expression, markup (BINARY or STRING) to the document struct. Payloads that cannot be parsed
give a struct whose error says why, its other fields null; the batch goes on. The trees are built in Python, in Arrow
batches; dates, ranges, types, versions, citations and titles are Spark expressions over what they hold.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import citations
from ..functions.dates import closed_range, date_loose, resolved_range
from ..functions.html import tree
from ..functions.text import SPACES, collapsed, known, let, trimmed
from ..schema import DOCUMENT_TYPES

_S = T.StringType()
_STRINGS = T.ArrayType(_S)
_SECTIONS = T.ArrayType(T.StructType([T.StructField(n, _S) for n in ("identifier", "heading", "content", "law")]))
_TREE = T.StructType(
    [T.StructField(n, _S) for n in ("error", "id", "title", "short_title", "jurisdiction", "type", "body")]
    + [T.StructField(n, _STRINGS) for n in ("published", "starts", "ends")]
    + [T.StructField("metas", T.ArrayType(T.StructType([T.StructField("key", _S), T.StructField("content", _S)]))), T.StructField("sections", _SECTIONS)]
)


def _clean(v: str | None) -> str:
    return (v or "").strip(SPACES)


def _bytes(raw: bytes | str | None) -> bytes:
    return raw.encode() if isinstance(raw, str) else bytes(raw or b"")


def _direct(node: ET.Element | None) -> str:
    """An element's own characters, without those of elements inside it."""
    return "" if node is None else (node.text or "") + "".join(c.tail or "" for c in node)


def _child(node: ET.Element | None, *way: str) -> ET.Element | None:
    for name in way:
        # Of elements that repeat the last one holds.
        node = next((c for c in reversed(node) if _name(c) == name), None) if node is not None else None
    return node


def _name(node: ET.Element) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _children(node: ET.Element | None, name: str) -> list[ET.Element]:
    return [] if node is None else [c for c in node if _name(c) == name]


def law_tree(raw: bytes) -> dict:
    """The generic law format: law(@id, title, ..., sections/section(@id, heading, content))."""
    root = ET.fromstring(raw)
    if _name(root) != "law":
        raise ValueError(f"expected a law, found {_name(root)}")
    field = lambda n: _clean(_direct(_child(root, n)))
    sections = [{"identifier": _clean(s.get("id")), "heading": _clean(_direct(_child(s, "heading"))), "content": _clean(_direct(_child(s, "content"))), "law": None} for s in (s for group in _children(root, "sections") for s in _children(group, "section"))]
    return {"id": _clean(root.get("id")), "title": field("title"), "short_title": field("shortTitle"), "jurisdiction": field("jurisdiction"), "type": field("type"), "published": [field("publishedAt")], "starts": [field("effectiveFrom")], "ends": [field("effectiveTo")], "sections": sections}


def federal_tree(raw: bytes) -> dict:
    """The federal format: dokumente/norm*. A norm's law is the first abbreviation up to it."""
    norms = _children(ET.fromstring(raw), "norm")
    if not norms:
        raise ValueError("no norm entries found")
    law, sections, dates = "", [], {"published": [], "starts": [], "ends": []}
    for norm in norms:
        meta = _child(norm, "metadaten")
        get = lambda *way, m=meta: _direct(_child(m, *way))
        law = law or _clean(get("jurabk"))
        dates["published"] += [get(n) for n in ("ausfertigung-datum", "ausfertigungdatum", "datum", "standangabe")]
        for kind, stem in (("starts", "inkrafttreten"), ("ends", "ausserkrafttreten")):
            dates[kind] += [get(stem + tail) for tail in ("", "-datum", "_datum")]
        pick = lambda *values: next((v for v in values if _clean(v)), "")
        identifier = pick(get("enbez"), get("gliederungseinheit", "gliederungsbez"), norm.get("doknr") or "")
        heading = pick(get("titel"), get("gliederungseinheit", "gliederungstitel"))
        content = _clean("\n".join(_direct(p) for p in _children(_child(norm, "textdaten", "text", "Content"), "P")))
        if _clean(identifier) or _clean(heading) or content:
            sections.append({"identifier": _clean(identifier), "heading": _clean(heading), "content": content, "law": law})
    return {"id": "", "title": law or (sections[0]["heading"] if sections else ""), "short_title": law, "jurisdiction": "DE-BUND", "type": "law", "sections": sections, **dates}


def page_tree(raw: bytes) -> dict:
    """A page: title, sections with their first heading and paragraph (or the whole body as one), metas, body text."""
    html = tree(raw.decode("utf-8", errors="replace"))
    body = html.first("body")
    text = lambda node: _clean(node.text()) if node is not None else ""
    sections = []
    for s in html.find("section"):
        heading, content = text(s.first("h2", "h3")), text(s.first("p"))
        if heading or content:
            sections.append({"identifier": _clean(s.attrs.get("id")), "heading": heading, "content": content, "law": None})
    whole = text(body)
    if not sections and whole:
        sections = [{"identifier": "", "heading": "", "content": whole, "law": None}]
    metas = [{"key": "|".join(_clean(m.attrs.get(k)).lower() for k in ("name", "property", "itemprop")), "content": _clean(m.attrs.get("content"))} for m in html.find("meta")]
    return {"title": text(html.first("h1")) or text(html.first("title")), "type": "law", "body": whole, "metas": [m for m in metas if m["content"]], "sections": sections}


def _parsed(one, raw: Column) -> Column:
    names = _TREE.names

    def each(column: pd.Series) -> pd.DataFrame:
        rows = []
        for value in column:
            payload = _bytes(value)
            try:
                if not payload:
                    raise ValueError("empty payload")
                rows.append({"error": None} | one(payload))
            except (ET.ParseError, ValueError, LookupError) as e:
                rows.append({"error": str(e) or type(e).__name__})
        return pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)

    each.__annotations__ = {"column": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(each, _TREE)(raw)


def _first_date(values: Column, stamps: bool) -> Column:
    return F.get(F.filter(F.transform(values, lambda v: date_loose(v, stamps)), lambda t: t.isNotNull()), F.lit(0))


_PUBLISHED_KEYS = ("date", "publish", "inkraft", "valid", "gueltig", "gültig")
_START_KEYS, _START_WORDS = ("effectivefrom", "validfrom", "inkraft"), ("inkraft", "effectivefrom", "validfrom", "gültig ab", "gueltig ab")
_END_KEYS, _END_WORDS = ("effectiveto", "validto", "ausserkraft", "außerkraft"), ("ausserkraft", "außerkraft", "effectiveto", "validto", "gültig bis", "gueltig bis")
_VALUE = "[\\t\\n\\f\\r ]*[:-]?[\\t\\n\\f\\r ]*([^;,.\\n\\r]+)"
_WIDE = "[\\t\\n\\f\\r ]+"


def _labelled(body: Column, labels: tuple[str, ...]) -> Column:
    return F.nullif(F.regexp_extract(body, "(?iu)(?:" + "|".join(x.replace(" ", _WIDE) for x in labels) + ")" + _VALUE, 1), F.lit(""))


def page_dates(metas: Column, body: Column, literal_meta_filter: bool = False) -> tuple[Column, Column, Column]:
    """published, effective from and to of a page, from its metas and its text.

    literal_meta_filter: meta keys with "effective" in them don't count, only those with a date, publish, inkraft,
    valid or gueltig.
    """
    keys = _PUBLISHED_KEYS if literal_meta_filter else (*_PUBLISHED_KEYS, "effective")
    has = lambda c, words: c.rlike("|".join(re.escape(w) for w in words))
    kept = F.filter(metas, lambda m: has(m["key"], keys))
    starts = lambda m: has(m["key"], _START_KEYS) | has(F.lower(m["content"]), _START_WORDS)
    ends = lambda m: ~starts(m) & (has(m["key"], _END_KEYS) | has(F.lower(m["content"]), _END_WORDS))
    first = lambda test: F.get(F.filter(F.transform(F.filter(kept, test), lambda m: date_loose(m["content"])), lambda t: t.isNotNull()), F.lit(0))
    meta_published = F.coalesce(first(lambda m: ~starts(m) & ~ends(m)), date_loose(F.get(kept, F.lit(0))["content"]))

    def body_dates(flat: Column) -> Column:
        start = date_loose(_labelled(flat, ("inkraft(?:treten)?", "gueltig ab", "gültig ab", "wirksam ab", "effective from")))
        end = date_loose(_labelled(flat, ("ausserkraft(?:treten)?", "außerkraft(?:treten)?", "gueltig bis", "gültig bis", "wirksam bis", "effective to", "valid to")))
        published = F.coalesce(date_loose(_labelled(flat, ("verkuendet", "verkündet", "veroeffentlicht", "veröffentlicht", "ausfertigung", "stand vom", "published", "date"))), date_loose(flat))
        return F.struct(start.alias("start"), end.alias("end"), published.alias("published"))

    def all_dates(x: Column) -> Column:
        b = x["body"]
        start, end = resolved_range(x["start"], x["end"], b["start"], b["end"])
        return F.struct(F.coalesce(x["published"], b["published"]).alias("published"), start.alias("start"), end.alias("end"))

    found = let(F.struct(first(starts).alias("start"), first(ends).alias("end"), meta_published.alias("published"), let(collapsed(body), body_dates).alias("body")), all_dates)
    return found["published"], found["start"], found["end"]


def short_title(title: Column | str, longest: int = 24) -> Column:
    """The first run of 2 to longest ASCII letters, digits, dots, hyphens and spaces in brackets."""
    return collapsed(F.regexp_extract(title, f"[(]([A-Za-z0-9.\\-\\t\\n\\f\\r ]{{2,{longest}}})[)]", 1))


def _sections(sections: Column, law: Column | None, cited: bool) -> Column:
    """With references and chains if cited; law: for sections that have none of their own."""
    none = F.array()
    refs, chains = none.cast("array<struct<type: string, target: string>>"), none.cast("array<struct<source: string, target: string>>")
    plain = lambda s, r, c: F.struct(s["identifier"].alias("identifier"), s["heading"].alias("heading"), s["content"].alias("content"), r.alias("refs"), c.alias("norm_chains"))
    if not cited:
        return F.transform(sections, lambda s: plain(s, refs, chains))
    # Spark takes no Python function inside a lambda: what comes from one is zipped in.
    laws = F.array_repeat(law if law is not None else F.lit(""), F.coalesce(F.size(sections), F.lit(0)))
    texts = F.zip_with(sections, laws, lambda s, d: F.struct(trimmed(F.concat(s["heading"], F.lit("\n"), s["content"])).alias("text"), F.coalesce(s["law"], d).alias("law")))
    return F.zip_with(sections, cite_all(texts), lambda s, f: plain(s, f["refs"], f["norm_chains"]))


_CITED = T.ArrayType(T.StructType([T.StructField("refs", T.ArrayType(citations.REFERENCE)), T.StructField("norm_chains", T.ArrayType(citations.CHAIN))]))


def cite_all(texts: Column) -> Column:
    """References and chains of an array of (text, law) in one pass."""

    def each(column: pa.Array) -> pa.Array:
        flat, ends = column.flatten(), np.concatenate([[0], np.cumsum(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)))])
        texts, laws = flat.field("text").to_pylist(), flat.field("law").to_pylist()
        refs = citations.struct_lists([citations.references_of(t, d) for t, d in zip(texts, laws)], citations.REFERENCE)
        chains = citations.struct_lists([citations.chains_of(t, d) for t, d in zip(texts, laws)], citations.CHAIN)
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.StructArray.from_arrays([refs, chains], names=["refs", "norm_chains"]))

    each.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return F.arrow_udf(each, _CITED)(texts)


def _document(t: Column, published: Column, start: Column, end: Column, sections: Column, short: Column, jurisdiction: Column) -> Column:
    text = lambda n: F.when(t["error"].isNull(), F.coalesce(t[n], F.lit("")))
    return F.struct(
        t["error"].alias("error"), text("id").alias("id"), text("title").alias("title"), short.alias("short_title"), jurisdiction.alias("jurisdiction"), known(t["type"], DOCUMENT_TYPES).alias("type"),
        published.alias("published_at"), start.alias("effective_from"), end.alias("effective_to"), F.lit("").alias("source_url"), sections.alias("sections"),
        F.array().cast("array<struct<valid_from: timestamp, valid_to: timestamp>>").alias("versions"), F.create_map().cast("map<string, string>").alias("metadata"),
    )


def xml_document(raw: Column | str) -> Column:
    t = _parsed(law_tree, F.col(raw) if isinstance(raw, str) else raw)
    start, end = closed_range(_first_date(t["starts"], True), _first_date(t["ends"], True))
    return _document(t, _first_date(t["published"], True), start, end, _sections(t["sections"], None, False), t["short_title"], t["jurisdiction"])


def html_document(raw: Column | str, literal_meta_filter: bool = False) -> Column:
    t = _parsed(page_tree, F.col(raw) if isinstance(raw, str) else raw)
    return _document(t, *page_dates(t["metas"], t["body"], literal_meta_filter), _sections(t["sections"], None, False), F.lit(""), F.lit(""))


def portal_document(raw: Column | str, jurisdiction: Column | str, longest_short_title: int = 24, literal_meta_filter: bool = False) -> Column:
    """An HTML page with the portal's jurisdiction, its short title, and citations whose default law that is."""
    t = _parsed(page_tree, F.col(raw) if isinstance(raw, str) else raw)
    short = short_title(t["title"], longest_short_title)
    place = F.lit(jurisdiction) if isinstance(jurisdiction, str) else jurisdiction
    return _document(t, *page_dates(t["metas"], t["body"], literal_meta_filter), _sections(t["sections"], short, True), short, place)


def federal_document(raw: Column | str) -> Column:
    t = _parsed(federal_tree, F.col(raw) if isinstance(raw, str) else raw)
    start, end = closed_range(_first_date(t["starts"], False), _first_date(t["ends"], False))
    return _document(t, _first_date(t["published"], False), start, end, _sections(t["sections"], None, True), t["short_title"], t["jurisdiction"])


__all__ = ["federal_document", "html_document", "page_dates", "portal_document", "short_title", "xml_document"]
