"""Citations and citation chains of German legal text.

A text without a section or article sign never reaches Python; the others go through Arrow in batches. Matching runs
over UTF-8, since the distances within which a law is looked for are counted in bytes.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CHAIN, REFERENCE
from .text import SPACES

_SIGN = "§".encode()
_NUMBER = rb"[0-9]+[a-zA-Z]*"
_GAP = rb"[\t\n\f\r ]*"
_LAW = rb"[A-Z][A-Z0-9]{1,12}"


def _rx(*parts: bytes, fold: bool = True) -> re.Pattern[bytes]:
    return re.compile(b"".join(parts), re.IGNORECASE if fold else 0)


_LIST = _rx(_SIGN * 2, _GAP, b"(", _NUMBER, b"(?:", _GAP, b",", _GAP, _NUMBER, b")*(?:", _GAP, b"(?:und|oder)", _GAP, _NUMBER, b")?)")
_ONE = _rx(b"(", _SIGN, rb"|Art\.?)", _GAP, b"(", _NUMBER, b")(?:", _GAP, rb"Abs\.", _GAP, b"(", _NUMBER, b"))?(?:", _GAP, rb"S\.", _GAP, b"([0-9]+))?")
_AFTER = _rx(_GAP, rb"(?:[),;:]", _GAP, rb")?(?:i\.", _GAP, rb"V\.", _GAP, rb"m\.", _GAP, b")?(", _LAW, rb")\b", fold=False)
_AHEAD = _rx(b"(", _LAW, b")", _GAP, rb"\Z", fold=False)
_SEPARATOR = _rx(_GAP, b"(?:,|und|oder)", _GAP, fold=False)
#: In this order, if several are near.
ALIASES = {"buergerliches gesetzbuch": "BGB", "grundgesetz": "GG", "strafgesetzbuch": "StGB", "zivilprozessordnung": "ZPO", "verwaltungsgerichtsordnung": "VwGO"}
NEAR, FAR = 48, 80

_STEP = rb"[\t\n\f\r ]+"
_DOT = _GAP + rb"\.?" + _GAP
_LINKING = [rb"\bi" + _DOT + b"v" + _DOT + b"m" + _GAP + rb"\.?\b", rb"\bivm\b", *(rb"\bin" + _STEP + b"verbindung" + _STEP + w + rb"\b" for w in (b"mit", b"zu")), rb"\bgemae(?:ss|" + "ß|ẞ".encode() + rb")\b", rb"\bgem\.\b"]
_LINKING += [rb"\bnach" + _STEP + w + _STEP + rb"von\b" for w in ("maßgabe".encode(), b"massgabe")] + [rb"\bentsprechend\b"]
_STRONG = _rx(b"|".join(_LINKING))
_WEAK = _rx(b"(?:,|und|oder|sowie|bzw)")
_CORRECT = _rx("gemä(?:ß|ss)".encode())
_BREAKS = re.compile(rb"[.!?;\n\r]")
_SQUEEZED = {"ivm", "inverbindungmit", "inverbindungzu", "gemaess", "gemass", "gem", "nachmassgabevon", "entsprechend"}
_DROPPED = str.maketrans("", "", " \t\n\r.,:-_()")


def law_token(v: str) -> str:
    """A law's name as references carry it."""
    v = v.strip(SPACES)
    if v.lower() in ALIASES:
        return ALIASES[v.lower()]
    v = v.strip("()[]{}.,;:").upper()
    return ALIASES.get(v.lower(), v)


class _Laws:
    """Which law a citation means; remembers the last that was named."""

    def __init__(self, text: bytes, default: str) -> None:
        self.text, self.default, self.last = text, law_token(default or ""), ""

    def at(self, start: int, end: int) -> tuple[str, bool]:
        """The law, and whether it is named near the citation."""
        t = self.text
        if m := _AFTER.match(t[end : end + NEAR]):
            named = m[1].decode()
        elif m := _AHEAD.search(t[max(0, start - NEAR) : start]):
            named = m[1].decode()
        else:
            around = t[max(0, start - FAR) : end + FAR].decode(errors="replace").lower()
            named = next((law for phrase, law in ALIASES.items() if phrase in around), "")
        if named := law_token(named):
            self.last = named
            return named, True
        return law_token(self.last) or self.default and law_token(self.default) or "UNSPECIFIED", False


def _token(m: re.Match[bytes]) -> str:
    kind, number, paragraph, sentence = (g.decode() if g else "" for g in m.groups())
    return ("Art. " if kind[:3].lower() == "art" else "§ ") + number + (f" Abs. {paragraph}" if paragraph else "") + (f" S. {sentence}" if sentence else "")


def references_of(text: str | None, default: str | None) -> list[tuple[str, str]]:
    """(type, target), once each: those of all lists first, then single ones, in order."""
    raw = (text or "").strip(SPACES).encode()
    laws, found = _Laws(raw, default or ""), {}
    for m in _LIST.finditer(raw):
        law, named = laws.at(*m.span())
        if named:
            found["law", law] = None
        for number in _SEPARATOR.split(m[1]):
            if number.strip():
                found["paragraph", f"{law} § {number.strip().decode()}"] = None
    for m in _ONE.finditer(raw):
        law, named = laws.at(*m.span())
        if named:
            found["law", law] = None
        token = _token(m)
        found["article" if token[0] == "A" else "paragraph", f"{law} {token}"] = None
    return list(found)


def links(between: bytes, extended: bool = False) -> bool:
    """Whether what stands between two citations makes the second depend on the first."""
    text = between.decode(errors="replace").strip(SPACES)
    raw = text.encode()
    if not text or len(raw) > 120 or "§" in text or "art" in text.lower():
        return False
    return bool(_STRONG.search(raw)) or text.lower().translate(_DROPPED) in _SQUEEZED or extended and bool(_CORRECT.search(raw))


def continues(between: bytes) -> bool:
    """Whether it only goes on with a list."""
    raw = between.decode(errors="replace").strip(SPACES).encode()
    return bool(raw) and len(raw) <= 40 and not _BREAKS.search(raw) and bool(_WEAK.fullmatch(raw))


def chains_of(text: str | None, default: str | None, extended: bool = False) -> list[tuple[str, str]]:
    """(source, target), once each. extended: gemäß links as well."""
    raw = (text or "").strip(SPACES).encode()
    laws, found = _Laws(raw, default or ""), {}
    hits = [(m.start(), m.end(), f"{laws.at(*m.span())[0]} {_token(m)}") for m in _ONE.finditer(raw)]
    carried = ""
    for (_, end, left), (start, _, right) in zip(hits, hits[1:]):
        if links(raw[end:start], extended):
            source = carried = left
        elif carried and continues(raw[end:start]):
            source = carried
        else:
            source = carried = ""
        if source and source != right:
            found[source, right] = None
    return list(found)


def struct_lists(rows: list[list[tuple[str, str]]], kind: T.StructType) -> pa.Array:
    """An Arrow list of structs of two strings for each row."""
    flat = [x for row in rows for x in row]
    columns = [pa.array([x[k] for x in flat], pa.string()) for k in range(2)]
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, names=kind.names))


def _batched(one, kind: T.StructType, text: Column, default: Column | None) -> Column:
    def each(texts: pa.Array, defaults: pa.Array) -> pa.Array:
        return struct_lists([one(t, d) if t else [] for t, d in zip(texts.to_pylist(), defaults.to_pylist())], kind)

    each.__annotations__ = {"texts": pa.Array, "defaults": pa.Array, "return": pa.Array}
    possible = F.when(text.rlike("§|[aA][rR][tT]"), text)
    return F.arrow_udf(each, T.ArrayType(kind))(possible, F.coalesce(default, F.lit("")) if default is not None else F.lit(""))


def references(text: Column | str, default: Column | None = None) -> Column:
    """ARRAY<STRUCT<type, target>>. default: the law of citations that name none."""
    return _batched(references_of, REFERENCE, F.col(text) if isinstance(text, str) else text, default)


def chains(text: Column | str, default: Column | None = None, extended_connectors: bool = False) -> Column:
    """ARRAY<STRUCT<source, target>>."""
    one = (lambda t, d: chains_of(t, d, True)) if extended_connectors else chains_of
    return _batched(one, CHAIN, F.col(text) if isinstance(text, str) else text, default)
