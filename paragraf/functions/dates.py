"""Dates as legal portals write them, effective ranges, and validity windows. All in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, trimmed

_EDGE = "(?:(?<![0-9A-Za-z_])(?=[0-9])|(?<=[0-9])(?![0-9A-Za-z_]))"
_ANY = f"{_EDGE}([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}[.][0-9]{{1,2}}[.][0-9]{{4}}|[0-9]{{8}}){_EDGE}"
_STAMP = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"


def _whole(v: Column, stamps: bool) -> Column:
    shapes = [("^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "yyyy-MM-dd"), ("^[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}$", "d.M.yyyy"), ("^[0-9]{8}$", "yyyyMMdd")]
    tried = [F.when(v.rlike(shape), F.try_to_timestamp(v, F.lit(layout))) for shape, layout in shapes]
    if stamps:
        tried.insert(0, F.when(v.rlike(_STAMP), v.try_cast("timestamp")))
    return F.coalesce(*tried)


def date_loose(c: Column | str, stamps: bool = True) -> Column:
    """The timestamp that the text is, or that its first date says; null if there is none or it doesn't exist.

    stamps: RFC 3339 timestamps count as well.
    """
    found = lambda v: let(F.nullif(F.regexp_extract(v, _ANY, 1), F.lit("")), lambda d: _whole(d, stamps))
    return let(trimmed(c), lambda v: F.coalesce(_whole(v, stamps), found(v)))


def first_date(*values: Column) -> Column:
    return F.coalesce(*values)


def in_order(start: Column, end: Column) -> Column:
    """Not ending before it starts; an open side is in order."""
    return F.coalesce(end >= start, F.lit(True))


def closed_range(start: Column, end: Column) -> tuple[Column, Column]:
    """The range, open at the end if it would end before it starts."""
    return start, F.when(in_order(start, end), end)


def resolved_range(meta_from: Column, meta_to: Column, body_from: Column, body_to: Column) -> tuple[Column, Column]:
    """What the page's metadata say, else what its text says. If that ends before it starts, the text's end, else none."""
    start, end = F.coalesce(meta_from, body_from), F.coalesce(meta_to, body_to)
    return start, F.when(in_order(start, end), end).when(in_order(start, body_to), body_to)


def contains(window: Column, at: Column) -> Column:
    """Whether the window holds the moment; both ends belong to it, an open side reaches on."""
    return F.coalesce(window["valid_from"] <= at, F.lit(True)) & F.coalesce(window["valid_to"] >= at, F.lit(True))


def version_at(versions: Column, at: Column) -> Column:
    """The first window that holds the moment, else null."""
    return F.get(F.filter(versions, lambda w: contains(w, at)), F.lit(0))


def version_index_at(versions: Column, at: Column) -> Column:
    """Place of that window, from 0, else null."""
    return F.get(F.filter(F.transform(versions, lambda w, i: F.when(contains(w, at), i)), lambda i: i.isNotNull()), F.lit(0))


def derived_window(effective_from: Column, published_at: Column, effective_to: Column) -> Column:
    """The one window that a document's dates give, as an array; empty if they give none or end before they start."""
    start = F.coalesce(effective_from, published_at)
    window = F.struct(start.alias("valid_from"), effective_to.alias("valid_to"))
    return F.filter(F.array(window), lambda w: (w["valid_from"].isNotNull() | w["valid_to"].isNotNull()) & in_order(w["valid_from"], w["valid_to"]))


def normal_versions(versions: Column) -> Column:
    """Windows in order (open starts first, open ends last), without those that end early and without repeats."""
    # The natural order of structs puts nulls first; a flag puts open ends last.
    keyed = F.transform(F.filter(versions, lambda w: in_order(w["valid_from"], w["valid_to"])), lambda w: F.struct(w["valid_from"].alias("a"), w["valid_to"].isNull().alias("open"), w["valid_to"].alias("b")))
    return F.transform(F.array_sort(F.array_distinct(keyed)), lambda k: F.struct(k["a"].alias("valid_from"), k["b"].alias("valid_to")))


def ensured_versions(versions: Column, effective_from: Column, published_at: Column, effective_to: Column) -> Column:
    """The given windows in order; where there are none that hold, the one derived from the document's dates."""
    own = normal_versions(F.coalesce(versions, F.array().cast("array<struct<valid_from: timestamp, valid_to: timestamp>>")))
    return F.when(F.size(own) > 0, own).otherwise(derived_window(effective_from, published_at, effective_to))


def filled_range(versions: Column, effective_from: Column, effective_to: Column) -> tuple[Column, Column]:
    """The document's range, filled from the start of its first window and the end of its last."""
    return F.coalesce(effective_from, F.get(versions, F.lit(0))["valid_from"]), F.coalesce(effective_to, F.get(versions, F.size(versions) - 1)["valid_to"])
