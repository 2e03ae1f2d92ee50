"""URL expressions. Resolution and query building follow RFC 3986 in Arrow batches; the rest stays in the JVM."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, urldefrag, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import SPACES, non_blank, trimmed


def https(c: Column | str) -> Column:
    return F.regexp_replace(c, "^http://", "https://")


def without_fragment(c: Column | str) -> Column:
    return F.regexp_replace(trimmed(c), "#.*$", "")


def host(c: Column) -> Column:
    """With its port, lower-cased."""
    return F.lower(F.regexp_extract(c, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def path(c: Column) -> Column:
    return F.regexp_extract(c, "^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(c: Column) -> Column:
    return F.regexp_extract(c, "^[^?#]*[?]([^#]*)", 1)


def query_value(c: Column, key: str) -> Column:
    """The first value of the key, decoded; empty without it."""
    found = F.regexp_extract(F.concat(F.lit("&"), query(c)), "[&]" + key.replace(".", "[.]") + "=([^&]*)", 1)
    return F.coalesce(F.try_url_decode(found), F.lit(""))


def parent_name(c: Column | str) -> Column:
    """Name of the directory a URL's file is in: .../zpo/xml.zip gives zpo; empty if there is none."""
    way = F.regexp_replace(path(F.col(c) if isinstance(c, str) else c), "/+$", "")
    return F.regexp_extract(way, "([^/]+)/+[^/]+$", 1)


def url_id(c: Column, keys: tuple[str, ...], dotted: bool = True) -> Column:
    """key-value of the first of keys with a value, else the last part of the path, else empty.

    dotted: whether a dot in the key stays, or becomes _.
    """
    values = [F.concat(F.lit((k if dotted else k.replace(".", "_")) + "-"), non_blank(query_value(c, k))) for k in keys]
    decoded = F.coalesce(F.try_url_decode(F.regexp_replace(path(c), "[+]", "%2B")), F.lit(""))
    return F.coalesce(*values, non_blank(F.regexp_extract(decoded, "([^/]+)/*$", 1)), F.lit(""))


#: What a path may hold as it is; other characters are percent-encoded.
_SAFE = "!$&'()*+,;=:@[]%/"
_PLAIN = re.compile("[A-Za-z0-9_.~?#!$&'()*+,;=:@%/\\[\\]-]*")


def resolve_one(base: str | None, href: str | None, fragment: bool = True) -> str:
    """href seen from base; empty if it is blank or no URL."""
    href = (href or "").strip(SPACES)
    if not href:
        return ""
    try:
        url = urljoin((base or "").strip(SPACES), href)
        if not _PLAIN.fullmatch(url):
            parts = urlsplit(url)
            url = urlunsplit(parts._replace(path=quote(parts.path, safe=_SAFE)))
        return url if fragment else urldefrag(url).url
    except ValueError:
        return ""


@F.pandas_udf(StringType())
def resolved(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([resolve_one(b, h) for b, h in zip(base, href)], dtype=object)


def build_url(base: str, relative: str = "", values: dict[str, str] | None = None) -> str:
    """The URL with the non-blank values in its query, sorted by name, and no fragment."""
    try:
        url = urlsplit(urljoin(base.strip(SPACES), relative.strip(SPACES)) if relative.strip(SPACES) else base.strip(SPACES))
    except ValueError:
        return base.strip(SPACES)
    asked: dict[str, list[str]] = {}
    for k, v in parse_qsl(url.query, keep_blank_values=True):
        asked.setdefault(k, []).append(v)
    asked |= {k: [v.strip(SPACES)] for k, v in (values or {}).items() if v.strip(SPACES)}
    return urlunsplit((url.scheme, url.netloc, url.path, urlencode(sorted(asked.items()), doseq=True), ""))

