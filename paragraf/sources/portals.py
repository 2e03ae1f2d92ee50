"""The legal portals: where each lists its documents, which links are documents, and how they are identified.

All portals of HTML pages are one operator, listed(), driven by a row of settings. Settings can be overridden.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.html import tree
from ..functions.text import SPACES, any_of, collapsed, cut_bytes, first_non_blank, non_blank, trimmed
from ..functions.urls import build_url, host, https, parent_name, path, query, resolved, url_id, without_fragment


@dataclass(frozen=True)
class Portal:
    name: str
    jurisdiction: str
    list_url: str
    #: An anchor counts if its href holds one of these.
    hrefs: tuple[str, ...]
    #: Exact hosts if exact_hosts, else parts of the host.
    hosts: tuple[str, ...]
    paths: tuple[str, ...]
    queries: tuple[str, ...]
    id_keys: tuple[str, ...]
    exact_hosts: bool = False
    dotted_ids: bool = True
    title_bytes: int = 260
    short_title: int = 24
    base_url: str = ""
    list_path: str = ""
    list_query: dict[str, str] = field(default_factory=dict, hash=False)

    def with_query(self, overrides: dict[str, str]) -> Portal:
        """The list URL built anew; a blank value takes the key out."""
        merged = {k.strip(SPACES): v for k, v in (self.list_query | overrides).items() if k.strip(SPACES) and v.strip(SPACES)}
        return replace(self, list_query=merged, list_url=build_url(self.base_url or self.list_url, self.list_path, merged))


def _state(name: str, code: str, url: str, hrefs: str, hosts: str, paths: str, queries: str, keys: str, **more) -> Portal:
    return Portal(name, code, url, tuple(hrefs.split()), (hosts,), tuple(paths.split()), tuple(queries.split()), tuple(keys.split()), **more)


_QUERY = {"quelle": "jlink", "query": "*", "showdoccase": "1"}


def _profile(name: str, code: str, domain: str, *more_hosts: str) -> Portal:
    base = f"https://{domain}/"
    return Portal(name, code, build_url(base, "/jportal/", _QUERY), ("quelle=jlink", "doc.id", "jportal"), (domain, *more_hosts), ("jportal", "quelle.jlink"), ("doc.id", "doc.part"), ("doc.id", "doknr", "id", "j"), exact_hosts=True, dotted_ids=False, base_url=base, list_path="/jportal/", list_query=dict(_QUERY))


STATES = {
    p.name: p
    for p in (
        _state("nrw", "DE-NW", "https://recht.nrw.de/", "/lmi/owa/br_ /lmi/owa v_id= sg= menu=", "recht.nrw.de", "/lmi/", "sg= menu", "v_id id docid doc.id j", title_bytes=240, short_title=20),
        _state("bayern", "DE-BY", "https://www.gesetze-bayern.de/", "gesetze-bayern Content/Document document id=", "gesetze-bayern.de", "/content/document /document", "id= docid=", "id docid doknr j"),
        _state("brandenburg", "DE-BB", "https://bravors.brandenburg.de/", "bravors doknr id= dokument", "bravors.brandenburg.de", "dokument bravors", "doknr= id=", "doknr id docid j"),
        _state("sachsen", "DE-SN", "https://www.revosax.sachsen.de/", "revosax vorschrift dokument id=", "revosax.sachsen.de", "vorschrift dokument revosax", "id=", "id doknr docid j"),
        _state("niedersachsen", "DE-NI", "https://voris.wolterskluwer-online.de/", "voris document docid id=", "voris", "document voris", "docid= id= d=", "id docid d j"),
    )
}
PROFILES = {
    p.name: p
    for p in (
        _profile("baden-wuerttemberg", "DE-BW", "www.landesrecht-bw.de", "landesrecht-bw.de"),
        _profile("berlin", "DE-BE", "gesetze.berlin.de"),
        _profile("hessen", "DE-HE", "www.rv.hessenrecht.hessen.de", "rv.hessenrecht.hessen.de"),
        _profile("mecklenburg-vorpommern", "DE-MV", "www.landesrecht-mv.de", "landesrecht-mv.de"),
        _profile("rheinland-pfalz", "DE-RP", "landesrecht.rlp.de"),
        _profile("sachsen-anhalt", "DE-ST", "www.landesrecht.sachsen-anhalt.de", "landesrecht.sachsen-anhalt.de"),
        _profile("schleswig-holstein", "DE-SH", "www.gesetze-rechtsprechung.sh.juris.de", "gesetze-rechtsprechung.sh.juris.de"),
        _profile("thueringen", "DE-TH", "landesrecht.thueringen.de"),
    )
}
PORTALS = STATES | PROFILES
FEDERAL, FEDERAL_JURISDICTION = "bundesrecht", "DE-BUND"
FEDERAL_TOC, FEDERAL_LAW = "https://www.gesetze-im-internet.de/gii-toc.xml", "https://www.gesetze-im-internet.de/{}/xml.zip"
_GENERIC = ("doc.id", "docid", "id", "jportal", "quelle=jlink")


def source_name(portal: Portal) -> str:
    return f"juris-{portal.name.lower()}" if portal.exact_hosts else portal.name


def profile_names() -> list[str]:
    return sorted(PROFILES)


def default_query(name: str) -> dict[str, str] | None:
    p = PROFILES.get(name.strip(SPACES))
    return dict(p.list_query) if p else None


def profile(name: str, query_overrides: dict[str, str] | None = None, **settings) -> Portal:
    """A profile by name, settings before its own. A name that is no profile needs a base_url of its own, else ValueError."""
    name = name.strip(SPACES) or "juris"
    p = PROFILES.get(name)
    if p is None:
        base = (settings.get("base_url") or "").strip(SPACES)
        if not base:
            raise ValueError(f"{name!r} is no profile ({', '.join(profile_names())}) and has no base_url")
        p = Portal(name, "", build_url(base, settings.get("list_path", ""), settings.get("list_query", {})), _GENERIC, (base.split("//", 1)[-1].split("/", 1)[0].lower(),), ("jportal", "quelle.jlink"), ("doc.id", "doc.part"), ("doc.id", "doknr", "id", "j"), exact_hosts=True, dotted_ids=False, base_url=base)
    p = replace(p, **{k: v for k, v in settings.items() if v})
    if any(settings.get(k) for k in ("base_url", "list_path", "list_query")) and not settings.get("list_url"):
        p = replace(p, list_url=build_url(p.base_url, p.list_path, p.list_query))
    return p.with_query(query_overrides) if query_overrides else p


def presets() -> dict[str, Callable[..., Portal]]:
    """A constructor for each profile; its keywords are query overrides."""
    return {name: partial(_preset, name) for name in profile_names()}


def _preset(name: str, **query_overrides: str) -> Portal:
    return profile(name, query_overrides or None)


def is_document_url(url: Column, portal: Portal) -> Column:
    place, way, asked = host(url), F.lower(path(url)), F.lower(query(url))
    where = place.isin(*[h.lower() for h in portal.hosts]) if portal.exact_hosts else any_of([place.contains(h) for h in portal.hosts])
    return where & any_of([way.contains(p) for p in portal.paths] + [asked.contains(q) for q in portal.queries])


def document_id(url: Column, portal: Portal) -> Column:
    return url_id(url, portal.id_keys, portal.dotted_ids)


_ANCHORS = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("href", "text", "title", "label", "data", "row", "item")]))


def anchors(raw: Column, hrefs: tuple[str, ...] = ()) -> Column:
    """Of a page the anchors in order whose href holds one of hrefs (all, if none are given), with the texts around."""

    def each(pages: pd.Series) -> pd.Series:
        out = []
        for page in pages:
            found = []
            try:
                html = tree(page if isinstance(page, str) else bytes(page or b"").decode("utf-8", errors="replace"))
            except ValueError:  # a page that cannot be read lists nothing
                out.append(found)
                continue
            for a in html.find("a"):
                href = a.attrs.get("href")
                if href is not None and (not hrefs or any(h in href for h in hrefs)):
                    text = a.text()
                    around = [n.text() if not text.strip(SPACES) and (n := a.closest(t)) else "" for t in ("tr", "li")]
                    found.append(dict(zip(("href", "text", "title", "label", "data", "row", "item"), (href, text, *(a.attrs.get(k, "") for k in ("title", "aria-label", "data-title")), *around))))
            out.append(found)
        return pd.Series(out, dtype=object)

    each.__annotations__ = {"pages": pd.Series, "return": pd.Series}
    return F.pandas_udf(each, _ANCHORS)(raw)


def listed(pages: DataFrame, portal: Portal, raw: str = "payload", base: str | None = None, page: str = "page_id") -> DataFrame:
    """page, pos, id, url, title of the documents that list pages link to, a URL once a page (where it comes first).

    pages: page (any key), raw (markup) and, if named, base (the page's URL; else the portal's list URL). Null and
    empty pages and those that cannot be read list nothing; equal keys are one page.
    """
    where = F.col(base) if base else F.lit(portal.list_url)
    hits = pages.select(F.col(page).alias("page"), where.alias("base"), F.posexplode(anchors(F.coalesce(F.col(raw), F.lit("").cast(pages.schema[raw].dataType)), portal.hrefs)).alias("at", "a"))
    found = hits.withColumn("url", without_fragment(resolved("base", "a.href"))).where((F.col("url") != "") & is_document_url(F.col("url"), portal))
    # The first of each URL by an aggregate with map-side combining; then places among those kept.
    first = found.groupBy("page", "url").agg(F.min(F.struct("at", "a")).alias("f")).select("page", "url", F.col("f.at").alias("at"), F.col("f.a").alias("a"))
    pos = F.row_number().over(Window.partitionBy("page").orderBy("at"))
    around = F.coalesce(non_blank(cut_bytes(collapsed("a.row"), portal.title_bytes)), non_blank(cut_bytes(collapsed("a.item"), portal.title_bytes)), F.lit(""))
    title = F.coalesce(*[non_blank(collapsed(f"a.{n}")) for n in ("text", "title", "label", "data")], non_blank(around), F.lit(""))
    numbered = F.concat(F.lit(f"{'juris' if portal.exact_hosts else portal.name}-"), pos.cast("string"))
    return first.select("page", pos.alias("pos"), first_non_blank(document_id(F.col("url"), portal), numbered).alias("id"), "url", title.alias("title"))


def federal_toc(tocs: DataFrame, raw: str = "payload") -> DataFrame:
    """pos, id, url, title of the federal table of contents, in order; entries whose link gives no id are left out.

    A payload that is no XML lists nothing.
    """
    text = F.decode(raw, "UTF-8") if isinstance(tocs.schema[raw].dataType, T.BinaryType) else F.col(raw)
    items = F.from_xml(text, F.lit("item array<struct<title:string,link:string>>"))["item"]
    each = tocs.select(F.posexplode(items).alias("pos", "i")).select("pos", parent_name(trimmed("i.link")).alias("id"), https(F.col("i.link")).alias("url"), trimmed(F.coalesce(F.col("i.title"), F.lit(""))).alias("title"))
    return each.where("id <> ''")


def list_pages(spark: SparkSession, portal: Portal, fetch: Callable[[str], tuple[int, bytes]]) -> DataFrame:
    """page_id (its URL), payload: the portal's list page, fetched on the driver. A status of 400 or more is an error."""
    status, payload = fetch(portal.list_url)
    if status >= 400:
        raise ValueError(f"list request failed with status {status}")
    return spark.createDataFrame([(portal.list_url, payload)], "page_id STRING, payload BINARY")


def portal_refs(spark: SparkSession, portal: Portal, fetch: Callable[[str], tuple[int, bytes]]) -> DataFrame:
    """pos, id, url, title of what a portal's list page links to."""
    return listed(list_pages(spark, portal, fetch), portal).select("pos", "id", "url", "title")


def federal_refs(spark: SparkSession, fetch: Callable[[str], tuple[int, bytes]], toc_url: str = FEDERAL_TOC) -> DataFrame:
    """pos, id, url, title of the federal table of contents, fetched on the driver."""
    status, payload = fetch(toc_url)
    if status >= 400:
        raise ValueError(f"list request failed with status {status}")
    return federal_toc(spark.createDataFrame([(payload,)], "payload BINARY"))


def with_federal_urls(refs: DataFrame) -> DataFrame:
    """refs whose blank URLs are those of their ids' archives; without an id they stay blank."""
    named = F.when(non_blank("id").isNotNull(), F.concat(F.lit(FEDERAL_LAW.split("{}")[0]), trimmed("id"), F.lit(FEDERAL_LAW.split("{}")[1])))
    return refs.withColumn("url", F.coalesce(non_blank("url"), named, F.lit("")))
