"""Markup to documents."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from paragraf.operators import parse
from paragraf.sources import landing


def parsed(spark, parser, markup, **options):
    kind = "binary" if isinstance(markup, bytes) else "string"
    d = spark.createDataFrame([(markup,)], f"v {kind}").select(parser("v", **options).alias("d")).select("d.*")
    return d.first()


def day(x):
    return x and x.strftime("%Y-%m-%d")


LAW = '<law id=" mietg_7 "><title>Mietgesetz</title><type>LAW</type>{}<sections><section id="535"><heading>Miete</heading><content>Durch <b>den</b> Vertrag</content></section></sections></law>'


def test_generic_xml(spark):
    d = parsed(spark, parse.xml_document, LAW.format("<publishedAt>2020-01-02</publishedAt><effectiveFrom>03.04.2021</effectiveFrom><effectiveTo>20230405</effectiveTo>"))
    assert (d.error, d.id, d.title, d.type, len(d.sections)) == (None, "mietg_7", "Mietgesetz", "law", 1)
    assert (day(d.published_at), day(d.effective_from), day(d.effective_to)) == ("2020-01-02", "2021-04-03", "2023-04-05")
    assert d.sections[0].content == "Durch  Vertrag"


def test_generic_xml_range_and_errors(spark):
    assert parsed(spark, parse.xml_document, LAW.format("<effectiveFrom>2024-01-01</effectiveFrom><effectiveTo>2023-12-31</effectiveTo>")).effective_to is None
    for bad in ("", "<law><title>", "<other/>"):
        d = parsed(spark, parse.xml_document, bad)
        assert d.error and d.id is None


NORMS = """<dokumente>{}<norm doknr="D1"><metadaten><jurabk>ZPO</jurabk><enbez>§ 1</enbez><titel>Titel</titel>{}</metadaten>
<textdaten><text><Content><P>Vgl. § 2 BGB sowie Art. 3 GG.</P><P>Zwei</P></Content></text></textdaten></norm></dokumente>"""


def test_federal_xml(spark):
    dates = "<ausfertigung-datum>1950-01-02</ausfertigung-datum><inkrafttreten-datum>03.04.1951</inkrafttreten-datum><ausserkrafttreten-datum>20991231</ausserkrafttreten-datum>"
    d = parsed(spark, parse.federal_document, NORMS.format("<norm><metadaten><enbez>Vorspruch</enbez></metadaten></norm>", dates).encode())
    assert (d.title, d.short_title, d.jurisdiction, [s.identifier for s in d.sections]) == ("ZPO", "ZPO", "DE-BUND", ["Vorspruch", "§ 1"])
    assert (day(d.published_at), day(d.effective_from), day(d.effective_to)) == ("1950-01-02", "1951-04-03", "2099-12-31")
    assert [r.target for r in d.sections[1].refs] == ["BGB", "BGB § 2", "GG", "GG Art. 3"]
    assert d.sections[1].content == "Vgl. § 2 BGB sowie Art. 3 GG.\nZwei"


def test_federal_without_norms(spark):
    assert parsed(spark, parse.federal_document, b"<dokumente/>").error


def test_html_sections(spark):
    d = parsed(spark, parse.html_document, '<html><head><title>T</title></head><body><h1> Kopf </h1><section id="535"><h2>Miete</h2><p>Eins<p>Zwei</section><section></section></body></html>')
    assert (d.title, d.type, [tuple(s[:3]) for s in d.sections]) == ("Kopf", "law", [("535", "Miete", "Eins")])
    d = parsed(spark, parse.html_document, "<title>T</title><p>Nur <b>Text")
    assert (d.title, [tuple(s[:3]) for s in d.sections]) == ("T", [("", "", "Nur Text")])


@pytest.mark.parametrize("head, body, want", [
    ('<meta name="datePublished" content="2020-01-02"><meta name="effectiveFrom" content="03.04.2021"><meta name="effectiveTo" content="20230405">', "", ("2020-01-02", "2021-04-03", "2023-04-05")),
    ("", "Verkuendet: 01.02.2000. Inkrafttreten: 2000-03-04. Ausserkrafttreten: 20991231.", ("2000-02-01", "2000-03-04", "2099-12-31")),
    ('<meta name="effectiveFrom" content="2024-01-01"><meta name="effectiveTo" content="2023-01-01">', "Ausserkrafttreten: 20250101.", ("2024-01-01", "2024-01-01", "2025-01-01")),
    ('<meta name="effectiveFrom" content="2024-01-01"><meta name="effectiveTo" content="2023-01-01">', "", ("2024-01-01", "2024-01-01", None)),
])
def test_html_dates(spark, head, body, want):
    d = parsed(spark, parse.html_document, f"<html><head>{head}</head><body><p>{body}</p></body></html>")
    assert (day(d.published_at), day(d.effective_from), day(d.effective_to)) == want


@pytest.mark.parametrize("page", ["<h1>T</h1><![bogus[x]]><p>a", "<![", "<!DOCTYPE [<h1>T", "<h1>T<![CDATA[<p>]]>", "\x00<h1>T"])
def test_broken_html_is_no_error(spark, page):
    assert parsed(spark, parse.html_document, page).error is None


def test_html_literal_filter(spark):
    page = '<meta name="effectiveFrom" content="2024-01-01"><p>x'
    assert parsed(spark, parse.html_document, page, literal_meta_filter=True).effective_from is None


def test_portal(spark):
    page = "<h1>Bauordnung (BauO NRW)</h1><section><h2>§ 1</h2><p>Siehe § 1 BauO NRW i. V. m. Art. 3 GG.</p></section>"
    d = spark.createDataFrame([(page,)], "v string").select(parse.portal_document("v", "DE-NW", 20).alias("d")).select("d.*").first()
    assert (d.short_title, d.jurisdiction) == ("BauO NRW", "DE-NW") and len(d.sections[0].refs) >= 2


def test_short_title(spark):
    rows = spark.createDataFrame([("A (x) (B  C) (D)",), ("ohne",), (None,)], "v string")
    assert [r[0] for r in rows.select(parse.short_title("v")).collect()] == ["B C", "", None]


def test_archives(spark):
    def pack(*names):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n in names:
                z.writestr(n, n)
        return out.getvalue()

    rows = spark.createDataFrame([(pack("a.txt", "law.XML", "b.xml"),), (pack("a.txt"),), (b"nope",), (None,)], "v binary")
    assert [r[0] and bytes(r[0]) for r in rows.select(landing.unzipped("v")).collect()] == [b"law.XML", None, None, None]


def test_many_documents_keep_their_places(spark):
    rows = spark.range(50).select("id", F.concat(F.lit("<law id='x"), "id", F.lit("'><title>t</title></law>")).alias("v"))
    assert all(r.d == f"x{r.id}" for r in rows.select("id", parse.xml_document("v")["id"].alias("d")).collect())
