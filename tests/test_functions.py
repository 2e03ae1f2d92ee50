"""Text, dates, versions, URLs and citations against values worked out by hand."""

from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from paragraf.functions import citations, dates, text, urls


def one(spark, column, **values):
    kinds = {str: "string", int: "bigint", datetime: "timestamp", list: "array<string>", bytes: "binary"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column.alias("r")).first().r


@pytest.mark.parametrize("given_, want", [("BGB § 535", "bgb-535"), ("  Über Maß ", "ber-ma"), ("§§", ""), ("", ""), ("a--B  c", "a-b-c")])
def test_node_token(spark, given_, want):
    assert one(spark, text.node_token("v"), v=given_) == want


def test_text_helpers(spark):
    assert one(spark, text.trimmed("v"), v=" \t x y \n") == "x y"
    assert one(spark, text.collapsed("v"), v=" a  b\nc ") == "a b c"
    assert one(spark, text.first_non_blank("a", "b"), a=" ", b=" z ") == "z"
    assert one(spark, text.path_part("v"), v="..BGB § 1/x..") == "BGB_1_x"
    assert one(spark, text.path_part("v"), v=" ") == "unknown"
    assert one(spark, text.cut_bytes("v", 3), v="aüü") == "aü"
    assert one(spark, text.split_list("v"), v=" A, a;B| |b;C") == ["A", "B", "C"]
    assert one(spark, text.known("v", ("law", "order")), v=" LAW ") == "law"
    assert one(spark, text.known("v", ("law", "order")), v="act") == "unknown"


DAYS = [("2020-01-02", "2020-01-02"), ("03.04.2021", "2021-04-03"), ("3.4.2021", "2021-04-03"), ("20230405", "2023-04-05"), ("vom 01.02.2000 an, 03.04.2005", "2000-02-01"), ("31.02.2020", None), ("nichts", None), ("", None), ("003.04.2021", None)]


@pytest.mark.parametrize("given_, want", DAYS)
def test_date_loose(spark, given_, want):
    found = one(spark, dates.date_loose("v"), v=given_)
    assert (found and found.strftime("%Y-%m-%d")) == want


def test_date_stamps(spark):
    assert one(spark, F.date_format(dates.date_loose("v"), "yyyy-MM-dd HH:mm"), v="2020-01-02T10:00:00+02:00") == "2020-01-02 08:00"
    # without stamps the date inside still counts only where a word edge follows it
    assert one(spark, dates.date_loose("v", stamps=False), v="2020-01-02T10:00:00Z") is None


def _at(day):
    return F.lit(day).cast("timestamp")


def test_ranges(spark):
    ends = lambda *d: one(spark, F.date_format(dates.resolved_range(*map(_at, d))[1], "yyyy-MM-dd"))
    assert ends("2024-01-01", "2024-02-01", None, None) == "2024-02-01"
    assert ends("2024-01-01", "2023-01-01", None, "2024-03-01") == "2024-03-01"
    assert ends("2024-01-01", "2023-01-01", None, "2022-03-01") is None
    assert ends(None, "2023-01-01", None, None) == "2023-01-01"
    assert one(spark, dates.closed_range(_at("2024-01-01"), _at("2023-01-01"))[1]) is None


def _windows(*rows):
    return F.array(*[F.struct(_at(a).alias("valid_from"), _at(b).alias("valid_to")) for a, b in rows])


def _days(rows):
    return [tuple(x and x.strftime("%Y-%m-%d") for x in r) for r in rows]


def test_versions(spark):
    rows = [("2020-01-01", None), ("2020-01-01", "2020-06-01"), (None, "2019-01-01"), ("2021-01-01", "2020-01-01"), ("2020-01-01", "2020-06-01")]
    want = [(None, "2019-01-01"), ("2020-01-01", "2020-06-01"), ("2020-01-01", None)]
    assert _days(one(spark, dates.normal_versions(_windows(*rows)))) == want
    assert one(spark, dates.normal_versions(dates.normal_versions(_windows(*rows)))) == one(spark, dates.normal_versions(_windows(*rows)))
    at = lambda day: one(spark, dates.version_index_at(_windows(*want), _at(day)))
    assert (at("2018-01-01"), at("2019-01-01"), at("2019-06-01"), at("2020-06-01"), at("2020-06-02")) == (0, 0, None, 1, 2)
    assert _days([one(spark, dates.version_at(_windows(*want), _at("2020-03-01")))]) == [("2020-01-01", "2020-06-01")]
    none = F.lit(None).cast("array<struct<valid_from:timestamp,valid_to:timestamp>>")
    assert _days(one(spark, dates.ensured_versions(none, _at(None), _at("2001-01-01"), _at(None)))) == [("2001-01-01", None)]
    assert one(spark, dates.ensured_versions(none, _at(None), _at(None), _at(None))) == []
    assert one(spark, dates.ensured_versions(none, _at("2002-01-01"), _at(None), _at("2001-01-01"))) == []
    start, end = dates.filled_range(_windows(*want), _at(None), _at(None))
    assert one(spark, start) is None and one(spark, end) is None


def test_urls(spark):
    assert one(spark, urls.https("v"), v="http://a/b") == "https://a/b"
    assert one(spark, urls.parent_name("v"), v="https://x.de/zpo/xml.zip") == "zpo"
    assert one(spark, urls.parent_name("v"), v="xml.zip") == ""
    assert one(spark, urls.without_fragment("v"), v=" https://a/b?x=1#c ") == "https://a/b?x=1"
    assert one(spark, urls.url_id(F.col("v"), ("v_id", "doc.id")), v="https://a/b?doc.id=1%202&docxid=9") == "doc.id-1 2"
    assert one(spark, urls.url_id(F.col("v"), ("doc.id",), dotted=False), v="https://a/b?doc.id=7") == "doc_id-7"
    assert one(spark, urls.url_id(F.col("v"), ("id",)), v="https://a/b/letzte/") == "letzte"
    assert urls.resolve_one("https://a/b/c", "../für?q=1#f", False) == "https://a/f%C3%BCr?q=1"
    assert urls.resolve_one("https://a/", " ") == ""
    assert urls.build_url("https://a/?z=1", "/jportal/", {"query": "*", "b": " ", "quelle": "x y"}) == "https://a/jportal/?quelle=x+y&query=%2A"


SIEHE = "Siehe § 2 BGB und Art. 3 GG."
REFS = [
    (SIEHE, "", ["BGB", "BGB § 2", "GG", "GG Art. 3"]),
    ("Nach §§ 535, 536 BGB i. V. m. § 280 Abs. 1 gilt dies.", "", ["BGB", "BGB § 535", "BGB § 536", "BGB § 280 Abs. 1"]),
    ("§ 1 gilt.", "ZPO", ["ZPO § 1"]),
    ("§ 1 gilt.", "", ["UNSPECIFIED § 1"]),
    ("Start 5", "", ["UNSPECIFIED Art. 5"]),
    ("Artikel 3", "", []),
    ("§ 5. Dann § 6, BGB und § 7 S. 2", "", ["UNSPECIFIED § 5", "BGB", "BGB § 6", "BGB § 7 S. 2"]),
    ("§ 1 sagt: §§ 2, 3 ZPO", "", ["ZPO", "ZPO § 2", "ZPO § 3", "ZPO § 1"]),
    ("im Strafgesetzbuch § 211", "", ["STGB", "STGB § 211"]),
    ("§§ 1, 2 und 3 sowie 4 BGB", "", ["UNSPECIFIED § 1", "UNSPECIFIED § 2", "UNSPECIFIED § 3"]),
    ("StGB § 1", "", ["GB", "GB § 1"]),
]


@pytest.mark.parametrize("given_, law, want", REFS)
def test_references(spark, given_, law, want):
    assert [t for _, t in citations.references_of(given_, law)] == want
    assert [r.target for r in one(spark, citations.references("v", F.lit(law)), v=given_)] == want


CHAINS = [
    ("§ 1 BGB", []),
    ("§ 1 i. V. m. § 2 und § 3 BGB", [("UNSPECIFIED § 1", "UNSPECIFIED § 2"), ("UNSPECIFIED § 1", "BGB § 3")]),
    ("§ 1 in Verbindung mit § 2, § 3", [("UNSPECIFIED § 1", "UNSPECIFIED § 2"), ("UNSPECIFIED § 1", "UNSPECIFIED § 3")]),
    ("§ 1 ivm § 2 bzw. § 3", [("UNSPECIFIED § 1", "UNSPECIFIED § 2")]),
    ("§ 1 gem. § 2", [("UNSPECIFIED § 1", "UNSPECIFIED § 2")]),
    ("§ 1 gemäß § 2", []),
    ("§ 1 und § 2", []),
    ("§ 1 i. V. m. § 1", []),
]


@pytest.mark.parametrize("given_, want", CHAINS)
def test_chains(spark, given_, want):
    assert [tuple(c) for c in one(spark, citations.chains("v"), v=given_)] == want


def test_extended_connectors(spark):
    assert len(one(spark, citations.chains("v", extended_connectors=True), v="§ 1 gemäß § 2")) == 1


def test_null_and_empty_texts(spark):
    rows = spark.createDataFrame([(None,), ("",), (SIEHE,)], "v string")
    assert [len(r.r) for r in rows.select(citations.references("v").alias("r")).collect()] == [0, 0, 4]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="§ 0123Art.,BGBundiVm()ä\n", max_size=120))
def test_references_are_distinct_and_complete(given_):
    found = citations.references_of(given_, "")
    assert len(found) == len(set(found))
    assert all(t and (k == "law") == (" " not in t) for k, t in found)
    assert all(a != b for a, b in citations.chains_of(given_, ""))
