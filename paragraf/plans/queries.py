"""The queries over the given tables, each with the SQL that says the same.

The tables hold no legal text, so those queries make it of their columns, by fixed rules, and the SQL says what has to
be found in it. Each reads its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citations, dates, text, urls
from ..operators import export, graph, ingest, parse, store, vector
from ..sources import http, portals

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of one task at most, about, where each row becomes many.
SPREAD_ROWS = 100_000


def _spread(df: DataFrame) -> DataFrame:
    """Before costly Python: a table of fewer splits than there are cores, or than hold SPREAD_ROWS each, is spread over so many; others stay as they are."""
    parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // SPREAD_ROWS))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Vectors

_ASKED = [((i * 37) % 11 - 5) / 10 for i in range(64)]


@_query(f"""SELECT vec_id, label, round(distance, 6) AS distance FROM (SELECT vec_id, label, list_cosine_distance(embedding::DOUBLE[], {_ASKED}::DOUBLE[]) AS distance FROM embeddings)
ORDER BY distance, vec_id LIMIT 10""")
def similar_chunks_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = vector.similar(_table(spark, sf_dir, "embeddings"), _ASKED, 10, keys=("vec_id",))
    return near.select("vec_id", "label", F.round("distance", 6).alias("distance"))


@_query("""SELECT query_id, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance FROM (
  SELECT a.vec_id AS query_id, list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS distance, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), b.vec_id) AS rank
  FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rank <= 5""")
def similar_chunks_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    near = vector.similar_to_all(rows, 5, queries=rows.where("vec_id % 50 = 0"))
    return near.select("query_id", "rank", F.round("distance", 6).alias("distance"))


# Citations

_LINE = """CASE l_linenumber % 4 WHEN 0 THEN concat('Nach § ', n, ' Abs. ', a, ' BGB gilt dies.') WHEN 1 THEN concat('Gemaess Art. ', n, ' GG ist dies erlaubt.')
  WHEN 2 THEN concat('Siehe §§ ', n, ', ', m, ' und ', k, ' ZPO.') ELSE concat('Die Frist des § ', n, ' wird nicht verlängert.') END"""
_NUMBERS = "l_linenumber, l_partkey % 900 + 1 AS n, l_suppkey % 90 + 901 AS m, l_linenumber + 1000 AS k, l_suppkey % 5 + 1 AS a"
_EXPECTED = """
  SELECT 'law' AS type, CASE kind WHEN 0 THEN 'BGB' WHEN 1 THEN 'GG' WHEN 2 THEN 'ZPO' END AS target FROM lines WHERE kind < 3
  UNION ALL SELECT 'paragraph', 'BGB § ' || n || ' Abs. ' || a FROM lines WHERE kind = 0
  UNION ALL SELECT 'article', 'GG Art. ' || n FROM lines WHERE kind = 1
  UNION ALL SELECT 'paragraph', 'ZPO § ' || unnest([n, m, k]) FROM lines WHERE kind = 2
  UNION ALL SELECT 'paragraph', 'UNSPECIFIED § ' || n FROM lines WHERE kind = 3"""


def cited_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sentence with citations for each line item."""
    return _spread(_table(spark, sf_dir, "lineitem")).selectExpr(*_NUMBERS.split(", ")).selectExpr("l_linenumber", f"{_LINE} AS text")


@_query(f"""WITH lines AS (SELECT l_linenumber % 4 AS kind, * FROM (SELECT {_NUMBERS} FROM lineitem)), found AS ({_EXPECTED})
SELECT type, target, count(*) AS citations FROM found GROUP BY type, target""")
def norm_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cited_lines(spark, sf_dir).select(F.explode(citations.references("text")).alias("r"))
    return found.groupBy("r.type", "r.target").agg(F.count("*").alias("citations"))


@_query("""SELECT o_orderkey, CAST(pos AS INTEGER) AS pos, target FROM (
  SELECT o_orderkey, unnest(range(4)) AS pos, unnest(['STGB', 'STGB § ' || (o_orderkey % 400 + 1), 'STGB § ' || (o_orderkey % 400 + 1001), 'STGB § ' || (o_custkey % 90 + 2001) || 'a']) AS target FROM orders)""")
def norm_references_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.expr("concat('Im Strafgesetzbuch regeln dies §§ ', o_orderkey % 400 + 1, ', ', o_orderkey % 400 + 1001, ' oder ', o_custkey % 90 + 2001, 'a abschließend.')")
    # The law is named by its title near by, which references carry in capitals.
    orders = _spread(_table(spark, sf_dir, "orders")).select("o_orderkey", made.alias("text"))
    return orders.select("o_orderkey", F.posexplode(citations.references("text")).alias("pos", "r")).select("o_orderkey", "pos", "r.target")


_BETWEEN = "CASE o_orderkey % 6 WHEN 0 THEN ' i. V. m. ' WHEN 1 THEN ' in Verbindung mit ' WHEN 2 THEN ' ivm ' WHEN 3 THEN ' nach Maßgabe von ' WHEN 4 THEN ' und ' ELSE ', ' END"


@_query("""SELECT o_orderkey, 'UNSPECIFIED § ' || (o_orderkey % 300 + 1) AS source, unnest(['UNSPECIFIED § ' || (o_custkey % 300 + 301), 'VWGO § ' || (o_custkey % 300 + 601)]) AS target
FROM orders WHERE o_orderkey % 6 < 4""")
def norm_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.expr(f"concat('§ ', o_orderkey % 300 + 1, {_BETWEEN}, '§ ', o_custkey % 300 + 301, ' und § ', o_custkey % 300 + 601, ' VWGO')")
    orders = _spread(_table(spark, sf_dir, "orders")).select("o_orderkey", made.alias("text"))
    return orders.select("o_orderkey", F.explode(citations.chains("text")).alias("c")).select("o_orderkey", "c.source", "c.target")


# Dates and versions


@_query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 5 THEN date_trunc('day', o_orderdate)::TIMESTAMP END AS at FROM orders""")
def date_loose(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = "o_orderdate"
    made = F.expr(f"CASE o_orderkey % 7 WHEN 0 THEN date_format({d}, 'yyyy-MM-dd') WHEN 1 THEN date_format({d}, 'dd.MM.yyyy') WHEN 2 THEN concat(' vom ', date_format({d}, 'd.M.yyyy'), ' an, nicht ab 01.01.1970') WHEN 3 THEN date_format({d}, 'yyyyMMdd') WHEN 4 THEN date_format({d}, \"yyyy-MM-dd'T'00:00:00'Z'\") WHEN 5 THEN 'ohne Datum' ELSE '31.02.2020' END")
    return _table(spark, sf_dir, "orders").select("o_orderkey", dates.date_loose(made).alias("at"))


_RANGE = "CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END AS a, CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate + INTERVAL 1 DAY * (o_custkey % 21 - 10) END AS b, o_orderdate - INTERVAL 1 DAY AS c, CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate + INTERVAL 1 DAY * (o_orderkey % 5 - 2) END AS d"


@_query(f"""SELECT o_orderkey, s AS effective_from, CASE WHEN s <= e OR e IS NULL THEN e WHEN s <= d THEN d END AS effective_to FROM (SELECT o_orderkey, coalesce(a, c) AS s, coalesce(b, d) AS e, d FROM (SELECT o_orderkey, {_RANGE} FROM orders))""")
def effective_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", *_RANGE.split(", "))
    start, end = dates.resolved_range(F.col("a"), F.col("b"), F.col("c"), F.col("d"))
    return rows.select("o_orderkey", start.alias("effective_from"), end.alias("effective_to"))


_FROM = "CASE WHEN o_orderkey % 10 > 0 THEN o_orderdate END AS valid_from"
_TO = "CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate + INTERVAL 1 DAY * (o_orderkey % 400 - 50) END AS valid_to"
_WINDOWS = f"""kept AS (SELECT DISTINCT o_custkey, valid_from, valid_to FROM (SELECT o_custkey, {_FROM}, {_TO} FROM orders) WHERE valid_from IS NULL OR valid_to IS NULL OR valid_from <= valid_to),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY valid_from NULLS FIRST, valid_to NULLS LAST) - 1 AS INTEGER) AS version_index FROM kept)"""


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_custkey, versions: the windows that a customer's orders give, in order."""
    rows = _table(spark, sf_dir, "orders").selectExpr("o_custkey", _FROM, _TO)
    return rows.groupBy("o_custkey").agg(dates.normal_versions(F.collect_list(F.struct("valid_from", "valid_to"))).alias("versions"))


@_query(f"WITH {_WINDOWS} SELECT o_custkey, version_index, valid_from, valid_to FROM placed")
def versions_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows(spark, sf_dir).select("o_custkey", F.posexplode("versions").alias("version_index", "v")).select("o_custkey", "version_index", "v.*")


@_query(f"""WITH {_WINDOWS}, day AS (SELECT unnest(generate_series(TIMESTAMP '1995-06-01', TIMESTAMP '2001-06-01', INTERVAL 1 YEAR)) AS d)
SELECT o_custkey, d AS "at", min(version_index) AS version_index FROM placed JOIN day ON (valid_from IS NULL OR valid_from <= d) AND (valid_to IS NULL OR valid_to >= d) GROUP BY o_custkey, d""")
def version_at_stichtag(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = F.sequence(F.lit("1995-06-01").cast("timestamp"), F.lit("2001-06-01").cast("timestamp"), F.expr("INTERVAL 1 YEAR"))
    asked = _windows(spark, sf_dir).select("o_custkey", "versions", F.explode(days).alias("at"))
    return asked.select("o_custkey", "at", dates.version_index_at(F.col("versions"), F.col("at")).alias("version_index")).where("version_index IS NOT NULL")


# Store


@_query("""SELECT page_id, CASE WHEN page_id % 3 > 0 THEN 'p-' || page_id WHEN page_id % 2 > 0 THEN 'doc-' || substr(sha1(url), 1, 16) ELSE 'doc-' || substr(sha1('Title ' || page_id), 1, 16) END AS id FROM pages""")
def persistable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.expr("if(page_id % 3 > 0, concat(' p-', page_id, ' '), ' ')"), F.expr("if(page_id % 2 > 0, url, NULL)"), F.expr("concat('Title ', page_id)")
    return _table(spark, sf_dir, "pages").select("page_id", store.persistable_id(*made).alias("id"))


@_query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def doc_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", F.struct("ts", "event_id").alias("seq"))
    late = F.col("seq.ts") >= F.lit("2024-01-16").cast("timestamp")
    stored = store.last_of_each(events.where(~late), ["user_id"], "seq")
    return store.upserted(stored, events.where(late), ["user_id"], "seq")


@_query(r"""SELECT doc_id, CAST(section_index AS INTEGER) AS section_index, md5(regexp_replace(line, '^[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g')) AS content
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS section_index FROM documents)""")
def section_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("section_index", "line"))
    return lines.select("doc_id", "section_index", F.md5(text.trimmed("line")).alias("content"))


# Portals and pages


@_query(r"""SELECT page_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^http://', 'https://') AS url, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host,
  CASE WHEN regexp_extract(url, '[?&]ref=([^&#]*)', 1) <> '' THEN 'ref-' || regexp_extract(url, '[?&]ref=([^&#]*)', 1) WHEN regexp_extract(url, '[?&]page=([^&#]*)', 1) <> '' THEN 'page-' || regexp_extract(url, '[?&]page=([^&#]*)', 1)
  ELSE regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]+)/*$', 1) END AS id FROM pages""")
def portal_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return _table(spark, sf_dir, "pages").select("page_id", urls.https(urls.without_fragment(url)).alias("url"), urls.host(url).alias("host"), urls.url_id(url, ("ref", "page")).alias("id"))


_ANY_LINK = portals.Portal("page", "", "", (), ("example",), ("/",), (), ("ref",))


@_query(r"""WITH hits AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS base, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) AS a, generate_subscripts(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>'), 1) AS k FROM pages),
found AS (SELECT page_id, k, base || '/' || replace(url_encode(regexp_extract(a, '"/([^"]*)"', 1)), '%2C', ',') AS url, regexp_extract(a, '"/([^"]*)"', 1) AS id, regexp_extract(a, '>([^<]*)<', 1) AS title FROM hits),
firsts AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY k) = 1)
SELECT page_id AS page, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) AS INTEGER) AS pos, id, url, title FROM firsts""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portals.listed(_spread(_table(spark, sf_dir, "pages").select("page_id", "url", "html")), _ANY_LINK, "html", "url")


@_query(r"""SELECT page_id, trim(replace(replace(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS title, 'law' AS type FROM pages""")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = parse.html_document("html")
    return _spread(_table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", doc.alias("d")).select("page_id", "d.title", "d.type")


@_query(r"""SELECT p_partkey, 'p' || p_partkey AS id, p_name AS title, p_brand AS short_title, CASE lower(p_type) WHEN 'standard' THEN 'law' WHEN 'economy' THEN 'order' ELSE 'unknown' END AS type, TIMESTAMP '2020-01-01' + INTERVAL 1 DAY * (p_partkey % 365) AS effective_from,
  CASE WHEN p_partkey % 3 > 0 THEN TIMESTAMP '2021-06-30' END AS effective_to, 'S' || p_size AS identifier, 'Teil & ' || p_type AS heading FROM part""")
def xml_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.expr("""concat('<law id="p', p_partkey, '"><title> ', p_name, ' </title><shortTitle>', p_brand, '</shortTitle><jurisdiction>DE</jurisdiction><type>', decode(p_type, 'STANDARD', ' Law', 'ECONOMY', 'order', p_type), '</type><effectiveFrom>',
        date_format(date_add(DATE'2020-01-01', cast(p_partkey % 365 AS INT)), if(p_partkey % 2 = 0, 'dd.MM.yyyy', 'yyyy-MM-dd')), '</effectiveFrom><effectiveTo>', if(p_partkey % 3 > 0, '20210630', '2019-01-01'), '</effectiveTo><sections><section id="S', p_size, '"><heading>Teil &amp; ', p_type, '</heading><content>x</content></section></sections></law>')""")
    docs = _spread(_table(spark, sf_dir, "part")).select("p_partkey", parse.xml_document(made).alias("d"))
    return docs.select("p_partkey", "d.id", "d.title", "d.short_title", "d.type", "d.effective_from", "d.effective_to", F.get("d.sections", F.lit(0))["identifier"].alias("identifier"), F.get("d.sections", F.lit(0))["heading"].alias("heading"))


@_query(r"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE regexp_replace(p_type || ' ' || p_size, '\s+', ' ', 'g') END AS short_title FROM part""")
def short_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.expr("if(p_partkey % 3 = 0, concat(p_name, ' (§ 1)'), concat(p_name, ' (§ 1) (', p_type, '  ', p_size, ') (zweite)'))")
    return _table(spark, sf_dir, "part").select("p_partkey", parse.short_title(made).alias("short_title"))


@_query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')) AS token FROM documents""")
def node_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.md5(text.node_token("text")).alias("token"))


@_query("""SELECT p_partkey, CAST(pos - 1 AS INTEGER) AS pos, 'http://www.gesetze-im-internet.de/p' || p_partkey || '/xml.zip' AS link FROM (SELECT p_partkey, 1 AS pos FROM part)""")
def federal_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    link = "concat('http://www.gesetze-im-internet.de/p', p_partkey, '/xml.zip')"
    made = F.expr(f"concat('<items><item><title> ', p_name, ' </title><link>', {link}, '</link></item><item><title>ohne</title><link>https://x/</link></item></items>')")
    found = portals.federal_toc(_table(spark, sf_dir, "part").select(made.alias("payload")))
    return found.select(F.expr("cast(substring(id, 2) AS BIGINT)").alias("p_partkey"), "pos", F.regexp_replace("url", "^https:", "http:").alias("link"))


# Graph

_ORDER = "o_orderkey, o_custkey, o_orderkey % 4 AS kind, o_custkey % 900 + 1 AS n, o_orderkey % 90 + 901 AS m"


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document with two sections for each order, cited and chained."""
    rows = _spread(_table(spark, sf_dir, "orders").selectExpr(*_ORDER.split(", ")))
    first = "CASE kind WHEN 0 THEN concat('Nach § ', n, ' BGB gilt dies.') WHEN 1 THEN concat('Gemaess Art. ', n, ' GG und § ', m, ' ZPO.') WHEN 2 THEN concat('Siehe §§ ', n, ', ', m, ' ZPO.') ELSE concat('§ ', n, ' i. V. m. § ', m, ' VWGO') END"
    content = F.array(F.expr(first), F.lit("Das Grundgesetz gilt."))
    parts = F.transform(content, lambda c, i: F.struct(F.concat(F.lit("§ "), (i + 1).cast("string")).alias("identifier"), F.lit("").alias("heading"), c.alias("content")))
    cited = rows.withColumn("found", parse.cite_all(F.transform(content, lambda c: F.struct(c.alias("text"), F.lit("").alias("law")))))
    sections = F.transform(parts, lambda s, i: F.struct(s["identifier"].alias("identifier"), s["heading"].alias("heading"), s["content"].alias("content"), F.get("found", i)["refs"].alias("refs"), F.get("found", i)["norm_chains"].alias("norm_chains")))
    replaced = F.when(F.col("kind") == 0, F.create_map(F.lit("ersetzt"), F.concat(F.lit("Alt "), "o_custkey", F.lit("; alt "), "o_custkey"))).otherwise(F.create_map().cast("map<string,string>"))
    return cited.select(F.concat(F.lit("O-"), "o_orderkey").alias("id"), F.concat(F.lit("Order "), "o_orderkey").alias("title"), F.lit("").alias("short_title"), F.lit("DE").alias("jurisdiction"), F.when(F.col("kind") == 3, "ruling").otherwise("law").alias("type"), F.lit("").alias("source_url"), sections.alias("sections"), replaced.alias("metadata"))


_ORDERS = f"o AS (SELECT *, CASE WHEN kind = 3 THEN 'ruling:o-' ELSE 'law:o-' END || o_orderkey AS doc FROM (SELECT {_ORDER} FROM orders))"
_REFS = """refs AS (
  SELECT doc, 'law' AS type, CASE kind WHEN 0 THEN 'BGB' WHEN 1 THEN 'GG' WHEN 2 THEN 'ZPO' ELSE 'VWGO' END AS target FROM o
  UNION ALL SELECT doc, 'law', 'ZPO' FROM o WHERE kind = 1
  UNION ALL SELECT doc, 'paragraph', 'BGB § ' || n FROM o WHERE kind = 0
  UNION ALL SELECT doc, 'article', 'GG Art. ' || n FROM o WHERE kind = 1
  UNION ALL SELECT doc, 'paragraph', 'ZPO § ' || m FROM o WHERE kind IN (1, 2)
  UNION ALL SELECT doc, 'paragraph', 'ZPO § ' || n FROM o WHERE kind = 2
  UNION ALL SELECT doc, 'paragraph', 'UNSPECIFIED § ' || n FROM o WHERE kind = 3
  UNION ALL SELECT doc, 'paragraph', 'VWGO § ' || m FROM o WHERE kind = 3)"""
_TOKEN = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '-')"
_CITED = f"CASE type WHEN 'law' THEN 'law:' ELSE 'paragraph:' END || {_TOKEN.format('target')}"
_EDGES = f"""edges AS (
  SELECT 'paragraph:' || doc || ':' || s AS "from", doc AS "to", 'concretizes' AS type, 1.0 AS weight FROM o, (VALUES (1), (2)) AS x(s)
  UNION ALL SELECT 'paragraph:' || doc || ':1', {_CITED}, 'cites', 1.0 FROM refs
  UNION ALL SELECT 'paragraph:unspecified-' || n, 'paragraph:vwgo-' || m, 'references', 1.0 FROM o WHERE kind = 3
  UNION ALL SELECT doc, 'paragraph:alt-' || o_custkey, 'replaces', 1.0 FROM o WHERE kind = 0)"""


def _graph(spark: SparkSession, sf_dir: str) -> graph.Graph:
    return graph.build(order_documents(spark, sf_dir))


def _plain_edges(edges: DataFrame) -> DataFrame:
    return edges.select("from", "to", "type", "weight", F.coalesce(F.col("metadata")["reference_type"], F.lit("")).alias("reference_type"))


_WITH_EDGES = f"""WITH {_ORDERS}, {_REFS}, {_EDGES}, whole AS (SELECT "from", "to", type, CAST(sum(weight) AS DOUBLE) AS weight, CASE WHEN type <> 'cites' THEN '' WHEN "to" LIKE 'law:%' THEN 'law' WHEN "to" LIKE '%-art-%' THEN 'article' ELSE 'paragraph' END AS reference_type FROM edges GROUP BY ALL)"""


@_query(f"{_WITH_EDGES} SELECT * FROM whole")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_edges(_graph(spark, sf_dir).edges)


@_query(f"""WITH {_ORDERS}, {_REFS}, nodes AS (
  SELECT doc AS id, CASE WHEN kind = 3 THEN 'ruling' ELSE 'law' END AS type, 'Order ' || o_orderkey AS label, 'DE' AS jurisdiction, 'O-' || o_orderkey AS about FROM o
  UNION ALL SELECT 'paragraph:' || doc || ':' || s, 'paragraph', '§ ' || s, 'DE', doc FROM o, (VALUES (1), (2)) AS x(s)
  UNION ALL SELECT {_CITED}, CASE type WHEN 'law' THEN 'law' ELSE 'paragraph' END, target, '', '' FROM refs
  UNION ALL SELECT 'paragraph:alt-' || o_custkey, 'law', 'Alt ' || o_custkey, '', '' FROM o WHERE kind = 0)
SELECT DISTINCT * FROM nodes""")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    about = F.coalesce(F.col("metadata")["document_id"], F.col("metadata")["document_node_id"], F.lit(""))
    return _graph(spark, sf_dir).nodes.select("id", "type", "label", "jurisdiction", about.alias("about"))


@_query(f"""{_WITH_EDGES} SELECT * FROM whole WHERE "from" = 'paragraph:unspecified-7'""")
def graph_outgoing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_edges(_graph(spark, sf_dir).outgoing(" paragraph:unspecified-7 "))


@_query(f"""{_WITH_EDGES} SELECT * FROM whole WHERE "to" = 'law:bgb'""")
def graph_incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plain_edges(_graph(spark, sf_dir).incoming("law:bgb"))


@_query(f"""{_WITH_EDGES} SELECT "to" AS target, CAST(sum(weight) AS BIGINT) AS citations, count(*) AS sections FROM whole WHERE type = 'cites' GROUP BY "to\"""")
def most_cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    cites = graph.build(order_documents(spark, sf_dir), graph.Kinds(False, True, False, False), metadata=False).edges
    return cites.groupBy(F.col("to").alias("target")).agg(F.sum("weight").cast("bigint").alias("citations"), F.count("*").alias("sections")).orderBy(F.desc("citations"), "target")


@_query("""SELECT p_partkey, CAST(pos AS INTEGER) AS pos, target FROM (SELECT p_partkey, unnest(range(2)) AS pos, unnest([p_brand, p_name]) AS target FROM part WHERE p_partkey % 5 < 4)""")
def replaced_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.expr("concat(p_brand, ', ', upper(p_brand), ' ;| ', p_name, ';', p_name)")
    made = F.create_map(F.expr("decode(p_partkey % 5, 0, 'replaces', 1, 'ersetzt', 2, 'abloesung', 3, 'ablösung', 'other')"), value, F.lit("stand"), F.lit("x"))
    return _table(spark, sf_dir, "part").select("p_partkey", F.posexplode(graph.replaced_targets(made)).alias("pos", "target"))


# Ingest

_REF = "event_id AS pos, \nCASE WHEN event_id % 4 > 0 THEN concat('user-', user_id) ELSE ' ' END AS id, \nconcat('https://example.org/', event_id % 500) AS url, \nevent_type AS title"


@_query(f"""SELECT CASE WHEN trim(id) <> '' THEN id ELSE url END AS document_key, pos, url, title FROM (SELECT {_REF} FROM events) QUALIFY row_number() OVER (PARTITION BY CASE WHEN trim(id) <> '' THEN id ELSE url END ORDER BY pos) = 1""")
def unique_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _table(spark, sf_dir, "events").selectExpr(*_REF.split(", \n"))
    return ingest.unique_refs(refs).select("document_key", "pos", "url", "title")


@_query("""WITH last AS (SELECT user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CASE event_type WHEN 'purchase' THEN 'completed' ELSE 'failed' END DESC) = 1)
SELECT CAST(c_custkey AS VARCHAR) AS document_key FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM last WHERE event_type = 'purchase')""")
def pending_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    progress = _table(spark, sf_dir, "events").select(F.lit("portal").alias("source"), F.col("user_id").cast("string").alias("document_key"), F.when(F.col("event_type") == "purchase", "completed").otherwise("failed").alias("status"), F.lit("").alias("reason"), F.col("ts").alias("updated_at"))
    refs = _table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("document_key"))
    return ingest.pending(refs, progress, "portal")


@_query("""SELECT count(*) AS total_unique, count(*) FILTER (event_type = 'view') AS skipped_completed, count(*) FILTER (event_type IN ('click', 'purchase', 'signup')) AS total_fetched, count(*) FILTER (event_type = 'purchase') AS total_stored, count(*) FILTER (event_type IN ('error', 'signup')) AS total_failed,
  round(count(*) FILTER (event_type IN ('click', 'purchase', 'signup')) / count(*), 6) AS coverage FROM events""")
def completeness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    outcome = F.expr("decode(event_type, 'view', 'skipped', 'click', 'fetched', 'purchase', 'stored', 'signup', 'store_failed', 'fetch_failed')")
    counts = ingest.outcome_counts(_table(spark, sf_dir, "events").select(outcome.alias("outcome")))
    return counts.withColumn("coverage", F.when(F.col("total_unique") == 0, 1.0).otherwise(F.round(F.col("total_fetched") / F.col("total_unique"), 6)))


@_query("""SELECT event_id, event_id % 5 <> 0 OR event_id % 7 = 0 AS again, least(0.25 * pow(2, event_id % 8), 5.0) AS pause FROM events""")
def retry_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, error = F.expr("if(event_id % 5 = 0, 404, 503)"), F.expr("if(event_id % 7 = 0, 'timeout', NULL)")
    return _table(spark, sf_dir, "events").select("event_id", http.retry_column(status, error).alias("again"), http.backoff_column(F.expr("event_id % 8 + 1")).alias("pause"))


# Export


def _as_document(c: Callable[[str], Column]) -> list[Column]:
    empty = F.lit(None).cast("timestamp")
    return [F.concat(F.lit("d-"), c("doc_id")).alias("id"), F.lit("").alias("title"), F.lit("").alias("short_title"), c("lang").alias("jurisdiction"), F.lit("law").alias("type"), empty.alias("published_at"), empty.alias("effective_from"), empty.alias("effective_to"), c("source").alias("source_url"), F.array(F.struct(F.lit("").alias("identifier"), F.lit("").alias("heading"), c("text").alias("content"), F.array().cast("array<struct<type:string,target:string>>").alias("refs"), F.array().cast("array<struct<source:string,target:string>>").alias("norm_chains"))).alias("sections"), F.array().cast("array<struct<valid_from:timestamp,valid_to:timestamp>>").alias("versions"), F.create_map().cast("map<string,string>").alias("metadata")]


@_query(r"""SELECT '{"ID":"d-' || doc_id || '","Title":"","ShortTitle":"","Jurisdiction":' || to_json(lang) || ',"Type":"law","PublishedAt":null,"EffectiveFrom":null,"EffectiveTo":null,"SourceURL":' || to_json(source) || ',"Sections":[{"Identifier":"","Heading":"","Content":'
  || replace(replace(replace(to_json(text), '<', '\u003c'), '>', '\u003e'), '&', '\u0026') || ',"References":[],"NormChains":[]}],"Versions":[],"Metadata":{}}' AS line FROM documents""")
def documents_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(*_as_document(F.col))
    return export.document_lines(docs)
