"""More queries with their SQL: parsing of whole formats, stores, portals, exports and ingest runs, over generated input."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import citations, dates, text
from ..operators import export, graph, ingest, parse, store, vector
from ..sources import landing, portals
from .queries import _ASKED, _EDGES, _ORDER, _ORDERS, _REFS, _as_document, _query, _spread, _table, _WITH_EDGES, order_documents


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that executors share: below spark.checkpoint.dir, or where that is unset with a local master, a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.gettempdir()
    return f"{base.rstrip('/')}/paragraf-{name}-{uuid.uuid4().hex}"


# Markup

_FEDERAL = """concat('<dokumente><norm doknr="D', p_partkey, '"><metadaten><jurabk>G', p_partkey, '</jurabk><enbez>§ ', p_size, '</enbez><titel> Teil &amp; ', p_type, ' </titel><ausfertigung-datum>', if(p_partkey % 4 = 0, 'ohne', '1950-01-02'), '</ausfertigung-datum>',
  if(p_partkey % 2 = 0, '<inkrafttreten-datum>03.04.1951</inkrafttreten-datum>', ''), '<ausserkrafttreten>', if(p_partkey % 3 = 0, '19400101', '20991231'), '</ausserkrafttreten></metadaten><textdaten><text><Content><P>Siehe § ', p_size, ' BGB.</P><P>Zwei</P></Content></text></textdaten></norm><norm doknr="E"><metadaten><standangabe>1960-05-06</standangabe></metadaten></norm></dokumente>')"""
_FEDERAL_SQL = """SELECT p_partkey, 'G' || p_partkey AS title, 'DE-BUND' AS jurisdiction, CASE WHEN p_partkey % 4 = 0 THEN TIMESTAMP '1960-05-06' ELSE TIMESTAMP '1950-01-02' END AS published_at, CASE WHEN p_partkey % 2 = 0 THEN TIMESTAMP '1951-04-03' END AS effective_from,
  CASE WHEN p_partkey % 3 > 0 THEN TIMESTAMP '2099-12-31' WHEN p_partkey % 2 > 0 THEN TIMESTAMP '1940-01-01' END AS effective_to, 2 AS sections, '§ ' || p_size AS identifier, 'Teil & ' || p_type AS heading, 'Siehe § ' || p_size || ' BGB.' || chr(10) || 'Zwei' AS content, 'BGB|BGB § ' || p_size AS cited FROM part"""


def _federal_fields(rows: DataFrame) -> DataFrame:
    s = F.get("d.sections", F.lit(0))
    return rows.select("p_partkey", "d.title", "d.jurisdiction", "d.published_at", "d.effective_from", "d.effective_to", F.size("d.sections").alias("sections"), s["identifier"].alias("identifier"), s["heading"].alias("heading"), s["content"].alias("content"), F.array_join(F.transform(s["refs"], lambda r: r["target"]), "|").alias("cited"))


@_query(_FEDERAL_SQL)
def federal_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _federal_fields(_spread(_table(spark, sf_dir, "part")).select("p_partkey", parse.federal_document(F.expr(_FEDERAL)).alias("d")))


@_query(_FEDERAL_SQL)
def federal_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from ZIP archives whose first XML file counts."""

    @F.pandas_udf(BinaryType())
    def packed(laws: pd.Series) -> pd.Series:
        out = []
        for law in laws:
            raw = io.BytesIO()
            with zipfile.ZipFile(raw, "w") as z:
                for name, content in (("liesmich.txt", "x"), ("gesetz.XML", law), ("zweites.xml", "<x/>")):
                    z.writestr(name, content)
            out.append(raw.getvalue())
        return pd.Series(out, dtype=object)

    made = _spread(_table(spark, sf_dir, "part")).select("p_partkey", packed(F.expr(_FEDERAL)).alias("zip"))
    return _federal_fields(made.select("p_partkey", parse.federal_document(landing.unzipped("zip")).alias("d")))


_PAGE = """concat('<html><head><title>T</title>', if(p_partkey % 2 = 0, '<meta name="datePublished" content="2020-01-02"><meta name="effectiveFrom" content="03.04.2021">', ''), if(p_partkey % 5 = 0, '<meta property="effectiveTo" content="20230405">', ''), '</head><body><h1> ', p_name, ' (Br ', p_size, ') </h1><section id="', p_size, '"><h2>§ ', p_size, '</h2><p>',
  if(p_partkey % 3 = 0, 'Verkuendet: 01.02.2000. Inkrafttreten: 2000-03-04. Ausserkrafttreten: 20991231.', 'Siehe § 1 BauO NRW i. V. m. Art. 3 GG.'), '</p></section><![unbekannt[x]]></body></html>')"""
_PAGE_DATES = """CASE WHEN p_partkey % 2 = 0 THEN TIMESTAMP '2020-01-02' WHEN p_partkey % 5 = 0 THEN TIMESTAMP '2023-04-05' WHEN p_partkey % 3 = 0 THEN TIMESTAMP '2000-02-01' END AS published_at,
  CASE WHEN p_partkey % 2 = 0 THEN TIMESTAMP '2021-04-03' WHEN p_partkey % 3 = 0 THEN TIMESTAMP '2000-03-04' END AS effective_from, CASE WHEN p_partkey % 5 = 0 THEN TIMESTAMP '2023-04-05' WHEN p_partkey % 3 = 0 THEN TIMESTAMP '2099-12-31' END AS effective_to"""


@_query(f"SELECT p_partkey, p_name || ' (Br ' || p_size || ')' AS title, {_PAGE_DATES}, CAST(p_size AS VARCHAR) AS identifier, '§ ' || p_size AS heading FROM part")
def page_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spread(_table(spark, sf_dir, "part")).select("p_partkey", parse.html_document(F.expr(_PAGE)).alias("d"))
    s = F.get("d.sections", F.lit(0))
    return docs.select("p_partkey", "d.title", "d.published_at", "d.effective_from", "d.effective_to", s["identifier"].alias("identifier"), s["heading"].alias("heading"))


@_query("""SELECT p_partkey, 'Br ' || p_size AS short_title, 'DE-NW' AS jurisdiction, 'BR ' || p_size || ' § ' || p_size || CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_size = 1 THEN '|GG|GG Art. 3' ELSE '|BR ' || p_size || ' § 1|GG|GG Art. 3' END AS cited FROM part""")
def portal_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spread(_table(spark, sf_dir, "part")).select("p_partkey", parse.portal_document(F.expr(_PAGE), "DE-NW", 20).alias("d"))
    cited = F.array_join(F.transform(F.get("d.sections", F.lit(0))["refs"], lambda r: r["target"]), "|")
    return docs.select("p_partkey", "d.short_title", "d.jurisdiction", cited.alias("cited"))


@_query("""SELECT l_orderkey, l_linenumber, CAST(pos AS INTEGER) AS pos, target FROM (SELECT l_orderkey, l_linenumber, unnest(range(3)) AS pos, unnest(['VWGO', CASE l_linenumber % 2 WHEN 0 THEN 'VWGO § ' ELSE 'VWGO Art. ' END || n, 'VWGO § ' || m || ' Abs. 2 S. 1']) AS target
FROM (SELECT *, l_partkey % 900 + 1 AS n, l_suppkey % 90 + 901 AS m FROM lineitem))""")
def prefix_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The law before the sign, which a later citation without one goes on with."""
    made = F.expr("concat('Es gilt VWGO', if(l_linenumber % 2 = 0, ' § ', ' Art. '), l_partkey % 900 + 1, '. ', repeat('Das ist ein langer Satz ohne Gesetz. ', 4), 'Auch § ', l_suppkey % 90 + 901, ' Abs. 2 S. 1 gilt hier weiter.')")
    rows = _spread(_table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", made.alias("text"))
    return rows.select("l_orderkey", "l_linenumber", F.posexplode(citations.references("text")).alias("pos", "r")).select("l_orderkey", "l_linenumber", "pos", "r.target")


# Versions and texts

_DATED = "CASE WHEN o_orderkey % 3 > 0 THEN o_orderdate END AS f, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate - INTERVAL 10 DAY END AS p, CASE WHEN o_orderkey % 2 > 0 THEN o_orderdate + INTERVAL 1 DAY * (o_custkey % 9 - 2) END AS t"


@_query(f"""WITH d AS (SELECT o_orderkey, coalesce(f, p) AS s, f, t FROM (SELECT o_orderkey, {_DATED} FROM orders)), w AS (SELECT *, (s IS NOT NULL OR t IS NOT NULL) AND (s IS NULL OR t IS NULL OR s <= t) AS kept FROM d)
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 2 WHEN kept THEN 1 ELSE 0 END AS windows, CASE WHEN o_orderkey % 7 = 0 THEN coalesce(f, TIMESTAMP '1990-01-01') WHEN kept THEN coalesce(f, s) ELSE f END AS effective_from, CASE WHEN o_orderkey % 7 = 0 THEN coalesce(t, TIMESTAMP '1992-01-01') ELSE t END AS effective_to FROM w""")
def ensured_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", *_DATED.split(", CASE")[:1], *[f"CASE{x}" for x in _DATED.split(", CASE")[1:]])
    day = lambda d: F.lit(d).cast("timestamp")
    window = lambda a, b: F.struct(day(a).alias("valid_from"), day(b).alias("valid_to"))
    own = F.when(F.col("o_orderkey") % 7 == 0, F.array(window("1991-01-01", "1992-01-01"), window("1990-01-01", "1990-12-31"), window("1995-01-01", "1994-01-01"), window("1991-01-01", "1992-01-01")))
    rows = rows.withColumn("v", dates.ensured_versions(own, F.col("f"), F.col("p"), F.col("t")))
    start, end = dates.filled_range(F.col("v"), F.col("f"), F.col("t"))
    return rows.select("o_orderkey", F.size("v").alias("windows"), start.alias("effective_from"), end.alias("effective_to"))


@_query(r"""SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'unknown') AS part, rtrim(left(url, 12)) AS cut, 'a b ' || page_id AS collapsed FROM pages""")
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = F.concat(F.lit("  a\n\t b  "), F.col("page_id").cast("string"), F.lit("  "))
    return _table(spark, sf_dir, "pages").select("page_id", text.path_part("url").alias("part"), text.cut_bytes(F.col("url"), 12).alias("cut"), text.collapsed(made).alias("collapsed"))


# Portals


@_query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', 'juris-{n}', '{j}', 'https://{d}/jportal/?quelle=jlink&query=%2A&showdoccase=1')" for n, j, d in (
    ("baden-wuerttemberg", "DE-BW", "www.landesrecht-bw.de"), ("berlin", "DE-BE", "gesetze.berlin.de"), ("hessen", "DE-HE", "www.rv.hessenrecht.hessen.de"), ("mecklenburg-vorpommern", "DE-MV", "www.landesrecht-mv.de"),
    ("rheinland-pfalz", "DE-RP", "landesrecht.rlp.de"), ("sachsen-anhalt", "DE-ST", "www.landesrecht.sachsen-anhalt.de"), ("schleswig-holstein", "DE-SH", "www.gesetze-rechtsprechung.sh.juris.de"), ("thueringen", "DE-TH", "landesrecht.thueringen.de"),
)) + ") AS p(name, source, jurisdiction, list_url)")
def portal_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(n, portals.source_name(p := make()), p.jurisdiction, p.list_url) for n, make in portals.presets().items()]
    return spark.createDataFrame(rows, "name STRING, source STRING, jurisdiction STRING, list_url STRING")


_MADE_URL = "'https://' || CASE o_orderkey % 5 WHEN 0 THEN 'recht.nrw.de/lmi/owa/br_text?v_id=' WHEN 1 THEN 'www.gesetze-bayern.de/Content/Document/' WHEN 2 THEN 'gesetze.berlin.de/jportal/?doc.id=' WHEN 3 THEN 'fremd.example/lmi/?v_id=' ELSE 'recht.nrw.de/start/' END || o_custkey"


@_query(f"""SELECT o_orderkey, o_orderkey % 5 = 0 AS nrw, o_orderkey % 5 = 1 AS bayern, o_orderkey % 5 = 2 AS berlin,
  CASE o_orderkey % 5 WHEN 0 THEN 'v_id-' || o_custkey WHEN 3 THEN 'v_id-' || o_custkey WHEN 2 THEN '' ELSE CAST(o_custkey AS VARCHAR) END AS nrw_id, CASE o_orderkey % 5 WHEN 2 THEN 'doc_id-' || o_custkey ELSE '' END AS berlin_id
FROM (SELECT o_orderkey, o_custkey, {_MADE_URL} AS url FROM orders)""")
def portal_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which portal's documents URLs are, and their ids there."""
    url, sites = F.col("url"), portals.PORTALS
    rows = _table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey", f"{_MADE_URL} AS url")
    tests = [portals.is_document_url(url, sites[n]).alias(n) for n in ("nrw", "bayern", "berlin")]
    ids = [F.when(F.expr("o_orderkey % 5 <> 2") if n == "nrw" else F.expr("o_orderkey % 5 = 2"), portals.document_id(url, sites[n])).otherwise("").alias(f"{n}_id") for n in ("nrw", "berlin")]
    return rows.select("o_orderkey", *tests, *ids)


# Stores


def _named_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(F.concat(F.lit("Z"), (i + 1).cast("string")).alias("identifier"), F.lit("").alias("heading"), x.alias("content"), F.array().cast("array<struct<type:string,target:string>>").alias("refs"), F.array().cast("array<struct<source:string,target:string>>").alias("norm_chains")))
    return _table(spark, sf_dir, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL").select(*_as_document(F.col), lines.alias("_lines")).drop("sections").withColumnRenamed("_lines", "sections")


_TRIM = r"regexp_replace(line, '^[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+|[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+$', '', 'g')"


@_query(rf"""SELECT document_id, CAST(section_index AS INTEGER) AS section_index, identifier, md5({_TRIM}) AS content, refs FROM (
  SELECT 'd-' || doc_id AS document_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS section_index, 'Z' || generate_subscripts(string_split(text, chr(10)), 1) AS identifier, '[]' AS refs FROM documents WHERE doc_id % 3 > 0
  UNION ALL SELECT 'd-' || doc_id, 'neu', 0, 'N', '[]' FROM documents WHERE doc_id % 3 = 0)""")
def stored_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections after two upserts through the store, the second of which replaces every third document."""
    kept, docs = store.Store(spark, _folder(spark, "store")), _named_documents(spark, sf_dir)
    kept.upsert_documents(docs, "eins")
    new = F.array(F.struct(F.lit("N").alias("identifier"), F.lit("").alias("heading"), F.lit(" neu ").alias("content"), F.array().cast("array<struct<type:string,target:string>>").alias("refs"), F.array().cast("array<struct<source:string,target:string>>").alias("norm_chains")))
    kept.upsert_documents(docs.where("cast(substring(id, 3) AS BIGINT) % 3 = 0").withColumn("sections", new), "zwei")
    return kept.read("sections").select("document_id", "section_index", "identifier", F.md5("content").alias("content"), "refs")


@_query("""SELECT 'v-' || vec_id % 100 AS document_id, CAST(vec_id % 7 AS INTEGER) AS section_index, CAST(0 AS INTEGER) AS chunk_index, max(vec_id) AS vec_id, 64 AS dims FROM embeddings GROUP BY ALL""")
def stored_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings after upserts of rows whose keys repeat: the last of each."""
    kept = store.Store(spark, _folder(spark, "store"))
    rows = _table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v-"), (F.col("vec_id") % 100).cast("string")).alias("document_id"), (F.col("vec_id") % 7).alias("section_index"), F.lit(0).alias("chunk_index"), F.col("vec_id").cast("string").alias("content"), "embedding", F.create_map(F.lit("k"), F.lit("v")).alias("metadata"), F.col("vec_id").alias("o"))
    low = rows.agg(F.percentile_approx("o", 0.5)).first()[0] or 0
    kept.upsert_embeddings(rows.where(F.col("o") <= low), "o")
    kept.upsert_embeddings(rows.where(F.col("o") > low), "o")
    return kept.read("embeddings").select("document_id", "section_index", "chunk_index", F.col("content").cast("bigint").alias("vec_id"), F.size("embedding").alias("dims"))


@_query(f"""SELECT vec_id, label, round(distance, 6) AS distance FROM (SELECT vec_id, label, list_cosine_distance(embedding::DOUBLE[], {_ASKED}::DOUBLE[]) AS distance FROM embeddings)
ORDER BY distance, vec_id LIMIT 10""")
def cells_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k through the index of cells, all of them looked at; fewer are approximate (tests hold their recall)."""
    rows = _table(spark, sf_dir, "embeddings")
    cells = vector.fit_cells(rows, 8)
    near = vector.similar_in_cells(cells.indexed(rows), _ASKED, cells, 8, 10, keys=("vec_id",))
    return near.select("vec_id", "label", F.round("distance", 6).alias("distance"))


# Exports


@_query(f"""{_WITH_EDGES} SELECT '{{"From":"' || "from" || '","To":"' || "to" || '","Type":"' || type || '","Weight":' || CAST(weight AS BIGINT) || ',"Metadata":' || CASE WHEN reference_type = '' THEN 'null' ELSE '{{"reference_type":"' || reference_type || '"}}' END || '}}' AS line FROM whole""")
def graph_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.edge_lines(graph.build(order_documents(spark, sf_dir)))


@_query(f"""WITH {_ORDERS}, {_REFS}, {_EDGES} SELECT "from", "to", type, CAST(sum(weight) AS DOUBLE) AS weight FROM edges WHERE "from" IN (SELECT 'ruling:o-' || o_orderkey FROM orders) OR "from" IN (SELECT 'law:o-' || o_orderkey FROM orders) GROUP BY ALL""")
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of many nodes at once: those that leave documents."""
    built = graph.build(order_documents(spark, sf_dir))
    return built.neighbours(built.documents).select("from", "to", "type", "weight")


# Ingest

_INGESTED = "CASE p_partkey % 10 WHEN 0 THEN 404 ELSE 200 END"


class _Portal:
    """A fetcher that answers from the URL alone: what ends in 0 isn't there, what ends in 7 can't be parsed."""

    def __call__(self, url: str) -> tuple[int, bytes]:
        key = url.rsplit("/", 1)[-1]
        if key.endswith("0"):
            return 404, b""
        return 200, b"kaputt" if key.endswith("7") else f"<law id='l{key}'><title>Gesetz {key}</title><effectiveFrom>2020-01-02</effectiveFrom><sections><section id='1'><content>Inhalt</content></section></sections></law>".encode()


def _ingested(spark: SparkSession, sf_dir: str) -> tuple[ingest.Report, store.Store]:
    rows = _table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("l"), "p_partkey").alias("id"), F.concat(F.lit("https://portal.example/"), "p_partkey").alias("url"), F.col("p_name").alias("title"))
    refs = rows.select(F.col("p_partkey").alias("pos"), "id", "url", "title").unionByName(rows.where("p_partkey % 4 = 0").select((F.col("p_partkey") + 10_000_000).alias("pos"), "id", "url", "title"))
    kept, base = store.Store(spark, _folder(spark, "store")), _folder(spark, "ingest")
    settings = dict(parse=parse.xml_document, workdir=base, source="portal", jurisdiction="DE", sink=kept.sink("portal"), progress_path=f"{base}/progress", batch_rows=10_000)
    # first every ref of an even key, then all: those that are done are skipped
    ingest.run(refs.where("pos % 2 = 0"), _Portal, **settings)
    return ingest.run(refs, _Portal, **settings), kept


@_query("""WITH p AS (SELECT p_partkey AS k, p_partkey % 10 IN (0, 7) AS bad, p_partkey % 2 = 0 AS even FROM part), c AS (SELECT count(*) AS u, count(*) FILTER (k % 4 = 0) AS again, count(*) FILTER (even AND NOT bad) AS done, count(*) FILTER (bad) AS failed FROM p)
SELECT u + again AS listed, u AS unique_refs, done AS skipped, u - done - failed AS stored, failed, round((u - done - failed) / (u + again), 6) AS coverage, round((u - failed) / u, 6) AS coverage_unique, false AS complete, (SELECT least(count(*), 100) FROM p WHERE bad) AS missing FROM c""")
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of a run that goes on where another ended."""
    r, _ = _ingested(spark, sf_dir)
    row = (r.total_listed, r.total_unique, r.skipped_completed, r.total_stored, r.total_failed, round(r.coverage, 6), round(r.coverage_unique, 6), r.complete, len(r.missing))
    return spark.createDataFrame([row], "listed BIGINT, unique_refs BIGINT, skipped BIGINT, stored BIGINT, failed BIGINT, coverage DOUBLE, coverage_unique DOUBLE, complete BOOLEAN, missing BIGINT")


@_query("""SELECT 'l' || p_partkey AS id, 'portal' AS source_key, 'Gesetz ' || p_partkey AS title, 'DE' AS jurisdiction, 'https://portal.example/' || p_partkey AS source_url, TIMESTAMP '2020-01-02' AS effective_from FROM part WHERE p_partkey % 10 NOT IN (0, 7)""")
def ingested_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What such runs have stored."""
    _, kept = _ingested(spark, sf_dir)
    return kept.read("documents").select("id", "source_key", "title", "jurisdiction", "source_url", "effective_from")
