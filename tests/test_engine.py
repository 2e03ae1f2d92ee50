"""Graph, vectors, export, portals, fetching, ingest, store and stream on small inputs worked out by hand."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from paragraf.operators import export, graph, ingest, parse, vector
from paragraf.operators.relational import Database
from paragraf.operators.store import Store, last_of_each, persistable_id
from paragraf.schema import DOCUMENT
from paragraf.sources import http, landing, portals
from paragraf.streaming.landing import upsert_landing


def document(doc_id, title="", sections=(), metadata=None, kind="law", url="", **more):
    return {"id": doc_id, "title": title, "short_title": "", "jurisdiction": "DE", "type": kind, "published_at": None, "effective_from": None, "effective_to": None, "source_url": url, "sections": list(sections), "versions": [], "metadata": metadata or {}, **more}


def section(identifier, refs=(), chains=()):
    return {"identifier": identifier, "heading": "", "content": "", "refs": [{"type": k, "target": t} for k, t in refs], "norm_chains": [{"source": a, "target": b} for a, b in chains]}


@pytest.fixture(scope="module")
def built(spark):
    docs = [
        document("a", "A", [section("1", [("law", "BGB"), ("paragraph", "BGB § 1"), ("article", " "), (None, "x")], [("BGB § 1", "GG Art. 2"), ("x", "x")]), section("1")], {"ersetzt": "BGB § 1; alt | ALT"}),
        document("BGB", "Buergerliches Gesetzbuch"), document("r", kind="ruling", sections=[section("")]),
    ]
    return graph.build(spark.createDataFrame(docs, DOCUMENT))


def test_graph(built):
    nodes = {r.id: r for r in built.sorted_nodes().collect()}
    assert (nodes["law:bgb"].label, nodes["law:bgb"].metadata["document_id"]) == ("Buergerliches Gesetzbuch", "BGB")
    # the replaced target came first: it stays a law under a paragraph's id
    assert (nodes["paragraph:bgb-1"].type, nodes["paragraph:bgb-1"].label) == ("law", "BGB § 1")
    assert nodes["reference:x"].type == "unknown" and nodes["ruling:r"].type == "ruling" and "paragraph:ruling:r:section-1" in nodes
    edges = {(r["from"], r["to"], r.type): r for r in built.sorted_edges().collect()}
    assert edges["paragraph:law:a:1", "law:a", "concretizes"].weight == 2
    assert edges["paragraph:law:a:1", "law:bgb", "cites"].metadata == {"reference_type": "law"}
    assert edges["paragraph:bgb-1", "paragraph:gg-art-2", "references"].weight == 1
    assert {t for f, t, k in edges if k == "replaces"} == {"paragraph:bgb-1", "paragraph:alt"}
    assert [r["to"] for r in built.outgoing(" law:a ").collect()] == ["paragraph:alt", "paragraph:bgb-1"]
    assert [r["from"] for r in built.incoming("law:bgb").collect()] == ["paragraph:law:a:1"]
    assert built.node("law:bgb").count() == 1


def test_graph_switches_and_empty(spark):
    docs = spark.createDataFrame([document("a", sections=[section("1", [("law", "B")], [("x", "y")])], metadata={"replaces": "z"})], DOCUMENT)
    assert graph.build(docs, graph.Kinds(False, False, False, False)).edges.count() == 0
    assert graph.build(docs.where("false")).nodes.count() == 0


def test_graph_takes_any_other_columns(spark):
    docs = spark.createDataFrame([document("a", sections=[section("1", [("law", "B")])])], DOCUMENT)
    clashing = docs.withColumn("_d", F.lit(1)).withColumn("_o", F.lit("x")).withColumn("_s", F.lit(2)).withColumn("_t", F.lit(3))
    assert sorted(map(str, graph.build(clashing).edges.collect())) == sorted(map(str, graph.build(docs).edges.collect()))
    plain = graph.build(docs, metadata=False).edges.where("type = 'cites'").collect()
    assert [(r["to"], r.weight, r.metadata) for r in plain] == [("law:b", 1.0, {})]


def test_merge_rules(spark):
    rows = [("a", "b", "t", -1.0, {"k": "1"}, 1), ("a", "b", "t", 2.0, {"k": "2", "l": "3"}, 2), ("a", "a", "t", 1.0, {}, 3), (" ", "b", "t", 1.0, None, 4)]
    found = graph.merged_edges(spark.createDataFrame(rows, "`from` STRING, `to` STRING, type STRING, weight DOUBLE, metadata MAP<STRING,STRING>, seq INT")).collect()
    assert [(r.weight, r.metadata) for r in found] == [(3.0, {"k": "2", "l": "3"})]
    rows = [("n", "unknown", "", "", {"k": "1"}, 1), ("n", "law", " L ", "", {"k": "0"}, 2), ("n", "paragraph", "M", "DE", None, 3)]
    found = graph.merged_nodes(spark.createDataFrame(rows, "id STRING, type STRING, label STRING, jurisdiction STRING, metadata MAP<STRING,STRING>, seq INT")).first()
    assert (found.type, found.label, found.jurisdiction, found.metadata) == ("law", "L", "DE", {"k": "0"})


def test_last_metadata_of_other_names(spark):
    """Rows with other names each: every name keeps the value that came last; the shuffles hold no row for each name."""
    rows = [("n", "law", "L", "", {"a": "1", "b": "1"}, 1), ("n", "law", "L", "", {"b": "2", "c": "2"}, 2), ("n", "law", "L", "", {"a": "3", "b": "3"}, 3), ("n", "law", "L", "", {}, 4), ("n", "law", "L", "", {"c": None}, 5), ("m", "law", "", "", None, 6)]
    merged = graph.merged_nodes(spark.createDataFrame(rows, "id STRING, type STRING, label STRING, jurisdiction STRING, metadata MAP<STRING,STRING>, seq INT"))
    assert {r.id: r.metadata for r in merged.collect()} == {"n": {"a": "3", "b": "3", "c": None}, "m": {}}
    assert "Generate" not in merged._jdf.queryExecution().toString()


def test_document_ids_need_no_merged_nodes(built):
    assert sorted(r.id for r in built.documents.collect()) == sorted(r.id for r in built.nodes.where("metadata['document_id'] IS NOT NULL").collect())
    assert {r["from"] for r in built.neighbours(built.documents).collect()} == {"law:a"}


def test_rows_of_a_task_are_bounded(spark, monkeypatch):
    from paragraf.plans import queries

    monkeypatch.setattr(queries, "SPREAD_ROWS", 10)
    assert queries._spread(spark.range(1000)).rdd.getNumPartitions() == 100 and queries._spread(spark.range(5)).rdd.getNumPartitions() == 8


def test_vectors(spark):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate([[1.0, 0.0], [2.0, 0.0], [0.0, 1.0], [0.0, 0.0], None, [1.0], [float("nan"), 1.0]])], "k INT, embedding ARRAY<FLOAT>")
    assert [(r.k, round(r.distance, 6)) for r in vector.similar(rows, [1.0, 0.0], 0, keys=("k",)).collect()] == [(0, 0.0), (1, 0.0), (2, 1.0)]
    assert [(r.query_id, r.id) for r in vector.similar_to_all(rows, 1, key="k").orderBy("query_id").collect()] == [(0, 1), (1, 0), (2, 0)]
    assert vector.vector_literal([1.0, 1e-7, 0.1]) == "[1,0.0000001,0.1]"
    for bad in ([], [float("inf")]):
        with pytest.raises(ValueError):
            vector.checked(bad)


def test_search_of_queries_and_lengths(spark):
    r = np.random.RandomState(3)
    x = r.randn(300, 8)
    rows = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(1000 + i, [1.0, float(i)]) for i in range(4)] + [(7, None)], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    found = {(q.query_id, q.rank): q.id for q in vector.similar_to_all(rows, 3, tile=32, queries=rows.where("vec_id % 50 = 0")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(q, k + 1): int(i) for q in range(0, 300, 50) for k, i in enumerate([i for i in np.argsort(-(u @ u[q]), kind="stable") if i != q][:3])}
    assert {k: v for k, v in found.items() if k[0] < 1000} == want and {k[0] for k in found} == {0, 50, 100, 150, 200, 250, 1000}
    assert found[1000, 1] == 1001


def test_rows_meet_broadcast_queries_without_copies(spark, monkeypatch):
    rows = spark.createDataFrame([(k, [float(x) for x in np.random.default_rng(k).normal(size=4)]) for k in range(300)], "vec_id INT, embedding ARRAY<DOUBLE>")
    near = lambda: vector.similar_to_all(rows, 3, tile=64, queries=rows.where("vec_id % 2 = 0"))
    found = near()
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(vector, "BROADCAST_BYTES", 0)
    told = lambda df: sorted((r.query_id, r["rank"], r.id, round(r.distance, 9)) for r in df.collect())
    assert told(found) == told(near()) and len(told(found)) == 450


def test_cells_reach_their_recall(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    cells = vector.fit_cells(rows, 8)
    indexed = cells.indexed(rows)
    probes = vector.probes_for(indexed, cells, 0.9)
    asked, hits = rows.where("vec_id % 50 = 0").collect(), 0
    for q in asked:
        near = {r.vec_id for r in vector.similar_in_cells(indexed, q.embedding, cells, probes, 10, keys=("vec_id",)).collect()}
        hits += len(near & {r.vec_id for r in vector.similar(rows, q.embedding, 10, keys=("vec_id",)).collect()})
    assert probes <= 8 and hits >= 0.85 * 10 * len(asked)
    bad = spark.createDataFrame([(1, None), (2, [1.0]), (3, [float("nan")] * 64)], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    assert [r.cell for r in cells.indexed(bad).collect()] == [None] * 3


def test_export(spark, built):
    docs = spark.createDataFrame([document("a", "<&>"), document("b", sections=[section("1", [("law", "B")])])], DOCUMENT)
    lines = [r.line for r in export.document_lines(docs).collect()]
    assert json.loads(lines[0])["Title"] == "<&>" and "\\u003c\\u0026\\u003e" in lines[0] and '"PublishedAt":null' in lines[0]
    assert json.loads(lines[1])["Sections"][0]["References"] == [{"Type": "law", "Target": "B"}]
    assert docs.select(export.document_json_pretty().alias("x")).first().x.startswith('{\n  "ID": "a"')
    assert [d["ID"] for d in json.loads(export.documents_json(docs))] == ["a", "b"]
    for call in (lambda: export.documents_json(docs, most=1), lambda: export.graph_json(built, most=1)):
        with pytest.raises(ValueError):
            call()
    whole = json.loads(export.graph_json(built))
    assert [n["ID"] for n in whole["nodes"]] == sorted(n["ID"] for n in whole["nodes"]) and '"Weight":2,' in export.graph_json(built)


def test_portal_lists(spark):
    page = '<a href="/lmi/owa/br_text?v_id=1#x">Eins</a><a href="/lmi/owa/br_text?v_id=1">Noch</a><a href="https://fremd.de/?v_id=2">F</a><ul><li>Zeile <a href="/lmi/owa/z/?menu=1"></a></ul><a name="sg=">'
    found = portals.listed(spark.createDataFrame([(1, page), (2, None)], "page_id INT, payload STRING"), portals.PORTALS["nrw"]).orderBy("pos").collect()
    assert [(r.pos, r.id, r.url, r.title) for r in found] == [(1, "v_id-1", "https://recht.nrw.de/lmi/owa/br_text?v_id=1", "Eins"), (2, "z", "https://recht.nrw.de/lmi/owa/z/?menu=1", "Zeile")]
    assert portals.profile_names() == sorted(portals.PROFILES) and len(portals.profile_names()) == 8 and len(portals.STATES) == 5
    p = portals.profile("berlin", {"query": "bau", "showdoccase": " "})
    assert p.list_url == "https://gesetze.berlin.de/jportal/?quelle=jlink&query=bau" and portals.source_name(p) == "juris-berlin"
    assert portals.default_query("hessen")["query"] == "*" and portals.default_query("nirgends") is None
    assert portals.profile("baden-wuerttemberg").jurisdiction == "DE-BW" and portals.presets()["sachsen-anhalt"](query="x").list_query["query"] == "x"
    assert portals.profile("eigenes", base_url="https://recht.example/").list_url == "https://recht.example/"
    with pytest.raises(ValueError):
        portals.profile("badenwuerttemberg")
    odd = spark.createDataFrame([(1, '<![bogus[x]]><a href="/lmi/owa/a?v_id=7">Da</a><![if x]>')], "page_id INT, payload STRING")
    assert [r.id for r in portals.listed(odd, portals.PORTALS["nrw"]).collect()] == ["v_id-7"]


def test_retry_and_limit():
    answers, slept = [(503, b""), (500, b""), (200, b"x")], []
    assert http.Retry(3, sleep=slept.append).run(lambda: answers.pop(0)) == (200, b"x") and slept == [0.25, 0.5]
    with pytest.raises(http.Exhausted):
        http.Retry(2, sleep=slept.append).run(lambda: (502, b""))
    assert http.Retry(1).run(lambda: (502, b"")) == (502, b"")
    assert http.Retry(3, should=lambda *_: True).run(lambda: (404, b"")) == (404, b"")
    assert [http.backoff_s(k) for k in (1, 2, 5, 6, 99)] == [0.25, 0.5, 4.0, 5.0, 5.0]
    now, slept = [0.0], []
    limit = http.Limiter(0.2, clock=lambda: now[0], sleep=slept.append)
    limit.wait()
    now[0] = 0.2
    limit.wait()
    assert [round(s, 3) for s in slept] == [0.2, 0.2]
    limit.stop()
    with pytest.raises(RuntimeError):
        limit.wait()


def test_snapshots(tmp_path):
    a, b = (http.save_snapshot(str(tmp_path), "nrw/x", "§ 1", b"p") for _ in range(2))
    assert a != b and "/nrw_x/" in a and "_1" in a


def archive(law):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("x.xml", f"<dokumente><norm><metadaten><jurabk>{law}</jurabk><enbez>§ 1</enbez><ausfertigung-datum>2001-02-03</ausfertigung-datum></metadaten></norm></dokumente>")
    return out.getvalue()


def test_ingest(spark, tmp_path):
    base, work = str(tmp_path / "landing"), str(tmp_path / "work")
    for name, payload in (("a", archive("A")), ("b", archive("B")), ("c", b"kein Archiv")):
        landing.land(base, f"https://x/{name}", payload)
    refs = spark.createDataFrame([(1, "a", "https://x/a", "t"), (2, "a", "https://x/other", "t"), (3, "", "https://x/b", "t"), (4, "c", "https://x/c", "t"), (5, "d", "https://x/d", "t"), (6, " ", "", "t")], "pos INT, id STRING, url STRING, title STRING")
    store = Store(spark, str(tmp_path / "store"))
    settings = dict(fetcher=lambda: landing.replay(base), parse=lambda raw: parse.federal_document(landing.unzipped(raw)), workdir=work, source="bund", jurisdiction="DE-BUND", sink=store.sink("bund"), progress_path=str(tmp_path / "progress"))
    report = ingest.run(refs, report_path=str(tmp_path / "r" / "report.json"), **settings)
    assert (report.total_listed, report.total_unique, report.total_queued, report.total_fetched, report.total_stored, report.total_failed, report.skipped_completed) == (6, 4, 4, 2, 2, 2, 0)
    assert report.missing == ["c", "d"] and not report.complete and [f["document_key"] for f in report.failed] == ["c", "d"]
    assert json.loads((tmp_path / "r" / "report.json").read_text())["TotalStored"] == 2
    assert spark.read.parquet(report.outcomes).where("outcome LIKE '%failed'").count() == 2
    stored = {r.id: r for r in store.read("documents").collect()}
    assert {r.title for r in stored.values()} == {"A", "B"} and stored["a"].effective_from.year == 2001 and store.read("versions").count() == 2
    again = ingest.run(refs, **settings)
    assert (again.skipped_completed, again.total_fetched, again.total_failed) == (2, 0, 2)
    with pytest.raises(ingest.IngestError):
        ingest.run(refs, continue_on_error=False, **settings)


class Killed(BaseException):
    """What ends a run without its leave."""


def test_ingest_goes_on_after_a_kill(spark, tmp_path):
    base, work, asked = str(tmp_path / "landing"), str(tmp_path / "work"), str(tmp_path / "asked")
    for k in range(12):
        landing.land(base, portals.FEDERAL_LAW.format(f"g{k}"), archive(f"G{k}"))

    def fetcher():
        inner = landing.replay(base)

        def fetch(url):
            with open(asked, "a") as f:
                f.write(url + "\n")
            return inner(url)

        return fetch

    refs = spark.createDataFrame([(k, f"g{k}", "", "t", "eigen" if k == 3 else None) for k in range(12)], "pos INT, id STRING, url STRING, title STRING, source_key STRING")
    store, shown, left = Store(spark, str(tmp_path / "store")), [], [2]

    def dying(docs):
        left[0] -= 1
        if not left[0]:
            raise Killed
        store.sink(source_name="bund")(docs)

    settings = dict(workdir=work, refs=refs, progress_path=str(tmp_path / "progress"), batch_rows=4)
    with pytest.raises(Killed):
        ingest.federal(spark, fetcher, sink=dying, **settings)
    before = open(asked).read().splitlines()
    report = ingest.federal(spark, fetcher, sink=store.sink(source_name="bund"), on_progress=lambda r: shown.append(r.total_stored), snapshot_path=str(tmp_path / "now.json"), snapshot_every_s=0, **settings)
    after = open(asked).read().splitlines()
    # each document was fetched once: the dead batch's answers were taken up
    assert len(before) < 12 and sorted(after) == sorted({*after}) and len(after) == 12
    assert report.total_stored + report.skipped_completed == 12 and report.skipped_completed == shown[-1] * 0 + 12 - report.total_stored
    assert shown == sorted(shown) and json.loads((tmp_path / "now.json").read_text())["TotalStored"] == report.total_stored
    keys = {r.id: r.source_key for r in store.read("documents").collect()}
    assert len(keys) == 12 and keys["g3"] == "eigen" and keys["g1"] == "bund"


def test_ingest_takes_batches_together(spark, tmp_path, monkeypatch):
    """Rounds are bounded whatever the batches; a sink's failure costs one batch; a killed round's answers are taken up."""
    monkeypatch.setattr(ingest, "MOST_ROUNDS", 2)
    base, calls, log = str(tmp_path / "landing"), [], tmp_path / "log"
    log.mkdir()
    for k in range(12):
        landing.land(base, f"https://x/{k}", f"<law id='g{k}'><title>t</title></law>".encode())
    refs = spark.createDataFrame([(k, f"g{k}", f"https://x/{k}", "t") for k in range(12)], "pos INT, id STRING, url STRING, title STRING")
    folder = str(log)

    def fetcher():
        import os
        import uuid

        def fetch(url):
            open(os.path.join(folder, url.rsplit("/", 1)[-1] + "-" + uuid.uuid4().hex), "w").close()
            return landing.replay(base)(url)

        return fetch

    def sink(docs):
        ids = {r.id for r in docs.select("id").collect()}
        calls.append(ids)
        if "g3" in ids:
            raise ValueError("g3 is not for this sink")

    def dying(docs):
        raise KeyboardInterrupt

    settings = dict(parse=parse.xml_document, workdir=str(tmp_path / "w"), source="s", jurisdiction="DE", progress_path=str(tmp_path / "progress"), batch_rows=2)
    with pytest.raises(KeyboardInterrupt):
        ingest.run(refs, fetcher, sink=dying, **settings)
    report = ingest.run(refs, fetcher, sink=sink, **settings)
    assert sorted(p.name.split("-")[0] for p in log.iterdir()) == sorted(map(str, range(12)))
    lost = min((c for c in calls if "g3" in c), key=len)
    assert report.total_fetched == 12 and report.total_failed == len(lost) < 6 and report.total_stored == 12 - len(lost)
    assert set().union(*[c for c in calls if "g3" not in c]) | lost == {f"g{k}" for k in range(12)}
    calls.clear()
    more = spark.createDataFrame([(k, f"h{k}", f"https://x/{k % 12}", "t") for k in range(12)], "pos INT, id STRING, url STRING, title STRING")
    shown = []
    ingest.run(more, fetcher, sink=lambda docs: calls.append(docs.count()), on_progress=lambda r: shown.append(r.total_stored), **settings)
    assert len(calls) == len(shown) == 2 and sum(calls) == shown[-1] == 12


def test_first_error_stops_a_run(spark, tmp_path):
    refs = spark.createDataFrame([(k, f"g{k}", f"https://x/{k}", "t") for k in range(9)], "pos INT, id STRING, url STRING, title STRING")
    with pytest.raises(ingest.IngestError) as e:
        ingest.run(refs, lambda: landing.replay(str(tmp_path)), parse.xml_document, str(tmp_path / "w"), "s", "DE", continue_on_error=False, batch_rows=3)
    assert 0 < e.value.report.total_failed < 9 and e.value.report.total_listed == 9


def test_federal_and_portal_end_to_end(spark, tmp_path):
    base, snaps = str(tmp_path / "landing"), str(tmp_path / "snaps")
    landing.land(base, portals.FEDERAL_TOC, b"<items><item><title>ZPO</title><link>http://www.gesetze-im-internet.de/zpo/xml.zip</link></item></items>")
    landing.land(base, portals.FEDERAL_LAW.format("zpo"), archive("ZPO"))
    nrw = portals.PORTALS["nrw"]
    landing.land(base, nrw.list_url, b'<a href="/lmi/owa/br_text?v_id=1">Eins</a>')
    landing.land(base, "https://recht.nrw.de/lmi/owa/br_text?v_id=1", "<h1>Bauordnung (BauO)</h1><p>Siehe § 1.</p>".encode())
    store = Store(spark, str(tmp_path / "store"))
    report = ingest.federal(spark, lambda: landing.replay(base), str(tmp_path / "w"), sink=store.sink(source_name="bundesrecht"), snapshot=lambda doc_id, payload: http.save_snapshot(snaps, "bund", doc_id, payload))
    assert report.complete and report.total_stored == 1 and len(list((tmp_path / "snaps" / "bund").iterdir())) == 1
    assert ingest.portal(spark, nrw, lambda: landing.replay(base), str(tmp_path / "w"), sink=store.sink("nrw")).complete
    stored = {r.id: r for r in store.read("documents").collect()}
    assert stored["zpo"].title == "ZPO" and stored["v_id-1"].short_title == "BauO" and stored["v_id-1"].source_key == "nrw"


def test_store_takes_a_dead_writers_place(spark, tmp_path):
    store = Store(spark, str(tmp_path), compact_after=3)
    frame = lambda i: spark.createDataFrame([document(f"d{i}", f"t{i}", [section("1")])], DOCUMENT)
    store.upsert_documents(frame(0), "s")
    # a writer that died before its commit: a part, and rows that nothing names
    (tmp_path / "_commits" / "tot.part").write_text("add tot")
    frame(9).write.parquet(str(tmp_path / "documents" / ("f" * 32)))
    other = Store(spark, str(tmp_path))
    seen = other._commits()
    for i in range(1, 6):
        store.upsert_documents(frame(i), "s")
    assert {r.id for r in store.read("documents").collect()} == {f"d{i}" for i in range(6)} and len(store._commits()) <= 3
    # a writer that saw an older state takes the next free number
    other._write({}, seen=seen)
    assert {r.id for r in store.read("documents").collect()} == {f"d{i}" for i in range(6)}
    with pytest.raises(RuntimeError):
        other._write({}, True, seen)


def test_relational_sink(spark, tmp_path):
    path = str(tmp_path / "db.sqlite")

    def connect():
        import sqlite3

        c = sqlite3.connect(path, timeout=60)
        c.execute("PRAGMA foreign_keys = ON")
        return c

    db = Database(connect, flavour="sqlite")
    db.init_schema()
    db.init_vector_schema(2)
    frame = lambda *rows: spark.createDataFrame(list(rows), DOCUMENT)
    db.upsert_documents(frame(document("a", "eins", [section("1", [("law", "B")]), section("2")]), document("b", "b")), "s", workers=1)
    db.sink("", "quelle")(frame(document("a", "zwei", [section("9")])).withColumn("source_key", F.lit(" ")))
    db.upsert_embeddings(spark.createDataFrame([("a", 0, 0, "x", [1.0, 2.5], {"k": "v"})], "document_id STRING, section_index INT, chunk_index INT, content STRING, embedding ARRAY<FLOAT>, metadata MAP<STRING,STRING>"), workers=1)
    c = connect()
    assert c.execute("SELECT id, title, source_key FROM documents ORDER BY id").fetchall() == [("a", "zwei", "quelle"), ("b", "b", "s")]
    assert c.execute('SELECT document_id, section_index, identifier, "references" FROM sections').fetchall() == [("a", 0, "9", "[]")]
    assert c.execute("SELECT embedding, metadata FROM embeddings").fetchall() == [("[1,2.5]", '{"k":"v"}')]
    c.close()
    with pytest.raises(ValueError):
        db.vector_statements(0)
    made = Database(connect, "recht").vector_statements(768)
    assert made[0] == 'CREATE SCHEMA IF NOT EXISTS "recht"' and "VECTOR(768) NOT NULL" in made[-1] and '"recht"."embeddings"' in made[-1]
    assert "WITH (lists = 1)" in Database(connect).cosine_index_statement(lists=0)


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("documents").count() == 0
    frame = lambda *rows: spark.createDataFrame(list(rows), DOCUMENT)
    store.upsert_documents(frame(document("a", "eins", [section("1"), section("2")]), document("b", "b", [section("1")])), "s")
    store.upsert_documents(frame(document("a", "zwei", [section("9")]), document("", "nur Titel")), "t")
    read = lambda: ({r.id: r.title for r in store.read("documents").collect()}, sorted((r.document_id, r.identifier) for r in store.read("sections").collect()))
    key = spark.range(1).select(persistable_id(F.lit(" "), F.lit(None), F.lit("nur Titel"))).first()[0]
    want = {"a": "zwei", "b": "b", key: "nur Titel"}, [("a", "9"), ("b", "1")]
    assert read() == want and len(key) == 20
    store.upsert_embeddings(spark.createDataFrame([("a", 0, 0, "x", [1.0, 2.0], {"k": "v"})], "document_id STRING, section_index INT, chunk_index INT, content STRING, embedding ARRAY<FLOAT>, metadata MAP<STRING,STRING>"))
    store.compact()
    store.vacuum()
    assert read() == want and store.read("embeddings").first().metadata == '{"k":"v"}'
    with pytest.raises(ValueError):
        store.upsert_documents(frame(document("c"), document("")), "s")
    assert read() == want
    rows = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (None, "z", 1)], "k INT, v STRING, o INT")
    assert sorted(map(str, last_of_each(rows, ["k"], "o").collect())) == ["Row(k=1, v='y')", "Row(k=None, v='z')"]


def test_texts_are_shuffled_only_where_ids_repeat(spark, monkeypatch):
    from paragraf.operators import store as module

    frame = lambda *rows: spark.createDataFrame(list(rows), DOCUMENT)
    plan = lambda rows: rows._jdf.queryExecution().optimizedPlan().toString()
    once = module.document_rows(frame(document("a", "eins", [section("1")]), document("b", "b")), "s")
    assert not any(word in plan(rows) for rows in once.values() for word in ("Aggregate", "Join"))
    docs = frame(document("a", "eins", [section("1"), section("2")]), document("a", "zwei", [section("9")]), document("a", "drei"), document("b", "b", [section("3")]))
    for most in (module.BROADCAST_IDS, 0):
        monkeypatch.setattr(module, "BROADCAST_IDS", most)
        twice = module.document_rows(docs, "s")
        assert sorted((r.id, r.title) for r in twice["documents"].collect()) == [("a", "zwei"), ("b", "b")]
        assert sorted((r.document_id, r.identifier) for r in twice["sections"].collect()) == [("a", "9"), ("b", "3")]


def test_stream(spark, tmp_path):
    base, store = str(tmp_path / "in"), Store(spark, str(tmp_path / "store"))
    run = lambda: upsert_landing(spark, base, store, parse.xml_document, str(tmp_path / "check"), "s", "DE", str(tmp_path / "failures")).awaitTermination()
    landing.land(base, "a", b"<law id='a'><title>eins</title></law>")
    landing.land(base, "x", b"kaputt")
    run()
    landing.land(base, "b", b"<law id='a'><title>zwei</title></law>")
    run()
    assert [r.title for r in store.read("documents").collect()] == ["zwei"]
    assert spark.read.parquet(str(tmp_path / "failures")).count() == 1
