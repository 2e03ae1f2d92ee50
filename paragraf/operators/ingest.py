"""Ingest: what is listed and not yet done is fetched, parsed, stored and accounted for.

Fetching is the only step with side effects, so its answers are written first (bronze); parsing, storing, progress
and the report all start from that table and agree however often a task is run again.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import ensured_versions, filled_range
from ..functions.text import first_non_blank
from ..sources import portals
from ..sources.http import Fetcher
from ..sources.landing import unzipped
from .export import write_json_file
from .parse import federal_document, portal_document

WORKERS, MAX_FAILURES, BATCH_ROWS = 4, 100, 10_000
#: Rounds of parsing, storing and marking that a run takes at most.
MOST_ROUNDS = 8


def document_key(doc_id: Column | str, url: Column | str) -> Column:
    return first_non_blank(doc_id, url)


def unique_refs(refs: DataFrame, pos: str = "pos") -> DataFrame:
    """With document_key; of each key the row of least pos. Rows of blank keys go.

    Equal pos tie by the rest of the row. Columns stay as they are.
    """
    keyed = refs.withColumn("document_key", document_key("id", "url")).where("document_key <> ''")
    plain = [c for c in refs.columns if c != pos and refs.schema[c].dataType.typeName() != "map"]
    first = keyed.groupBy("document_key").agg(F.min_by(F.struct(*refs.columns), F.struct(pos, *plain)).alias("f"))
    return first.select("document_key", "f.*")


def latest_progress(progress: DataFrame) -> DataFrame:
    """Of appended rows (source, document_key, status, reason, updated_at) the last of each key."""
    last = progress.groupBy("source", "document_key").agg(F.max(F.struct("updated_at", "status", "reason")).alias("p"))
    return last.select("source", "document_key", "p.status", "p.reason", "p.updated_at")


def pending(refs: DataFrame, progress: DataFrame | None, source: str) -> DataFrame:
    """refs (with document_key) whose last progress isn't completed."""
    if progress is None:
        return refs
    done = latest_progress(progress.where(F.col("source") == source)).where("status = 'completed'").select("document_key")
    return refs.join(done, "document_key", "left_anti")


_FETCHED = "document_key STRING, id STRING, url STRING, title STRING, status INT, payload BINARY, error STRING"


def fetched(refs: DataFrame, fetcher: Callable[[], Fetcher], workers: int = WORKERS, snapshot: Callable[[str, bytes], object] | None = None) -> DataFrame:
    """A row for each ref (document_key, id, url, title): status and payload, or error. fetcher is called once a task, snapshot with id (or key) and payload of each answer."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch = fetcher()
        for batch in batches:
            rows = []
            for key, doc_id, url, title in batch[["document_key", "id", "url", "title"]].itertuples(index=False):
                status, payload, error = None, None, None
                try:
                    if not (url or "").strip():
                        raise ValueError("document ref requires URL")
                    status, payload = fetch(url)
                    if status >= 400:
                        payload, error = None, f"document request failed with status {status}"
                    elif snapshot is not None:
                        snapshot((doc_id or "").strip() or key, payload)
                except Exception as e:  # one document's failure is a row, not the job's
                    error = str(e) or type(e).__name__
                rows.append((key, doc_id, url, title, status, payload, error))
            yield pd.DataFrame(rows, columns=["document_key", "id", "url", "title", "status", "payload", "error"]).astype({"status": "Int32"})

    return refs.select("document_key", "id", "url", "title").repartition(max(1, workers)).mapInPandas(each, _FETCHED)


def completed(doc: Column, doc_id: Column, title: Column, url: Column, jurisdiction: str) -> Column:
    """The parsed document with its blanks filled from the ref, its URL set and its versions ensured."""
    versions = ensured_versions(doc["versions"], doc["effective_from"], doc["published_at"], doc["effective_to"])
    start, end = filled_range(versions, doc["effective_from"], doc["effective_to"])
    return F.struct(
        doc["error"].alias("error"), first_non_blank(doc["id"], doc_id).alias("id"), first_non_blank(doc["title"], title).alias("title"), F.coalesce(doc["short_title"], F.lit("")).alias("short_title"), first_non_blank(doc["jurisdiction"], F.lit(jurisdiction)).alias("jurisdiction"), F.coalesce(F.nullif(doc["type"], F.lit("")), F.lit("law")).alias("type"),
        doc["published_at"].alias("published_at"), start.alias("effective_from"), end.alias("effective_to"), url.alias("source_url"), doc["sections"].alias("sections"), versions.alias("versions"), doc["metadata"].alias("metadata"),
    )


@dataclass
class Report:
    source_name: str
    started_at: datetime
    finished_at: datetime
    total_listed: int = 0
    total_queued: int = 0
    total_fetched: int = 0
    total_stored: int = 0
    total_failed: int = 0
    skipped_completed: int = 0
    total_unique: int = 0
    failed: list[dict[str, str]] = field(default_factory=list)
    missing: list[str] = field(default_factory=list)
    #: Tables of all outcomes (document_key, url, reason, outcome), one a round.
    outcomes: str = ""

    @property
    def coverage(self) -> float:
        """Fetched of listed, repeats counted; 1 if nothing is listed."""
        return self.total_fetched / self.total_listed if self.total_listed else 1.0

    @property
    def coverage_unique(self) -> float:
        """Fetched or done before, of unique refs."""
        return (self.total_fetched + self.skipped_completed) / self.total_unique if self.total_unique else 1.0

    @property
    def complete(self) -> bool:
        return self.total_listed > 0 and self.total_failed == 0 and self.total_fetched == self.total_listed

    def as_json(self) -> dict:
        times = {"StartedAt": self.started_at.isoformat().replace("+00:00", "Z"), "FinishedAt": self.finished_at.isoformat().replace("+00:00", "Z"), "Duration": int((self.finished_at - self.started_at).total_seconds() * 1e9)}
        return {"SourceName": self.source_name, **times, "TotalListed": self.total_listed, "TotalQueued": self.total_queued, "TotalFetched": self.total_fetched, "TotalStored": self.total_stored, "TotalFailed": self.total_failed, "SkippedCompleted": self.skipped_completed, "Failed": [{"DocumentKey": f["document_key"], "URL": f["url"], "Reason": f["reason"]} for f in self.failed], "MissingDocumentID": self.missing}


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """One row of counts of outcomes (outcome: skipped, fetch_failed, store_failed, fetched or stored)."""
    count = lambda *names: F.count_if(F.col("outcome").isin(*names)).alias
    return outcomes.agg(F.count("*").alias("total_unique"), count("skipped")("skipped_completed"), count("fetched", "stored", "store_failed")("total_fetched"), count("stored")("total_stored"), count("fetch_failed", "store_failed")("total_failed"))


class IngestError(RuntimeError):
    """Carries the report of a run that failed."""

    def __init__(self, message: str, report: Report) -> None:
        super().__init__(message)
        self.report = report


def run(
    refs: DataFrame, fetcher: Callable[[], Fetcher], parse: Callable[[Column], Column], workdir: str, source: str, jurisdiction: str, sink: Callable[[DataFrame], None] | None = None, progress_path: str | None = None,
    workers: int = WORKERS, max_failures: int = MAX_FAILURES, continue_on_error: bool = True, report_path: str | None = None, pos: str = "pos", batch_rows: int = BATCH_ROWS, snapshot: Callable[[str, bytes], object] | None = None,
    on_progress: Callable[[Report], None] | None = None, snapshot_path: str | None = None, snapshot_every_s: float = 10.0, clock: Callable[[], float] = time.monotonic,
) -> Report:
    """Fetches refs (pos, id, url, title, and if there is one, source_key) that aren't done, parses and stores them, marks progress, reports.

    workdir: shared folder for the answers and parsed documents of this run. Refs are fetched in batches of about batch_rows
    by hashed key, whose answers are written at once. Parsing, storing and marking cost a plan each, whatever they hold, so
    they take a batch each up to MOST_ROUNDS batches, and beyond that as many together as make MOST_ROUNDS rounds. A run
    that is killed goes on with the round that it was in, from the answers that its batches had written. sink: gets the
    documents of a round with source_key; if it fails, those of each of its batches, and all of a batch that fails count as
    failed to store. progress_path: Parquet that progress is read from and appended to. Without
    continue_on_error a round is a batch, and a run raises IngestError after the first with failures, when it has accounted for it.
    on_progress gets the report so far after each round, snapshot_path the same as JSON, snapshot_every_s seconds apart at least.
    snapshot: called on executors with id and payload of each answer, once at least.

    The report lists at most max_failures failures and as many missing keys; the folder in report.outcomes holds all.
    """
    spark: SparkSession = refs.sparkSession
    started, shown = datetime.now(timezone.utc), None
    base = workdir.rstrip("/")
    at = f"{base}/run-{uuid.uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{at}/{name}")
        return spark.read.parquet(f"{at}/{name}")

    refs = refs if "source_key" in refs.columns else refs.withColumn("source_key", F.lit(None).cast("string"))
    listed = refs.count()
    left = _left_answers(spark, base, source)
    unique = kept(unique_refs(refs, pos), "refs")
    todo = kept(pending(unique, _read_progress(spark, progress_path), source), "todo")
    queued, total_unique = todo.count(), unique.count()
    batches = max(1, -(-queued // batch_rows))
    together = max(1, -(-batches // MOST_ROUNDS)) if continue_on_error else 1
    report = Report(source, started, started, listed, total_unique, total_unique=total_unique, skipped_completed=total_unique - queued, outcomes=f"{at}/*/outcomes")
    doc = completed(F.col("d"), F.col("id"), F.col("title"), F.col("url"), jurisdiction)
    number = F.pmod(F.xxhash64("document_key"), F.lit(batches)).cast("int")

    def batched(df: DataFrame, name: str) -> DataFrame:
        """df by batch, so that a batch reads its own rows only."""
        rows = df.withColumn("batch", number)
        rows.repartition("batch").write.partitionBy("batch").parquet(f"{at}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{at}/{name}")

    parts = batched(todo, "batched") if queued else todo
    known = None if left is None or not queued else batched(left.join(todo.select("document_key", F.col("url").alias("asked")), "document_key").where("url = asked").drop("asked"), "known")
    for r in range(-(-batches // together) if queued else 0):
        here = range(r * together, min(batches, (r + 1) * together))
        for k in here:
            asked, had = parts.where(F.col("batch") == k), None if known is None else known.where(F.col("batch") == k).drop("batch", "source")
            answers = fetched(asked if had is None else asked.join(had, "document_key", "left_anti"), fetcher, workers, snapshot)
            (answers if had is None else answers.unionByName(had)).withColumn("source", F.lit(source)).write.parquet(f"{at}/round-{r}/batch-{k}/answers")
        answers = spark.read.schema(_FETCHED + ", source STRING").parquet(*[f"{at}/round-{r}/batch-{k}/answers" for k in here])
        # Hashed over all cores: joins of short rows leave few partitions, and parsing is what costs.
        got = answers.where("error IS NULL").join(parts.where(F.col("batch").between(here[0], here[-1])).select("document_key", "source_key", "batch"), "document_key").repartition(spark.sparkContext.defaultParallelism, "document_key")
        parsed = kept(got.withColumn("d", parse(F.col("payload"))).select("document_key", "url", "source_key", "batch", doc.alias("d")), f"round-{r}/parsed")
        good = parsed.where("d.error IS NULL").select("document_key", "source_key", "batch", "d.*").drop("error")
        errors = {} if sink is None or good.isEmpty() else _stored(good, sink, here)
        reason = F.create_map(*[F.lit(x) for item in errors.items() for x in item])[F.col("batch")] if errors else F.lit(None).cast("string")
        ended = F.lit("fetched") if sink is None else F.when(reason.isNotNull(), "store_failed").otherwise("stored")
        failed = answers.where("error IS NOT NULL").select("document_key", "url", F.col("error").alias("reason")).unionByName(parsed.where("d.error IS NOT NULL").select("document_key", "url", F.col("d.error").alias("reason")))
        states = failed.select("document_key", "url", "reason", F.lit("fetch_failed").alias("outcome")).unionByName(good.select("document_key", F.col("source_url").alias("url"), reason.alias("reason"), ended.alias("outcome")))
        outcomes = kept(states, f"round-{r}/outcomes")
        if progress_path:
            marks = outcomes.select(F.lit(source).alias("source"), "document_key", F.when(F.col("outcome").endswith("failed"), "failed").otherwise("completed").alias("status"), F.coalesce("reason", F.lit("")).alias("reason"), F.current_timestamp().alias("updated_at"))
            marks.write.mode("append").parquet(progress_path)
        _account(report, outcomes, max_failures)
        if on_progress:
            on_progress(report)
        if snapshot_path and (shown is None or clock() - shown >= snapshot_every_s):
            shown = clock()
            write_json_file(snapshot_path, report.as_json())
        if report.total_failed and not continue_on_error:
            break
    report.finished_at = datetime.now(timezone.utc)
    for path in filter(None, (report_path, snapshot_path)):
        write_json_file(path, report.as_json())
    if not continue_on_error and report.total_failed:
        worst = report.failed[0] if report.failed else {"document_key": "", "reason": ""}
        raise IngestError(f"{report.total_failed} documents failed, first {worst['document_key']}: {worst['reason']}", report)
    return report


def _stored(good: DataFrame, sink: Callable[[DataFrame], None], batches: range) -> dict[int, str]:
    """Hands good documents to the sink: together, or if that fails, batch by batch. The errors of the batches that failed."""
    errors = {}
    for some in ([batches] if len(batches) == 1 else [batches, *(range(k, k + 1) for k in batches)]):
        try:
            sink(good.where(F.col("batch").between(some[0], some[-1])).drop("document_key", "batch"))
        except Exception as e:  # the sink is the caller's; its failure is accounted for
            if len(some) == 1:
                errors[some[0]] = str(e) or type(e).__name__
        else:
            if some == batches:
                break
    return errors


def _account(report: Report, outcomes: DataFrame, most: int) -> None:
    """Adds a round to the report; of failures and missing keys the least, most of each."""
    counts = outcome_counts(outcomes).first()
    for name in ("total_fetched", "total_stored", "total_failed"):
        setattr(report, name, getattr(report, name) + counts[name])
    worst = outcomes.where("outcome LIKE '%failed'").orderBy("document_key").limit(most).select("document_key", F.coalesce("url", F.lit("")).alias("url"), "reason")
    report.failed = sorted(report.failed + [r.asDict() for r in worst.collect()], key=lambda f: f["document_key"])[:most]
    missing = outcomes.where("outcome = 'fetch_failed'").orderBy("document_key").limit(most).select("document_key")
    report.missing = sorted(report.missing + [r[0] for r in missing.collect()])[:most]
    report.finished_at = datetime.now(timezone.utc)


def _left_answers(spark: SparkSession, base: str, source: str) -> DataFrame | None:
    """Good answers of rounds that were never accounted for, a row a key: those of runs that died."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    where = path(f"{base}/run-*/{{batch-*,round-*/batch-*}}/answers/_SUCCESS")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    folders = [s.getPath().getParent().getParent() for s in fs.globStatus(where) or []]
    dead = [f"{f}/answers" for f in map(str, folders) if not any(fs.exists(path(f"{at}/outcomes/_SUCCESS")) for at in (f, f.rpartition("/")[0]))]
    if not dead:
        return None
    rows = spark.read.schema(_FETCHED + ", source STRING").parquet(*dead).where((F.col("source") == source) & F.col("error").isNull())
    return rows.groupBy("document_key").agg(F.max_by(F.struct("id", "url", "title", "status", "payload", "error"), "url").alias("r")).select("document_key", "r.*")


def federal(spark: SparkSession, fetcher: Callable[[], Fetcher], workdir: str, refs: DataFrame | None = None, **settings) -> Report:
    """The federal corpus end to end: table of contents (or refs), archives (by their ids where refs have no URL), first XML of each, parsed."""
    refs = portals.federal_refs(spark, fetcher()) if refs is None else refs
    return run(portals.with_federal_urls(refs), fetcher, lambda raw: federal_document(unzipped(raw)), workdir, portals.FEDERAL, portals.FEDERAL_JURISDICTION, **settings)


def portal(spark: SparkSession, settings: portals.Portal, fetcher: Callable[[], Fetcher], workdir: str, refs: DataFrame | None = None, **more) -> Report:
    """A portal's corpus end to end: list page (or refs), pages, parsed as the portal's."""
    refs = portals.portal_refs(spark, settings, fetcher()) if refs is None else refs
    return run(refs, fetcher, lambda raw: portal_document(raw, settings.jurisdiction, settings.short_title), workdir, portals.source_name(settings), settings.jurisdiction, **more)


def _read_progress(spark: SparkSession, path: str | None) -> DataFrame | None:
    if not path:
        return None
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema("source STRING, document_key STRING, status STRING, reason STRING, updated_at TIMESTAMP").parquet(path)

