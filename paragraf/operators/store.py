"""Documents, sections, versions and embeddings as tables that take upserts.

An upsert appends one batch of rows to every table and makes it visible with one commit file, so it writes as much as
it changes, whatever the tables hold, and is there whole or not at all. A read takes, of each key, the rows of the
last committed batch that has it. compact() writes all that is current as one batch that the ones before no longer
count with. A commit file appears whole and under a number of its own: of two writers that commit the same number the
later one takes the next, unless it compacts, which fails without a trace. A writer that dies before leaves files that no
commit names, and nothing that others wait for.
"""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import ensured_versions, filled_range
from ..functions.text import first_non_blank, non_blank, trimmed
from .export import document_json

TABLES = {
    "documents": "id STRING, source_key STRING, title STRING, short_title STRING, jurisdiction STRING, type STRING, published_at TIMESTAMP, effective_from TIMESTAMP, effective_to TIMESTAMP, source_url STRING, metadata STRING, document_json STRING, updated_at TIMESTAMP",
    "sections": "document_id STRING, section_index INT, identifier STRING, heading STRING, content STRING, refs STRING, norm_chains STRING",
    "versions": "document_id STRING, version_index INT, valid_from TIMESTAMP, valid_to TIMESTAMP",
    "embeddings": "document_id STRING, section_index INT, chunk_index INT, content STRING, embedding ARRAY<FLOAT>, metadata STRING, updated_at TIMESTAMP",
}
#: Batches that a read takes at most, about; then they are made one.
COMPACT_AFTER = 64
#: Ids that repeat in a batch, up to which they are broadcast.
BROADCAST_IDS = 100_000
_CHUNK = ["document_id", "section_index", "chunk_index"]


def persistable_id(doc_id: Column | str, url: Column | str, title: Column | str) -> Column:
    """The id, else a digest of the URL or else the title, else null."""
    basis = F.coalesce(non_blank(url), non_blank(title))
    return F.coalesce(non_blank(doc_id), F.concat(F.lit("doc-"), F.substring(F.sha1(basis), 1, 16)))


def last_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of each key the row of greatest order, without that column. Null keys are keys of their own."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_r")) if rest else rows.select(*keys).distinct()
    return last.select(*keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*[c for c in rows.columns if c != order])


def upserted(target: DataFrame, batch: DataFrame, keys: list[str], order: str) -> DataFrame:
    """target with the rows of batch in place of those of equal keys; of equal keys in batch the last by order."""
    new = last_of_each(batch, keys, order)
    return target.join(new.select(*keys), keys, "left_anti").unionByName(new)


def _json(c: Column, empty: str) -> Column:
    return F.coalesce(F.to_json(c, {"ignoreNullFields": "false"}), F.lit(empty))


def keyed(docs: DataFrame, source_key: str, source_name: str) -> tuple[DataFrame, Column]:
    """docs, and the key to store each under: source_key, else the one of its ref (a column, if there is one), else source_name."""
    own = F.col("source_key") if "source_key" in docs.columns else F.lit(None).cast("string")
    return docs.withColumn("_source", first_non_blank(F.lit(source_key), own, F.lit(source_name))).drop("source_key"), F.col("_source")


def document_rows(docs: DataFrame, source_key: Column | str, order: str | None = None) -> dict[str, DataFrame]:
    """docs: the document columns. Of equal ids the last by order (without order: by the whole document).

    A document that has neither id, URL nor title fails the whole batch. Null rows don't occur; blanks are kept.
    """
    key = non_blank(F.lit(source_key) if isinstance(source_key, str) else source_key)
    named = docs.withColumn("id", persistable_id("id", "source_url", "title"))
    repeated = named.groupBy("id").agg(F.count("*").alias("n"))
    nameless, many = repeated.agg(F.coalesce(F.bool_or(F.col("id").isNull()), F.lit(False)), F.count_if(F.col("n") > 1)).first()
    if nameless:
        raise ValueError("a document needs an id, a URL or a title")
    versions = ensured_versions(F.col("versions"), F.col("effective_from"), F.col("published_at"), F.col("effective_to"))
    named = named.withColumn("versions", versions)
    start, end = filled_range(F.col("versions"), F.col("effective_from"), F.col("effective_to"))
    whole = named.withColumns({"effective_from": start, "effective_to": end}).withColumns({"_json": document_json(), "source_key": F.coalesce(key, F.lit(""))})
    whole = whole.withColumn("_order", F.col(order) if order else F.col("_json"))
    whole = whole.drop(order) if order else whole
    one = whole.drop("_order")
    if many:  # only documents of ids that repeat are compared, so that texts of others stay where they are
        repeated = repeated.where("n > 1").select("id")
        repeated = F.broadcast(repeated) if many <= BROADCAST_IDS else repeated
        one = one.join(repeated, "id", "left_anti").unionByName(last_of_each(whole.join(repeated, "id", "left_semi"), ["id"], "_order"))
    text = lambda n: trimmed(F.coalesce(F.col(n), F.lit(""))).alias(n)
    documents = one.select("id", "source_key", *[text(n) for n in ("title", "short_title", "jurisdiction")], F.coalesce("type", F.lit("")).alias("type"), "published_at", "effective_from", "effective_to", text("source_url"), _json(F.map_from_entries(F.array_sort(F.map_entries("metadata"))), "{}").alias("metadata"), F.col("_json").alias("document_json"), F.current_timestamp().alias("updated_at"))
    part = lambda n: trimmed(F.coalesce(F.col("s")[n], F.lit(""))).alias(n)
    sections = one.select(F.col("id").alias("document_id"), F.posexplode("sections").alias("section_index", "s")).select("document_id", "section_index", part("identifier"), part("heading"), part("content"), _json(F.col("s.refs"), "[]").alias("refs"), _json(F.col("s.norm_chains"), "[]").alias("norm_chains"))
    windows = one.select(F.col("id").alias("document_id"), F.posexplode("versions").alias("version_index", "v")).select("document_id", "version_index", "v.valid_from", "v.valid_to")
    return {"documents": documents, "sections": sections, "versions": windows}


def embedding_rows(rows: DataFrame, order: str | None = None, dims: int | None = None) -> DataFrame:
    """rows: document_id, section_index, chunk_index, content, embedding, metadata (a map). Unusable vectors fail the batch."""
    vector = F.col("embedding").cast("array<float>")
    finite = F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(vector) > 0), F.lit(False))
    if not rows.where(~finite if dims is None else ~(finite & (F.size(vector) == dims))).isEmpty():
        raise ValueError("a vector must not be empty, must be finite and as long as the table's")
    new = rows.select(F.trim("document_id").alias("document_id"), F.col("section_index").cast("int").alias("section_index"), F.col("chunk_index").cast("int").alias("chunk_index"), F.coalesce("content", F.lit("")).alias("content"), vector.alias("embedding"), _json(F.map_from_entries(F.array_sort(F.map_entries("metadata"))), "{}").alias("metadata"), F.current_timestamp().alias("updated_at"), (F.col(order) if order else F.to_json(F.struct("content"))).alias("_order"))
    return last_of_each(new, _CHUNK, "_order")


class Store:
    """The four tables below a folder, which all executors share. After compact_after batches an upsert compacts."""

    def __init__(self, spark: SparkSession, base: str, compact_after: int = COMPACT_AFTER) -> None:
        self.spark, self.base, self.compact_after = spark, base.rstrip("/"), compact_after
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/_commits")
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs.mkdirs(path)

    def _commits(self) -> list[tuple[int, str, bool]]:
        """(number, folder of the batch, whether it stands for all before)."""
        names = [str(s.getPath().getName()) for s in self._fs.listStatus(self._path(f"{self.base}/_commits"))]
        found = []
        for name in sorted(n for n in names if n.endswith(".commit")):
            kind, batch = self._content(name).split()
            found.append((int(name.removesuffix(".commit")), batch, kind == "all"))
        last = max((k for k, (_, _, whole) in enumerate(found) if whole), default=0)
        return found[last:]

    def _content(self, name: str) -> str:
        stream = self._fs.open(self._path(f"{self.base}/_commits/{name}"))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _appear(self, part: object, number: int) -> bool:
        """Gives a written file its commit's name, if no other has it: a rename that never replaces, or on a local disk a link."""
        whole = self._path(f"{self.base}/_commits/{number:012d}.commit")
        if self._fs.getScheme() == "file":
            try:
                os.link(part.toUri().getPath(), whole.toUri().getPath())
            except FileExistsError:
                return False
            self._fs.delete(part, False)
            return True
        if self._fs.exists(whole):
            return False
        jvm = self.spark._jvm
        try:
            none = jvm.org.apache.hadoop.fs.Options.Rename.valueOf("NONE")
            names = self.spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            names[0] = none
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(whole.toUri(), self.spark._jsc.hadoopConfiguration()).rename(part, whole, names)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def _commit(self, batch: str, whole: bool, seen: list[tuple[int, str, bool]]) -> None:
        part = self._path(f"{self.base}/_commits/{batch}.part")
        stream = self._fs.create(part, False)
        stream.write(bytearray(f"{'all' if whole else 'add'} {batch}".encode()))
        stream.close()
        number = max((n for n, _, _ in seen), default=0) + 1
        while not self._appear(part, number):
            if whole:
                self._fs.delete(part, False)
                raise RuntimeError(f"batch {number} was committed by another writer; try again")
            number += 1

    def _write(self, tables: dict[str, DataFrame], whole: bool = False, seen: list[tuple[int, str, bool]] | None = None) -> None:
        seen, batch = self._commits() if seen is None else seen, uuid.uuid4().hex
        for name, rows in tables.items():
            rows.write.parquet(f"{self.base}/{name}/{batch}")
        self._commit(batch, whole, seen)
        if not whole and len(seen) >= self.compact_after:
            try:
                self.compact()
            except RuntimeError:  # another writer came in between; the next batch tries again
                pass

    def _rows(self, name: str, commits: list[tuple[int, str, bool]]) -> DataFrame:
        """All committed rows of a table with the number of their batch, in one scan."""
        there = [(number, batch) for number, batch, _ in commits if self._fs.exists(self._path(f"{self.base}/{name}/{batch}"))]
        if not there:
            return self.spark.createDataFrame([], TABLES[name] + ", _batch BIGINT")
        rows = self.spark.read.schema(TABLES[name]).parquet(*[f"{self.base}/{name}/{batch}" for _, batch in there])
        numbers = F.create_map(*[F.lit(x) for number, batch in there for x in (batch, number)])
        return rows.withColumn("_batch", numbers[F.regexp_extract("_metadata.file_path", f"/{name}/([0-9a-f]{{32}})/", 1)].cast("bigint"))

    def _read(self, name: str, commits: list[tuple[int, str, bool]]) -> DataFrame:
        rows = self._rows(name, commits)
        if len(commits) < 2:
            return rows.drop("_batch")
        if name == "embeddings":
            return last_of_each(rows, _CHUNK, "_batch")
        docs = rows if name == "documents" else self._rows("documents", commits)
        replaced = docs.groupBy(F.col("id").alias("_id")).agg(F.min("_batch").alias("_first"), F.max("_batch").alias("_last")).where("_first < _last")
        key = "id" if name == "documents" else "document_id"
        return rows.join(replaced, (F.col(key) == F.col("_id")) & (F.col("_batch") < F.col("_last")), "left_anti").drop("_batch")

    def read(self, name: str) -> DataFrame:
        return self._read(name, self._commits())

    def upsert_documents(self, docs: DataFrame, source_key: Column | str, order: str | None = None) -> None:
        """As document_rows(), and visible at once."""
        self._write(document_rows(docs, source_key, order))

    def upsert_embeddings(self, rows: DataFrame, order: str | None = None, dims: int | None = None) -> None:
        """As embedding_rows(), and visible at once."""
        self._write({"embeddings": embedding_rows(rows, order, dims)})

    def compact(self) -> None:
        """What is current becomes one batch. Older files stay until vacuum()."""
        seen = self._commits()
        if seen:
            self._write({name: self._read(name, seen) for name in TABLES}, True, seen)

    def vacuum(self) -> None:
        """Deletes batches that no commit counts with. Not while others read or write."""
        live = {batch for _, batch, _ in self._commits()}
        for name in TABLES:
            where = self._path(f"{self.base}/{name}")
            for s in self._fs.listStatus(where) if self._fs.exists(where) else []:
                if str(s.getPath().getName()) not in live:
                    self._fs.delete(s.getPath(), True)

    def sink(self, source_key: str = "", source_name: str = ""):
        """For ingest.run(): stores under source_key, else the ref's, else source_name."""
        return lambda docs: self.upsert_documents(*keyed(docs, source_key, source_name))


__all__ = ["TABLES", "Store", "document_rows", "embedding_rows", "last_of_each", "persistable_id", "upserted"]
