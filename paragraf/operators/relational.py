"""Documents, sections, versions and embeddings in a relational database, by SQL upserts from the executors.

connect makes a DB-API connection; it is called once a task, so it must travel to the executors. Each document is one
transaction: its row is upserted, its sections and versions are replaced. A task that is run again writes the same
rows again. Statements are made of the column lists below, for PostgreSQL (with pgvector for embeddings) or SQLite.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.text import SPACES
from .store import document_rows, embedding_rows, keyed
from .vector import vector_literal

#: Table -> columns (name, kind, default or None where null is allowed, "!" where neither), and the key.
_TEXT, _TIME, _JSON, _INT = "text", "time", "json", "int"
COLUMNS: dict[str, tuple[list[tuple[str, str, str | None]], tuple[str, ...]]] = {
    "documents": ([("id", _TEXT, "!"), *((c, _TEXT, "''") for c in ("source_key", "title", "short_title", "jurisdiction", "type")), *((c, _TIME, None) for c in ("published_at", "effective_from", "effective_to")), ("source_url", _TEXT, "''"), ("metadata", _JSON, "'{}'"), ("document_json", _JSON, "'{}'"), ("updated_at", _TIME, "CURRENT_TIMESTAMP")], ("id",)),
    "sections": ([("document_id", _TEXT, "!"), ("section_index", _INT, "!"), *((c, _TEXT, "''") for c in ("identifier", "heading", "content")), ("references", _JSON, "'[]'"), ("norm_chains", _JSON, "'[]'")], ("document_id", "section_index")),
    "versions": ([("document_id", _TEXT, "!"), ("version_index", _INT, "!"), ("valid_from", _TIME, None), ("valid_to", _TIME, None)], ("document_id", "version_index")),
    "embeddings": ([("document_id", _TEXT, "!"), ("section_index", _INT, "!"), ("chunk_index", _INT, "!"), ("content", _TEXT, "''"), ("embedding", "vector", "!"), ("metadata", _JSON, "'{}'"), ("updated_at", _TIME, "CURRENT_TIMESTAMP")], ("document_id", "section_index", "chunk_index")),
}
_KINDS = {"postgres": {_TEXT: "TEXT", _TIME: "TIMESTAMPTZ", _JSON: "JSONB", _INT: "INTEGER", "vector": "VECTOR({})"}, "sqlite": {_TEXT: "TEXT", _TIME: "TEXT", _JSON: "TEXT", _INT: "INTEGER", "vector": "TEXT"}}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


@dataclass(frozen=True)
class Database:
    connect: Callable[[], object]
    schema: str = "public"
    flavour: str = "postgres"

    @property
    def _mark(self) -> str:
        return "%s" if self.flavour == "postgres" else "?"

    def table(self, name: str) -> str:
        schema = self.schema.strip(SPACES) or "public"
        return f"{quoted(schema)}.{quoted(name)}" if self.flavour == "postgres" else quoted(name)

    def _create(self, name: str, dims: int = 0) -> str:
        columns, key = COLUMNS[name]
        parts = []
        for column, kind, default in columns:
            needs = "" if default is None else " NOT NULL" if default == "!" else f" NOT NULL DEFAULT {default}"
            parts.append(f"{quoted(column)} {_KINDS[self.flavour][kind].format(dims)}{needs}")
        if name != "documents":
            parts.append(f"FOREIGN KEY ({quoted('document_id')}) REFERENCES {self.table('documents')} ({quoted('id')}) ON DELETE CASCADE")
        parts.append(f"PRIMARY KEY ({', '.join(map(quoted, key))})")
        return f"CREATE TABLE IF NOT EXISTS {self.table(name)} ({', '.join(parts)})"

    def schema_statements(self) -> list[str]:
        first = [f"CREATE SCHEMA IF NOT EXISTS {quoted(self.schema.strip(SPACES) or 'public')}"] if self.flavour == "postgres" else []
        return first + [self._create(n) for n in ("documents", "sections", "versions")]

    def vector_statements(self, dims: int) -> list[str]:
        if dims <= 0:
            raise ValueError("a vector table needs a number of dimensions above 0")
        return self.schema_statements() + (["CREATE EXTENSION IF NOT EXISTS vector"] if self.flavour == "postgres" else []) + [self._create("embeddings", dims)]

    def cosine_index_statement(self, name: str = "", lists: int = 1) -> str:
        return f"CREATE INDEX IF NOT EXISTS {quoted(name.strip(SPACES) or 'embeddings_embedding_cosine_ivfflat')} ON {self.table('embeddings')} USING ivfflat (embedding vector_cosine_ops) WITH (lists = {max(lists, 1)})"

    def upsert_statement(self, name: str) -> str:
        columns, key = COLUMNS[name]
        names = [c for c, _, _ in columns]
        values = ", ".join(f"CAST({self._mark} AS vector)" if kind == "vector" and self.flavour == "postgres" else self._mark for _, kind, _ in columns)
        changes = ", ".join(f"{quoted(c)} = excluded.{quoted(c)}" for c in names if c not in key)
        return f"INSERT INTO {self.table(name)} ({', '.join(map(quoted, names))}) VALUES ({values}) ON CONFLICT ({', '.join(map(quoted, key))}) DO UPDATE SET {changes}"

    def delete_statement(self, name: str) -> str:
        return f"DELETE FROM {self.table(name)} WHERE {quoted('document_id')} = {self._mark}"

    def _run(self, statements: list[str]) -> None:
        connection = self.connect()
        try:
            cursor = connection.cursor()
            for statement in statements:
                cursor.execute(statement)
            connection.commit()
        finally:
            connection.close()

    def init_schema(self) -> None:
        self._run(self.schema_statements())

    def init_vector_schema(self, dims: int) -> None:
        self._run(self.vector_statements(dims))

    def ensure_cosine_index(self, name: str = "", lists: int = 1) -> None:
        self._run([self.cosine_index_statement(name, lists)])

    def _value(self, kind: str, v: object) -> object:
        if kind == "vector":
            return vector_literal(v)
        return v.isoformat() if kind == _TIME and v is not None and self.flavour == "sqlite" else v

    def _each(self, rows: DataFrame, write: Callable[[object, Row], None]) -> None:
        """Each row is a transaction."""
        connect = self.connect

        def part(found: Iterator[Row]) -> None:
            connection = None
            try:
                for row in found:
                    connection = connection or connect()
                    try:
                        write(connection.cursor(), row)
                        connection.commit()
                    except BaseException:
                        connection.rollback()
                        raise
            finally:
                if connection is not None:
                    connection.close()

        rows.foreachPartition(part)

    def upsert_documents(self, docs: DataFrame, source_key: Column | str, order: str | None = None, workers: int = 4) -> None:
        """workers: connections at a time, about."""
        tables = document_rows(docs, source_key, order)
        gathered = tables["documents"]
        for name, at in (("sections", "section_index"), ("versions", "version_index")):
            rows = tables[name].withColumnRenamed("refs", "references") if name == "sections" else tables[name]
            own = rows.groupBy(F.col("document_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct(at, *[c for c in rows.columns if c not in (at, "document_id")]))).alias(name))
            gathered = gathered.join(own, "id", "left")

        def write(cursor: object, row: Row) -> None:
            cursor.execute(self.upsert_statement("documents"), tuple(self._value(kind, row[c]) for c, kind, _ in COLUMNS["documents"][0]))
            for name in ("sections", "versions"):
                cursor.execute(self.delete_statement(name), (row["id"],))
                for r in row[name] or []:
                    cursor.execute(self.upsert_statement(name), tuple(row["id"] if c == "document_id" else self._value(kind, r[c]) for c, kind, _ in COLUMNS[name][0]))

        self._each(gathered.coalesce(workers), write)

    def upsert_embeddings(self, rows: DataFrame, order: str | None = None, dims: int | None = None, workers: int = 4) -> None:
        def write(cursor: object, row: Row) -> None:
            cursor.execute(self.upsert_statement("embeddings"), tuple(self._value(kind, row[c]) for c, kind, _ in COLUMNS["embeddings"][0]))

        self._each(embedding_rows(rows, order, dims).coalesce(workers), write)

    def sink(self, source_key: str = "", source_name: str = "") -> Callable[[DataFrame], None]:
        """For ingest.run(): stores under source_key, else the ref's, else source_name."""
        return lambda docs: self.upsert_documents(*keyed(docs, source_key, source_name))


__all__ = ["COLUMNS", "Database", "quoted"]
