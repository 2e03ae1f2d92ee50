"""The corpus pipeline: documents to packed training sequences, in five stages. Part of paragraf.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Quality: documents the classifier rejects go. Near duplicates: one document of each group stays, that of least
doc_id. Benchmark: contaminated documents go. Secrets: they are replaced by [SECRET] in texts that all stay. Packing:
pieces of documents with their places in sequences.

Any stage takes any table of documents. Texts that are null, empty or without a word go in the quality stage. Rows
without a doc_id pass the stages before packing, which takes none of them. Rows that repeat a doc_id with the same text
become one in the near-duplicate stage; with other texts they are documents of their own, but go all if one of them is
contaminated. Very long texts are read whole and packed in pieces. Other columns, whatever their names, stay as they
are up to packing. Equal texts: the least doc_id stays. An empty table gives an empty table. Where labels hold no two
positives, the quality stage keeps all texts that have a word.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paragraf.llm import decontam, jaccard, packing, quality, secretscan
from paragraf.llm.common import table, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secretscan.redact(docs, secretscan.fit())


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good_documents),
    ("near duplicates", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: Trained models and the packing plan are beyond SQL; tests hold each stage against a brute-force version, and run() against its stages.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
