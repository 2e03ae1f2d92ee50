"""Documents that land as files, taken up as they come: a file stream, parsed and upserted batch by batch.

The checkpoint remembers which files are done, so a query that starts again goes on where it was. A batch that is run
twice upserts the same documents twice, which changes nothing. Files that don't parse go to the failures table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import completed
from ..operators.store import Store
from ..sources.landing import payloads


def upsert_landing(spark: SparkSession, landing: str, store: Store, parse: Callable[[Column], Column], checkpoint: str, source: str, jurisdiction: str, failures: str, once: bool = True) -> StreamingQuery:
    """A running query; once: it ends when all files that are there are done. The path stands for the URL."""
    files = payloads(spark, landing, stream=True)

    def take(batch: DataFrame, number: int) -> None:
        parsed = batch.withColumn("d", parse(F.col("payload")))
        blank = F.lit("")
        docs = parsed.select("path", completed(F.col("d"), blank, blank, F.col("path"), jurisdiction).alias("d")).persist()
        bad = docs.where("d.error IS NOT NULL").select("path", F.col("d.error").alias("reason"), F.lit(number).cast("bigint").alias("batch"))
        bad.write.mode("overwrite").parquet(f"{failures}/batch={number}")
        # Of files with one id the last path wins.
        store.upsert_documents(docs.where("d.error IS NULL").select("path", "d.*").drop("error"), source, order="path")
        docs.unpersist()

    writer = files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
