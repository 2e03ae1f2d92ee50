"""What several operators share: tables in the shared folder, checked broadcasts, bounded samples."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow side (ids and the like) is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Rows of one Arrow batch at most, where texts go to Python.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, a local master (tests) gets a folder of its own; a cluster, whose executors would not share it, gets an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="paragraf-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, deleted when the driver ends.

    Any executor can read it again after another is lost, and what is computed once is not computed anew by
    every use.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is deleted when the driver ends, if drop() didn't do so before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(drop, spark, path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended already
        pass


def narrow(df: DataFrame, weight: Column | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it is small, else as it is, for a shuffled join.

    Small is at most limit rows (counted), or where rows hold arrays: a sum of weight of at most limit.
    """
    size = df.limit(limit + 1).count() if weight is None else df.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    return F.broadcast(df) if size <= limit else df


def free_name(df: DataFrame, name: str) -> str:
    """name, with as many _ as it takes to be no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def small_batches(spark: SparkSession) -> None:
    """From here on the session sends at most BATCH_ROWS rows at once to Python: texts are long, and both sides hold a batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def documents(docs: DataFrame) -> DataFrame:
    """doc_id as BIGINT and text of docs, whatever other columns there are; rows without a doc_id are left out."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int = 17) -> DataFrame:
    """At most rows rows of df, those whose hashed key is least: the same ones however the table is partitioned.

    A count gives the hash below which about 1.5 times as many rows lie; only those are sorted and sent, so neither
    tasks nor the driver ever hold more than that of a table of any size. Where few keys repeat very often the sample
    can be smaller. Null keys are left out.
    """
    hashed, named = F.xxhash64(F.lit(seed), F.col(key)), df.where(F.col(key).isNotNull())
    total = named.select(key).count()
    if total > 2 * rows:
        named = named.where(hashed < F.lit(-(1 << 63) + int(1.5 * rows / total * (1 << 64))))
    return named.orderBy(hashed, key).limit(rows)
