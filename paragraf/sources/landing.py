"""Landing directories: fetched payloads as files, read again as tables, as streams, or in a fetcher's place."""

from __future__ import annotations

import hashlib
import io
import os
import zipfile
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .http import Fetcher


def file_name(url: str) -> str:
    """A file's name for a URL, one to one; of long ones the digest."""
    name = quote(url, safe="")
    return name if len(name) <= 200 else "sha256-" + hashlib.sha256(url.encode()).hexdigest()


def land(base: str, url: str, payload: bytes) -> str:
    os.makedirs(base, exist_ok=True)
    path = os.path.join(base, file_name(url))
    with open(path + ".part", "wb") as f:
        f.write(payload)
    os.replace(path + ".part", path)
    return path


def replay(base: str) -> Fetcher:
    """A fetcher that reads what land() has written; 404 for what isn't there."""

    def fetch(url: str) -> tuple[int, bytes]:
        try:
            with open(os.path.join(base, file_name(url)), "rb") as f:
                return 200, f.read()
        except FileNotFoundError:
            return 404, b""

    return fetch


def payloads(spark: SparkSession, base: str, stream: bool = False) -> DataFrame:
    """path, name, payload, landed_at of a directory's files; as a stream of new ones if asked."""
    reader = spark.readStream if stream else spark.read
    if stream:
        reader = reader.schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")
    files = reader.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("content").alias("payload"), F.col("modificationTime").alias("landed_at"))


def first_xml(raw: bytes | None) -> bytes | None:
    """Content of an archive's first file that ends in .xml; null if there is none or it is no archive."""
    if not raw:
        return None
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            name = next((n for n in z.namelist() if n.lower().endswith(".xml")), None)
            return z.read(name) if name else None
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError):
        return None


def unzipped(raw: Column | str) -> Column:
    # Made here and not in the module, which replay() takes to the executors: a used function can't travel.
    @F.pandas_udf(BinaryType())
    def each(column: pd.Series) -> pd.Series:
        return pd.Series([first_xml(bytes(x) if x is not None else None) for x in column], dtype=object)

    return each(F.col(raw) if isinstance(raw, str) else raw)
