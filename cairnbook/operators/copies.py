"""Parquet copies of text tables: a file is read as text once, and by its copy ever after.

A copy belongs to a state of its source: path, newest change and size of all its files.  The first job that wants it takes
the copy's lease, converts and says so in a file; others that come meanwhile wait for that, so several jobs make
one copy.  A source that changes gets another copy.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnbook.operators import preview, profile
from cairnbook.operators.leases import held
from cairnbook.session import create_if_absent, hadoop_path
from cairnbook.sources.listing import list_files
from cairnbook.sources.readers import read_csv_ladder, read_table

WAIT_SECONDS = 3600.0


def source_state(spark: SparkSession, path: str) -> str:
    """Name of what a file or folder holds now: it changes with any of its paths, times and sizes."""
    files = list_files(spark, path, "*").where(~F.substring_index("path", "/", -1).rlike("^[._]"))
    digest = F.sha2(F.concat_ws("\0", "path", F.col("size_bytes").cast("string"), F.unix_micros("modified").cast("string")), 256)
    words = [F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)")) for at in (1, 16)]
    count, *sums = files.agg(F.count(F.lit(1)), *words).first()
    if not count:
        raise FileNotFoundError(path)
    return hashlib.sha256(json.dumps([path.rstrip("/"), count, *map(str, sums)]).encode()).hexdigest()


def _done(spark: SparkSession, entry: str) -> dict | None:
    fs, place = hadoop_path(spark, f"{entry}/_done")
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _format(path: str, fmt: str | None) -> str:
    ext = path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")[2].lower()
    return fmt or (ext if ext in ("parquet", "csv", "tsv", "json", "jsonl", "ndjson", "xlsx") else "csv")


def parquet_copy(spark: SparkSession, path: str, cache: str, fmt: str | None = None, wait: float = WAIT_SECONDS) -> tuple[str, bool]:
    """Folder of the fresh Parquet copy of a text table, and whether this call made it."""
    entry = f"{cache}/{source_state(spark, path)}"
    said = _done(spark, entry)
    if said is not None:
        return f"{entry}/{said['data']}", False
    with held(spark, entry, wait=wait) as lease:
        said = _done(spark, entry)
        if said is not None:  # made while this job waited
            return f"{entry}/{said['data']}", False
        name, kind = f"data-{uuid.uuid4().hex}", _format(path, fmt)
        if kind == "csv":
            read_csv_ladder(spark, path, f"{entry}/{name}")
        else:
            read_table(spark, path, kind).write.option("compression", "zstd").parquet(f"{entry}/{name}")
        lease.check()
        if not create_if_absent(spark, f"{entry}/_done", json.dumps({"data": name, "lease": lease.number})):
            name = _done(spark, entry)["data"]  # a job that had the lease before has come to its end after all
    return f"{entry}/{name}", True


def table(spark: SparkSession, path: str, cache: str, fmt: str | None = None) -> DataFrame:
    """A table by path: Parquet as it lies there, text by its copy."""
    if _format(path, fmt) == "parquet":
        return spark.read.parquet(path)
    return spark.read.parquet(parquet_copy(spark, path, cache, fmt)[0])


def profile_path(spark: SparkSession, path: str, cache: str, fmt: str | None = None, exact: bool = False) -> DataFrame:
    """Profile of a table by path; of text only the first one reads it."""
    return profile.profile(table(spark, path, cache, fmt), exact)


def preview_path(spark: SparkSession, path: str, cache: str, order_by: list[Column], fmt: str | None = None, **options) -> DataFrame:
    """First rows of a table by path, shown as text."""
    return preview.preview(table(spark, path, cache, fmt), order_by, **options)
