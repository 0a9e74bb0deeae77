"""Tables that grow: rows by key in hash partitions, of which a change rewrites only those it touches.

A version of a table is one small file that names, for every hash partition, the folder that holds its rows.  A change
reads the partitions its keys fall into, writes them anew beside the old ones, and commits the next version, which
shares all other partitions with the one before.  The file is created only if it is absent, so of two writers one
commits and the other makes its change again on what the first one wrote.  Versions also remember the last batch of each
stream that wrote to them, so a batch that is run again changes nothing.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnbook.operators.leases import Lease, LeaseLost
from cairnbook.operators.sinks import SnapshotConflict, last_of_each
from cairnbook.session import create_if_absent, cut_lineage, hadoop_path

BUCKETS = 64
# Rows of one partition; tables that have grown beyond are dealt anew by :func:`compact`.
BUCKET_ROWS = 1_000_000
_BUCKET = "_bucket"


@dataclass(frozen=True)
class Version:
    """``places[k]`` is the folder of partition ``k`` below the table, or None if it holds no rows."""

    number: int
    key: list[str]
    schema: str
    places: list[str | None]
    batches: dict[str, int] = field(default_factory=dict)
    fence: int = 0

    @property
    def buckets(self) -> int:
        return len(self.places)


def _numbers(spark: SparkSession, base: str) -> list[int]:
    fs, folder = hadoop_path(spark, base)
    if not fs.exists(folder):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(folder))
    return sorted(int(n.removeprefix("_keyed-")) for n in names if n.startswith("_keyed-"))


def _file(base: str, number: int) -> str:
    return f"{base}/_keyed-{number:012d}"


def version(spark: SparkSession, base: str, number: int | None = None) -> Version | None:
    """A version of the table, by default the newest; None when there is none yet."""
    numbers = _numbers(spark, base)
    number = max(numbers, default=0) if number is None else number
    if number not in numbers:
        return None
    fs, place = hadoop_path(spark, _file(base, number))
    stream = fs.open(place)
    try:
        said = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    # Folders written by one change are named once.
    places = [None if at is None else f"{said['writes'][at]}/{_BUCKET}={k}" for k, at in enumerate(said["places"])]
    return Version(number, said["key"], said["schema"], places, said["batches"], said["fence"])


def _commit(spark: SparkSession, base: str, made: Version) -> None:
    writes = list(dict.fromkeys(p.split("/")[0] for p in made.places if p))
    at = {w: i for i, w in enumerate(writes)}
    said = {"key": made.key, "schema": made.schema, "writes": writes, "batches": made.batches, "fence": made.fence,
            "places": [None if p is None else at[p.split("/")[0]] for p in made.places]}
    if not create_if_absent(spark, _file(base, made.number), json.dumps(said)):
        raise SnapshotConflict(f"version {made.number} of {base} is taken")


def _bucket(key: list[str], count: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(count)).cast("int")


def _rows_of(spark: SparkSession, base: str, held: Version, buckets: list[int]) -> DataFrame:
    paths = [f"{base}/{held.places[k]}" for k in buckets if held.places[k]]
    schema = T.StructType.fromJson(json.loads(held.schema))
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read(spark: SparkSession, base: str, number: int | None = None) -> DataFrame | None:
    """All rows of a version, by default the newest; None when there is none yet."""
    held = version(spark, base, number)
    return None if held is None else _rows_of(spark, base, held, list(range(held.buckets)))


def lookup(spark: SparkSession, base: str, keys: DataFrame) -> DataFrame | None:
    """Rows whose key is among ``keys``; only the partitions of these keys are read."""
    held = version(spark, base)
    if held is None:
        return None
    wanted = keys.select(*held.key).distinct()
    touched = sorted(r[0] for r in wanted.select(_bucket(held.key, held.buckets)).distinct().collect())
    return _rows_of(spark, base, held, touched).join(wanted, held.key, "left_semi")


def _written(rows: DataFrame, base: str, key: list[str], count: int) -> tuple[str, set[int]]:
    """Folder of the rows, dealt into partitions, and which partitions have any."""
    spark, name = rows.sparkSession, f"snapshot-{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn(_BUCKET, _bucket(key, count)).repartition(parts, _BUCKET)
    dealt.write.mode("errorifexists").partitionBy(_BUCKET).parquet(f"{base}/{name}")
    fs, folder = hadoop_path(spark, f"{base}/{name}")
    found = (s.getPath().getName() for s in fs.listStatus(folder))
    return name, {int(n.split("=")[1]) for n in found if n.startswith(f"{_BUCKET}=")}


def change(rows: DataFrame, base: str, key: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], *,
           schema: T.StructType | None = None, buckets: int = BUCKETS, batch: tuple[str, int] | None = None, lease: Lease | None = None,
           keep: int = 2, max_age_seconds: float = 86_400, attempts: int = 5) -> Version:
    """Commit ``merge(stored, rows)``, where ``stored`` are the rows of all partitions that the keys of ``rows`` fall into.

    ``merge`` must leave every stored row where it is whose key is not among ``rows``.  ``schema`` is that of the table
    (default: that of ``rows``), ``buckets`` counts for a new table only.  ``batch`` names a stream and its batch:
    one that the table already has is left out.  A change under a ``lease`` is refused once a later lease has written.
    """
    spark = rows.sparkSession
    rows = cut_lineage(rows, "changes")
    for left in reversed(range(attempts)):
        held = version(spark, base)
        if held is None:
            held = Version(0, key, (schema or rows.schema).json(), [None] * buckets)
        if held.key != key:
            raise ValueError(f"the table {base} is keyed by {held.key}, not {key}")
        if lease is not None and held.fence > lease.number:
            raise LeaseLost(f"the table {base} was written under lease {held.fence}, after {lease.number}")
        if batch is not None and held.batches.get(batch[0], -1) >= batch[1]:
            return held
        touched = sorted(r[0] for r in rows.select(_bucket(key, held.buckets)).distinct().collect())
        if not touched and held.number:
            return held
        merged = merge(_rows_of(spark, base, held, touched), rows)
        name, filled = _written(merged, base, key, held.buckets)
        if not filled <= set(touched):
            raise ValueError("a change may only give rows to partitions it has keys in")
        places = list(held.places)
        for k in touched:
            places[k] = f"{name}/{_BUCKET}={k}" if k in filled else None
        made = Version(held.number + 1, key, held.schema, places, held.batches | dict([batch] if batch else []),
                       max(held.fence, lease.number if lease else 0))
        try:
            _commit(spark, base, made)
        except SnapshotConflict:
            fs, folder = hadoop_path(spark, f"{base}/{name}")
            fs.delete(folder, True)
            if not left:
                raise
            continue
        _forget(spark, base, keep, max_age_seconds)
        return made
    raise AssertionError("unreachable")


def _forget(spark: SparkSession, base: str, keep: int, max_age_seconds: float) -> None:
    """Drop versions that are neither among the newest nor young, and folders that no version left names."""
    fs, folder = hadoop_path(spark, base)
    now, numbers = time.time(), _numbers(spark, base)
    old = [n for n in numbers[:-keep] if now - fs.getFileStatus(hadoop_path(spark, _file(base, n))[1]).getModificationTime() / 1000 > max_age_seconds]
    if not old:
        return
    gone = {p.split("/")[0] for n in old for p in version(spark, base, n).places if p}
    live = {p.split("/")[0] for n in numbers if n not in old for p in version(spark, base, n).places if p}
    for n in old:
        fs.delete(hadoop_path(spark, _file(base, n))[1], False)
    for name in gone - live:
        fs.delete(hadoop_path(spark, f"{base}/{name}")[1], True)


def upsert(updates: DataFrame, base: str, key: list[str], seq: str | None = None, rank: str | None = None, **options) -> Version:
    """Rows of ``updates`` take the place of stored rows with their key.

    Of several updates of a key the last by ``seq`` counts.  With ``rank`` a stored row only gives way to one of at
    least its rank, as when shallow records are filled in later.
    """
    live = last_of_each(updates, key, seq if seq is not None else rank)

    def merge(stored: DataFrame, rows: DataFrame) -> DataFrame:
        if rank is not None:
            ranks = stored.select(*key, F.col(rank).alias("_held"))
            rows = rows.join(ranks, key, "left").where(F.col("_held").isNull() | (F.col(rank) >= F.col("_held"))).drop("_held")
        return stored.join(rows.select(*key), key, "left_anti").unionByName(rows.select(*stored.columns))

    return change(live, base, key, merge, **options)


def delete(keys: DataFrame, base: str, key: list[str], **options) -> Version:
    """The table without the rows of the given keys."""
    return change(keys.select(*key).distinct(), base, key, lambda stored, rows: stored.join(rows, key, "left_anti"), **options)


def rows_changed(spark: SparkSession, base: str, old: int, new: int) -> tuple[DataFrame, DataFrame]:
    """The rows of two versions in the partitions in which they differ; all others are the same files."""
    before, after = version(spark, base, old), version(spark, base, new)
    if before is None or before.buckets != after.buckets:
        empty = spark.createDataFrame([], T.StructType.fromJson(json.loads(after.schema)))
        return (empty if before is None else read(spark, base, old)), read(spark, base, new)
    other = [k for k in range(after.buckets) if before.places[k] != after.places[k]]
    return _rows_of(spark, base, before, other), _rows_of(spark, base, after, other)


def compact(spark: SparkSession, base: str, buckets: int | None = None, bucket_rows: int = BUCKET_ROWS, attempts: int = 5) -> Version:
    """All rows in one folder again, in as many partitions as they need; nothing else about the table changes."""
    for left in reversed(range(attempts)):
        held = version(spark, base)
        rows = read(spark, base, held.number)
        wanted = buckets or max(held.buckets, 1 << max(0, (rows.count() // bucket_rows).bit_length()))
        name, filled = _written(rows, base, held.key, wanted)
        places = [f"{name}/{_BUCKET}={k}" if k in filled else None for k in range(wanted)]
        try:
            made = Version(held.number + 1, held.key, held.schema, places, held.batches, held.fence)
            _commit(spark, base, made)
            return made
        except SnapshotConflict:
            fs, folder = hadoop_path(spark, f"{base}/{name}")
            fs.delete(folder, True)
            if not left:
                raise
    raise AssertionError("unreachable")


def upsert_catalog(updates: DataFrame, base: str, seq: str, id_key: str = "id", path_key: tuple[str, ...] = ("workspace_id", "path"),
                   **options) -> Version:
    """A catalog table after updates in ``seq`` order: an update replaces every row with its id or its workspace and path.

    The rows are partitioned by workspace and path.  A second table, by id, says where an id has ever been put, so
    rows that only share the id of an update are found without reading the rest.  It is written first and may name places
    that no row has (any more), which changes nothing.
    """
    spark, paths = updates.sparkSession, list(path_key)
    updates = cut_lineage(updates, "catalog_updates")
    columns = [c for c in updates.columns if c != seq]
    last = [updates.groupBy(*k).agg(F.max(seq).alias(seq)) for k in ([id_key], paths)]
    live = updates.join(last[0], [id_key, seq], "left_semi").join(last[1], [*paths, seq], "left_semi")
    live = last_of_each(live, paths, seq).select(*columns)
    known = updates.select(id_key, *paths).distinct()
    places = [id_key, *paths]
    change(known, f"{base}/ids", [id_key], lambda stored, rows: stored.unionByName(rows.select(*stored.columns)).distinct(), **options)
    ids = updates.select(id_key).distinct()
    moved = lookup(spark, f"{base}/ids", ids).select(*places)
    # All places a change can reach: those named by updates, and those where one of their ids has been.
    reach = moved.select(*paths).unionByName(updates.select(*paths)).distinct()
    marked = reach.join(live.withColumn("_live", F.lit(True)), paths, "left")

    def merge(stored: DataFrame, rows: DataFrame) -> DataFrame:
        kept = stored.join(ids, id_key, "left_anti").join(updates.select(*paths).distinct(), paths, "left_anti")
        return kept.unionByName(rows.where("_live").select(*stored.columns))

    return change(marked, base, paths, merge, schema=live.schema, **options)
