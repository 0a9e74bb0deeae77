"""Writing: conversion to Parquet, upserts, caches, deletes, publishing, snapshots, bundles."""

from __future__ import annotations

import posixpath
import time
import uuid
from collections.abc import Callable
from itertools import chain, count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairnbook.operators.numbering import number_rows
from cairnbook.session import create_if_absent, hadoop_path
from cairnbook.sources.catalog import count_lines, scan_files
from cairnbook.sources.readers import csv_files, read_csv_ladder, read_table

# Version of the export bundle, queries exported.
BUNDLE_VERSION = "1.0"
BUNDLE_QUERIES = 500


def _bytes(spark: SparkSession, path: str) -> int:
    fs, p = hadoop_path(spark, path)
    return int(fs.getContentSummary(p).getLength())


def free_target(spark: SparkSession, folder: str, stem: str) -> str:
    """``stem.parquet``, else ``stem-converted-1.parquet`` and so on; existing files stay."""
    fs, place = hadoop_path(spark, folder)
    taken = {s.getPath().getName() for s in fs.listStatus(place)} if fs.exists(place) else set()
    names = chain([f"{stem}.parquet"], (f"{stem}-converted-{i}.parquet" for i in count(1)))
    return f"{folder.rstrip('/')}/{next(n for n in names if n not in taken)}"


def convert(spark: SparkSession, source: str, folder: str) -> dict:
    """Convert a table file to zstd Parquet beside others; returns target, both sizes, rows, and rows left out.

    The output committer publishes the files only when every task has finished.
    """
    stem, ext = posixpath.splitext(posixpath.basename(source.rstrip("/")))
    ext = ext.lstrip(".").lower()
    if ext == "parquet":
        raise ValueError("file is already Parquet")
    target, headed = free_target(spark, folder, stem), True
    if ext == "csv":
        _, rung = read_csv_ladder(spark, source, target)
        headed = rung != 3
    else:
        read_table(spark, source, ext).write.mode("errorifexists").option("compression", "zstd").parquet(target)
    rows = spark.read.parquet(target).count()
    return {"target": target, "source_bytes": _bytes(spark, source), "target_bytes": _bytes(spark, target),
            "rows": rows, "dropped_rows": max(records_in(spark, source, ext, headed) - rows, 0)}


def records_in(spark: SparkSession, source: str, ext: str, headed: bool = True) -> int:
    """Records of a table file, or of a folder of them, that a reader could take, those it cannot read included."""
    files = csv_files(spark, source).withColumn("file_format", F.lit(ext))
    if ext in ("csv", "tsv"):
        lines = int(count_lines(files).agg(F.sum("lines")).first()[0] or 0)
        return lines - (files.count() if headed else 0)
    found = scan_files(spark, files).agg(F.sum("row_count"), F.sum(F.coalesce(
        F.regexp_extract("error", r"^([0-9]+) of its records", 1).try_cast("long"), F.lit(0)))).first()
    return int(found[0] or 0) + int(found[1] or 0)


def _latest(updates: DataFrame, key: list[str], seq: str) -> DataFrame:
    return updates.groupBy(*key).agg(F.max(seq).alias(seq))


def last_of_each(updates: DataFrame, key: list[str], seq: str | None = None) -> DataFrame:
    """One row per key: the last by ``seq``; among equals the greatest row, so that a second run chooses the same."""
    rest = F.struct(*[c for c in updates.columns if c not in key])
    order = rest if seq is None else F.struct(F.col(seq), rest)
    return updates.groupBy(*key).agg(F.max_by(rest, order).alias("_last")).select(*key, "_last.*").select(*updates.columns)


def upsert_catalog(base: DataFrame, updates: DataFrame, seq: str, id_key: str = "id",
                   path_key: tuple[str, ...] = ("workspace_id", "path")) -> DataFrame:
    """Catalog after applying updates in ``seq`` order.

    An update replaces every row with its id or with its workspace and path.  Thus an
    update survives when it is the last one for both of its keys, and a base row when
    no update has either key.  Last positions are found by mergeable maxima and joined
    back on (key, seq), so many updates of one key do not meet in one task.
    """
    paths = list(path_key)
    live = (updates.join(_latest(updates, [id_key], seq), [id_key, seq], "left_semi")
            .join(_latest(updates, paths, seq), [*paths, seq], "left_semi"))
    kept = (base.join(updates.select(id_key).distinct(), id_key, "left_anti")
            .join(updates.select(*paths).distinct(), paths, "left_anti"))
    return kept.select(*base.columns).unionByName(live.select(*base.columns))


def upsert_keyed(base: DataFrame, updates: DataFrame, key: list[str], seq: str) -> DataFrame:
    """Cache table after its updates; the last one per key counts, among equal ones the greatest row."""
    live = last_of_each(updates, key, seq)
    kept = base.join(updates.select(*key).distinct(), key, "left_anti")
    return kept.select(*base.columns).unionByName(live.select(*base.columns))


def cache_get(wanted: DataFrame, cache: DataFrame, key: list[str], payload_schema: StructType | str,
              payload: str = "payload_json") -> DataFrame:
    """Cached payloads for files whose time and size still match.

    ``wanted`` and ``cache`` have ``key…, mtime, size_bytes``.  ``payload`` is null, a miss,
    when nothing fresh is cached or the cached text does not parse.
    """
    fresh = cache.select(*key, "mtime", "size_bytes", F.from_json(
        F.col(payload), payload_schema, {"mode": "PERMISSIVE"}).alias("_p"), F.col(payload).alias("_raw"))
    sound = F.when(F.try_parse_json("_raw").isNotNull(), F.col("_p"))
    joined = wanted.join(fresh, [*key, "mtime", "size_bytes"], "left")
    return joined.select(*wanted.columns, sound.alias("payload"), sound.isNotNull().alias("hit"))


def delete_under(table: DataFrame, path: str, column: str = "path", scope: Column | None = None,
                 sibling_safe: bool = True) -> DataFrame:
    """Table without rows at a path or below it; other workspaces stay when scoped.

    ``sibling_safe`` keeps ``/ab`` when ``/a`` is deleted; without it any common beginning counts.
    """
    c = F.col(column)
    root = path.rstrip("/")
    hit = ((c == root) | c.startswith(root + "/")) if sibling_safe else c.startswith(path)
    if scope is not None:
        hit = hit & scope
    return table.where(~F.coalesce(hit, F.lit(False)))


def publish_view(datasets: DataFrame, root: str | None, include_text: bool = False, path: str = "relative_path",
                 text: str = "document_text") -> DataFrame:
    """Records as published: paths carry their source root, document text stays private."""
    p = F.col(path)
    out = datasets
    if root is not None and "://" in root:
        out = out.withColumn(path, F.when(p.contains("://"), p).otherwise(
            F.concat(F.lit(root.rstrip("/") + "/"), p)))
    elif root is not None and root.strip("/"):
        out = out.withColumn(path, F.concat(F.lit(root.strip("/") + "/"), p))
    return out if include_text else out.withColumn(text, F.lit(None).cast("string"))


def register_sources(existing: DataFrame, offered: DataFrame, address: str = "address",
                     order: str = "sort_order", seq: str = "seq") -> DataFrame:
    """Sources after registering offers; known addresses keep their entry.

    ``existing(id, address, sort_order)``, ``offered(id, address, seq)``.  An offer without
    address is always new.  New entries are numbered on from the highest order in use.
    """
    addressed = offered.where(F.col(address).isNotNull())
    first = addressed.join(addressed.groupBy(address).agg(F.min(seq).alias(seq)), [address, seq], "left_semi")
    fresh = first.join(existing.select(address).where(F.col(address).isNotNull()).distinct(), address, "left_anti")
    fresh = fresh.unionByName(offered.where(F.col(address).isNull()).select(*fresh.columns))
    top = existing.agg(F.max(order)).first()[0]
    numbered = number_rows(fresh, [F.col(seq).asc()], order, 0 if top is None else int(top) + 1)
    return existing.unionByName(numbered.select(*existing.columns))


class SnapshotConflict(RuntimeError):
    """Another writer committed the version this one was going to write."""


def _versions(spark: SparkSession, base: str) -> list[int]:
    fs, folder = hadoop_path(spark, base)
    if not fs.exists(folder):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(folder))
    return sorted(int(n.removeprefix("_version-")) for n in names if n.startswith("_version-"))


def _version(spark: SparkSession, base: str, number: int) -> tuple[str, str]:
    """Folder of a version and the tag it was committed with."""
    fs, place = hadoop_path(spark, f"{base}/_version-{number:012d}")
    stream = fs.open(place)
    try:
        name, tag = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
    finally:
        stream.close()
    return name, tag


def commit_snapshot(df: DataFrame, base: str, keep: int = 2, based_on: int | None = None, tag: str = "-",
                    max_age_seconds: float = 86_400) -> str:
    """Write the next version of a table.

    A version is a folder of files and a small file that names it, created only if it is absent: of two writers that
    both build on version n, one becomes n + 1 and the other gets a :class:`SnapshotConflict` and leaves nothing.
    ``based_on`` is the version the rows were made from (default: the newest).  The newest ``keep`` versions stay,
    and so does every version younger than ``max_age_seconds``, so readers of an older one can finish.
    """
    spark = df.sparkSession
    if based_on is None:
        based_on = max(_versions(spark, base), default=0)
    name = f"snapshot-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(f"{base}/{name}")
    fs = hadoop_path(spark, base)[0]
    if not create_if_absent(spark, f"{base}/_version-{based_on + 1:012d}", f"{name} {tag}"):
        fs.delete(hadoop_path(spark, f"{base}/{name}")[1], True)
        raise SnapshotConflict(f"version {based_on + 1} of {base} is taken")
    for old in _versions(spark, base)[:-keep]:
        pointer = hadoop_path(spark, f"{base}/_version-{old:012d}")[1]
        if time.time() - fs.getFileStatus(pointer).getModificationTime() / 1000 > max_age_seconds:
            gone = _version(spark, base, old)[0]
            fs.delete(pointer, False)
            fs.delete(hadoop_path(spark, f"{base}/{gone}")[1], True)
    return f"{base}/{name}"


def update_snapshot(spark: SparkSession, base: str, make: Callable[[DataFrame | None], DataFrame], tag: str = "-",
                    attempts: int = 5) -> str:
    """Commit ``make(current version)``; if another writer was faster, make it again from what that one wrote."""
    for left in reversed(range(attempts)):
        number = max(_versions(spark, base), default=0)
        try:
            return commit_snapshot(make(read_snapshot(spark, base, number)), base, based_on=number, tag=tag)
        except SnapshotConflict:
            if not left:
                raise


def has_tag(spark: SparkSession, base: str, tag: str) -> bool:
    """Whether a version still kept was committed with ``tag``."""
    return any(_version(spark, base, n)[1] == tag for n in _versions(spark, base))


def read_snapshot(spark: SparkSession, base: str, number: int | None = None) -> DataFrame | None:
    """A version of a table, by default the newest; None when there is none yet.  Tables in hash partitions are read, too."""
    from cairnbook.operators import keyed  # which builds on this module

    if keyed.version(spark, base, number) is not None:
        return keyed.read(spark, base, number)
    if number is None:
        number = max(_versions(spark, base), default=0)
    return spark.read.parquet(f"{base}/{_version(spark, base, number)[0]}") if number else None


def export_bundle(folders: DataFrame, datasets: DataFrame, history: DataFrame, workspace: str,
                  order: str = "timestamp") -> DataFrame:
    """``(kind, body)`` lines of an export: header, folders, all datasets, newest queries.

    One JSON line per entry, so the export is written by many tasks.
    """
    spark = folders.sparkSession

    def lines(df: DataFrame, kind: str) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("body"))

    header = spark.range(1).select(F.lit(BUNDLE_VERSION).alias("version"), F.lit(workspace).alias("workspace_id"))
    recent = history.orderBy(F.desc(order)).limit(BUNDLE_QUERIES)
    return (lines(header, "header").unionByName(lines(folders, "folder"))
            .unionByName(lines(datasets, "dataset")).unionByName(lines(recent, "query")))


def bundle_part(bundle: DataFrame, kind: str, schema: StructType | str) -> DataFrame:
    """Entries of one kind; lines that do not parse are left out."""
    return bundle.where(F.col("kind") == kind).select(
        F.from_json("body", schema).alias("e")).where(F.col("e").isNotNull()).select("e.*")


def import_folders(current: DataFrame, imported: DataFrame, strategy: str = "merge",
                   key: str = "path") -> tuple[DataFrame, DataFrame]:
    """Folders after an import, and one row ``(added, skipped, replaced)``.

    ``overwrite`` takes the imported list; ``merge`` and ``skip`` add unknown paths only.
    """
    if strategy == "overwrite":
        n = F.count(F.lit(1))
        return imported, imported.agg(n.alias("added"), F.lit(0).cast("long").alias("skipped"), n.alias("replaced"))
    known = current.select(key).distinct().withColumn("_known", F.lit(True))
    marked = imported.join(known, key, "left")
    counts = marked.agg(F.count_if(F.col("_known").isNull()).alias("added"),
                        F.count_if(F.col("_known").isNotNull()).alias("skipped"),
                        F.lit(0).cast("long").alias("replaced"))
    fresh = marked.where(F.col("_known").isNull()).drop("_known")
    return current.unionByName(fresh.select(*current.columns)), counts


def import_warnings(bundle: DataFrame, workspace: str) -> DataFrame:
    """``(warning)`` rows for another version or workspace than expected."""
    head = bundle_part(bundle, "header", "version string, workspace_id string")
    version = F.when(F.col("version") != BUNDLE_VERSION, F.concat(
        F.lit("bundle version "), "version", F.lit(f" instead of {BUNDLE_VERSION}")))
    other = F.when(F.col("workspace_id") != workspace, F.concat(
        F.lit("bundle of workspace "), "workspace_id", F.lit(f" goes into {workspace}")))
    return head.select(F.explode(F.filter(F.array(version, other), lambda w: w.isNotNull())).alias("warning"))
