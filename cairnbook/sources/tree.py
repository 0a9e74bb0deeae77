"""Walking a folder tree given as parent-child edges."""

from __future__ import annotations

from itertools import count
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnbook.functions.text import extension
from cairnbook.session import hadoop_path, new_dir
from cairnbook.sources.listing import SUPPORTED

# Folder type, prefix of editor-native types, native types that can be exported.
FOLDER_TYPE = "application/vnd.google-apps.folder"
NATIVE_PREFIX = "application/vnd.google-apps."
EXPORTABLE = ("application/vnd.google-apps.spreadsheet",)


# Edges of a hash partition, tasks that share one parent's entries, and folders of a frontier that is broadcast: at some
# hundred bytes each a few MB.
BUCKET_ROWS = 200_000
_SALTS = 8
_SMALL_FRONTIER = 50_000
_ENTRY = "parent string, id string, name string, mime string, class string"


def node_class(mime: Column, name: Column) -> Column:
    """``folder``, ``file``, ``export`` (native but exportable), ``native`` or ``unsupported``."""
    return (
        F.when(mime == FOLDER_TYPE, "folder")
        .when(mime.isin(*EXPORTABLE), "export")
        .when(mime.startswith(NATIVE_PREFIX), "native")
        .when(extension(name).isin(*SUPPORTED), "file")
        .otherwise("unsupported")
    )


class Stored(NamedTuple):
    """Edges by hash partition of their parent: the folder, the number of partitions, and those that hold any."""

    path: str
    buckets: int
    there: set[int]


def _bucket(c: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def stored_edges(edges: DataFrame, bucket_rows: int = BUCKET_ROWS) -> Stored:
    """The edges written once, in hash partitions of about ``bucket_rows`` edges.

    Entries of one parent are spread over a few tasks and files, so a folder that holds a third of all is no single one.
    """
    path, parts = new_dir(edges.sparkSession, "edges"), int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4, min(10_000, edges.count() // bucket_rows))
    (edges.withColumn("_bucket", _bucket("parent", buckets)).withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(_SALTS)))
     .repartition(parts, "_bucket", "_salt").drop("_salt").write.partitionBy("_bucket").parquet(path))
    fs, folder = hadoop_path(edges.sparkSession, path)
    names = (s.getPath().getName() for s in fs.listStatus(folder))
    return Stored(path, buckets, {int(n.split("=")[1]) for n in names if n.startswith("_bucket=")})


def children(spark: SparkSession, stored: Stored, frontier: DataFrame) -> DataFrame:
    """Edges whose parent is in the ``frontier`` (``id``): only the partitions of these parents are read.

    A frontier of up to :data:`_SMALL_FRONTIER` folders is broadcast, and the edges do not move; a larger one meets them by hash.
    """
    touched = sorted({r[0] for r in frontier.select(_bucket("id", stored.buckets)).distinct().collect()} & stored.there)
    edges = (spark.read.schema(_ENTRY).parquet(*[f"{stored.path}/_bucket={k}" for k in touched]) if touched else
             spark.createDataFrame([], _ENTRY))
    parents = frontier.select(F.col("id").alias("parent")).distinct()
    small = parents.limit(_SMALL_FRONTIER + 1).count() <= _SMALL_FRONTIER
    return edges.join(F.broadcast(parents) if small else parents, "parent", "left_semi")


def walk_tree(edges: DataFrame, root: str) -> DataFrame:
    """``(id, name, mime, class, depth)`` of all entries reachable from ``root``.

    ``edges`` has ``parent, id, name, mime``.  Folders are entered once, however many parents they have, so cycles
    end.  The edges are stored once by their parents; each level reads those of its frontier (:func:`children`) and
    is written to the shared folder, which keeps plans short and lets lost tasks be redone.
    """
    spark = edges.sparkSession
    stored = stored_edges(edges.select("parent", "id", "name", "mime").withColumn("class", node_class(F.col("mime"), F.col("name"))))
    levels, entered = new_dir(spark, "levels"), new_dir(spark, "entered")
    spark.range(1).select(F.lit(root).alias("id")).write.parquet(f"{entered}/depth=0")
    for depth in count(1):
        frontier = spark.read.schema("id string").parquet(f"{entered}/depth={depth - 1}")
        children(spark, stored, frontier).write.parquet(f"{levels}/depth={depth}")
        level = spark.read.schema(_ENTRY).parquet(f"{levels}/depth={depth}")
        seen = spark.read.schema("id string").parquet(f"{entered}/depth=*")
        folders = level.where(F.col("class") == "folder").select("id").distinct()
        folders.join(seen, "id", "left_anti").write.parquet(f"{entered}/depth={depth}")
        if spark.read.schema("id string").parquet(f"{entered}/depth={depth}").isEmpty():
            break
    out = spark.read.schema(f"{_ENTRY}, depth int").parquet(levels)
    first = F.min_by(F.struct("name", "mime", "class"), "depth")
    return out.where(F.col("id") != root).groupBy("id").agg(first.alias("e"), F.min("depth").alias("depth")).select(
        "id", "e.name", "e.mime", "e.class", "depth")


def walk_totals(walked: DataFrame) -> DataFrame:
    """Folders entered (root included) and entries per class."""
    return walked.agg(
        (F.count_if(F.col("class") == "folder") + 1).alias("folders"),
        F.count_if(F.col("class").isin("file", "export")).alias("files"),
        F.count_if(F.col("class") == "native").alias("skipped_native"),
        F.count_if(F.col("class") == "unsupported").alias("skipped_unsupported"))
