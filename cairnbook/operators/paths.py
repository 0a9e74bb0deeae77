"""Matching paths to the roots that own them, and resolving addresses to files.

Roots that a path begins with are found by a sweep: paths and roots are sorted together, over range partitions.  Every
root that is a beginning of a path is also one of the last root in front of it, so that root and the roots it
begins with are all there is to look at.  No path is multiplied by its pieces or by roots, and a root that owns all
paths is no hot key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnbook.functions.urls import percent_decode
from cairnbook.session import cut_lineage


def _nested(roots: DataFrame) -> DataFrame:
    """``_key, _chain``: of every root key itself and all shorter keys it begins with, as ``(order, root, key)``."""
    each = roots.where("_key IS NOT NULL").groupBy("_key").agg(F.min(F.struct("_order", "_root")).alias("r"))
    each = each.select("_key", F.struct("r._order", "r._root", F.col("_key").alias("_shorter")).alias("r"))
    pieces = each.select("_key", F.explode(F.transform(
        F.sequence(F.lit(0), F.length("_key")), lambda n: F.substr("_key", F.lit(1), n))).alias("_piece"))
    shorter = each.select(F.col("_key").alias("_piece"), "r")
    return pieces.join(shorter, "_piece").groupBy("_key").agg(F.collect_list("r").alias("_chain"))


def _fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every path with the chain of the last root in front of it, in sorted order; the last chain of the partition as a row without path."""
    last, part, schema = None, None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        part, chains = batch.column("_part")[0].as_py(), batch.column("_chain")
        if last is None:
            last = pa.nulls(1, chains.type)
            schema = pa.schema([pa.field("_item", batch.column("_item").type), pa.field("_chain", chains.type),
                                pa.field("_part", pa.int32()), pa.field("_is_last", pa.bool_())])
        is_root = batch.column("_is_root").to_numpy(zero_copy_only=False).astype(bool)
        pool = pa.concat_arrays([last, chains])
        place = np.maximum.accumulate(np.where(is_root, np.arange(1, len(is_root) + 1), 0))
        last = pool.take(pa.array([place[-1]]))
        rows = np.flatnonzero(~is_root)
        yield pa.RecordBatch.from_arrays([batch.column("_item").take(pa.array(rows)), pool.take(pa.array(place[rows])),
                                          pa.array([part] * len(rows), pa.int32()), pa.array([False] * len(rows), pa.bool_())], schema=schema)
    if part is not None:
        yield pa.RecordBatch.from_arrays([pa.nulls(1, schema.field("_item").type), last, pa.array([part], pa.int32()), pa.array([True])], schema=schema)


def roots_of(paths: DataFrame, roots: DataFrame, path: str, root: str, order: str | None, components: bool) -> DataFrame:
    """``(path, _roots)``: of every distinct path the roots it begins with as ``(order, root, key)``, in no order.

    With ``components`` a root must end where a component of the path does; slashes at the ends do not count, and the
    root ``/`` owns every path that begins with a slash.
    """
    def key(c: Column) -> Column:
        return F.rtrim(c, F.lit("/")) if components else c

    named = roots.where(F.col(root).isNotNull()).select(
        key(F.col(root)).alias("_key"), F.col(root).alias("_root"), (F.col(order) if order else F.lit(0)).alias("_order"))
    chains = _nested(named)
    chain_type = chains.schema["_chain"].dataType
    items = paths.select(F.col(path).alias("_item")).distinct().select("_item", key(F.col("_item")).alias("_key"), F.lit(False).alias("_is_root"),
                                                                      F.lit(None).cast(chain_type).alias("_chain"))
    both = items.unionByName(chains.select(F.lit(None).cast("string").alias("_item"), "_key", F.lit(True).alias("_is_root"), "_chain"))
    # A root stands in front of the path that equals it.
    ranged = (both.repartitionByRange("_key", F.col("_is_root").desc()).sortWithinPartitions("_key", F.col("_is_root").desc())
              .select("_item", "_is_root", "_chain", F.spark_partition_id().alias("_part")))
    out = T.StructType([T.StructField("_item", T.StringType()), T.StructField("_chain", chain_type), T.StructField("_part", T.IntegerType()),
                        T.StructField("_is_last", T.BooleanType())])
    swept = cut_lineage(ranged.mapInArrow(_fill, out), "swept")
    # A path in front of the first root of its partition looks back: one row per partition says to what.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    back = swept.where("_is_last").select("_part", F.last("_chain", ignorenulls=True).over(before).alias("_back"))
    found = swept.where("NOT _is_last").join(F.broadcast(back), "_part").withColumn("_chain", F.coalesce("_chain", "_back"))
    own = F.rtrim("_item", F.lit("/")) if components else F.col("_item")

    def begins(r: Column) -> Column:
        if not components:
            return own.startswith(r["_shorter"])
        top = (r["_shorter"] == "") & ((own == "") | own.startswith("/"))
        return top | ((r["_shorter"] != "") & ((own == r["_shorter"]) | own.startswith(F.concat(r["_shorter"], F.lit("/")))))

    return found.select(F.col("_item").alias(path), F.filter(F.coalesce("_chain", F.array().cast(chain_type)), begins).alias("_roots"))


def owning_root(paths: DataFrame, roots: DataFrame, path: str = "path", root: str = "root",
                order: str = "order", components: bool = False) -> DataFrame:
    """``(path, root)``: first configured root each distinct path starts with; null if none.

    With ``components`` a root must end at a path component.  Of equal roots the first configured one speaks for all;
    a null path has no root, null roots own nothing.
    """
    found = roots_of(paths, roots, path, root, order, components)
    return found.select(path, F.array_min("_roots")["_root"].alias(root))


def allowed(paths: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """Distinct paths that lie under a registered root, component by component."""
    return roots_of(paths, roots, path, root, None, True).where(F.size("_roots") > 0).select(path)


def resolve_addresses(addresses: DataFrame, roots: DataFrame, files: DataFrame, agent: str | None,
                      address: str = "address") -> DataFrame:
    """``(address, file, error, tried)`` for ``local://agent/path`` addresses.

    ``roots(root, order)``, ``files(file)``.  The path is decoded and a ``#sheet`` suffix
    dropped; it is tried as an absolute path and then below every root.  Errors are
    ``bad-format``, ``no-agent``, ``mismatch`` and ``not-found``; ``tried`` then counts
    the candidate places below roots.

    Existing files are cut behind the roots that own them and equi-joined with the addresses' paths, so the work
    does not multiply addresses by roots.
    """
    a = F.col(address)
    rest = F.substr(a, F.lit(len("local://") + 1))
    shaped = a.startswith("local://") & rest.contains("/")
    owner = F.substring_index(rest, "/", 1)
    decoded = percent_decode(F.regexp_replace(rest, r"^[^/]*/", ""))
    path = F.substring_index(decoded, "#", 1)
    error = F.when(~shaped, "bad-format")
    error = error.when(F.lit(agent is None), "no-agent")
    if agent is not None:
        error = error.when(owner != agent, "mismatch")
    parsed = addresses.select(address).distinct().withColumn("_error", error).withColumn(
        "_path", F.when(error.isNull(), F.ltrim(path, F.lit("/"))))

    absolute = files.select(F.ltrim("file", F.lit("/")).alias("_path"), "file", F.lit(-1).cast("long").alias("_order"))
    placed = roots_of(files, roots.withColumn("order", F.col("order").cast("long")), "file", "root", "order", True)
    below = placed.select("file", F.explode("_roots").alias("r")).where(F.length("file") > F.length("r._shorter") + 1).select(
        F.expr("substring(file, length(r._shorter) + 2)").alias("_path"), "file", F.col("r._order").alias("_order"))
    known = absolute.unionByName(below).groupBy("_path").agg(F.min_by("file", "_order").alias("file"))
    tried = int(roots.count())
    out = parsed.join(known, "_path", "left")
    missing = F.col("_error").isNull() & F.col("file").isNull()
    return out.select(
        address, F.when(F.col("_error").isNull(), F.col("file")).alias("file"),
        F.when(missing, "not-found").otherwise(F.col("_error")).alias("error"),
        F.when(missing, F.lit(tried)).cast("long").alias("tried"))
