"""Incremental refresh: freshness lookups, manifest differences, orphans, changed roots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _lookup(listing: DataFrame, cache: DataFrame, key: list[str], facts: list[str],
            keep: list[str]) -> DataFrame:
    known = cache.select(*key, *[F.col(f).alias(f"_old_{f}") for f in facts], *keep,
                         F.lit(True).alias("_known"))
    return listing.join(known, key, "left")


def freshness(listing: DataFrame, cache: DataFrame, key: list[str], needs_text: Column | None = None,
              has_text: str | None = None) -> DataFrame:
    """Listing with ``state``: ``hit``, ``stale`` or ``miss``.

    A hit has the cached modification time and size.  A document cached without its
    text (``needs_text`` true, cached ``has_text`` false) counts as a miss.  One equi-join
    on the file key, which is unique on both sides, so no key can grow hot.
    """
    joined = _lookup(listing, cache, key, ["mtime", "size_bytes"], [has_text] if has_text else [])
    same = (F.col("mtime") == F.col("_old_mtime")) & (F.col("size_bytes") == F.col("_old_size_bytes"))
    state = F.when(F.col("_known").isNull(), "miss")
    if needs_text is not None and has_text is not None:
        state = state.when(same & needs_text & ~F.coalesce(F.col(has_text), F.lit(False)), "miss")
    state = state.when(same, "hit").otherwise("stale")
    drop = ["_old_mtime", "_old_size_bytes", "_known"] + ([has_text] if has_text else [])
    return joined.withColumn("state", state).drop(*drop)


def split_fresh(listing: DataFrame, cache: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Files served from the cache, and files to be read again."""
    marked = freshness(listing, cache, key)
    return marked.where("state = 'hit'").drop("state"), marked.where("state <> 'hit'").drop("state")


def manifest_diff(old: DataFrame, new: DataFrame, key: str = "key", size: str = "size_bytes",
                  marker: str = "mtime_marker") -> DataFrame:
    """``(key, change)`` with ``new``, ``changed``, ``unchanged`` or ``removed``.

    Markers are compared as text, byte for byte.
    """
    o = old.select(F.col(key), F.col(size).alias("_os"), F.col(marker).alias("_om"), F.lit(1).alias("_o"))
    n = new.select(F.col(key), F.col(size).alias("_ns"), F.col(marker).alias("_nm"), F.lit(1).alias("_n"))
    same = F.col("_os").eqNullSafe(F.col("_ns")) & F.col("_om").eqNullSafe(F.col("_nm"))
    change = (F.when(F.col("_o").isNull(), "new").when(F.col("_n").isNull(), "removed")
              .when(same, "unchanged").otherwise("changed"))
    return o.join(n, key, "full").select(key, change.alias("change"))


def drop_missing(manifest: DataFrame, listing: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """Manifest entries still listed, and the dropped ones."""
    keys = listing.select(key).distinct()
    return manifest.join(keys, key, "left_semi"), manifest.join(keys, key, "left_anti")


def key_differences(old: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """``(key, side)`` with ``added`` and ``removed`` keys."""
    o, n = old.select(key).distinct(), new.select(key).distinct()
    return (n.join(o, key, "left_anti").withColumn("side", F.lit("added"))
            .unionByName(o.join(n, key, "left_anti").withColumn("side", F.lit("removed"))))


def orphans(old: DataFrame, new: DataFrame, others: DataFrame, file_id: str = "file_id") -> DataFrame:
    """Files gone from a root's latest walk that no other root refers to.

    Ids are made unique inside the tasks first, so one listed by most roots stays small, and
    all three sides share one partitioning.
    """
    gone, here, elsewhere = (df.select(file_id).distinct() for df in (old, new, others))
    return gone.join(here, file_id, "left_anti").join(elsewhere, file_id, "left_anti")


def changed_roots(listing: DataFrame, last_scan: DataFrame, root: str = "root", mtime: str = "mtime",
                  scanned: str = "last_scan") -> DataFrame:
    """``(root, changed)``: something is newer than the last scan, or there was none."""
    newest = listing.groupBy(root).agg(F.max(mtime).alias("_newest"))
    joined = last_scan.select(root, scanned).join(newest, root, "left")
    return joined.select(root, (F.col(scanned).isNull() | F.coalesce(
        F.col("_newest") > F.col(scanned), F.lit(False))).alias("changed"))
