"""Exact duplicates: filters of immutable snapshots screen incoming digests, exact buckets and bytes decide.

A batch of documents is packed once into blocks; a narrow row per document holds its SHA-256 digest and its place.
Rows of equal digest inside the batch are grouped on their own (combined before they are shuffled, so a text that a
third of all rows share is one entry per task).  What was ingested earlier stands in snapshots that never change: the
groups of their batch in buckets by digest, and one binary-fuse filter per shard of the digests.  A new batch
sends each distinct digest once past the filters; only those let through are joined to the snapshot's buckets.  Then
the texts of all groups are fetched from their blocks (unique texts never move) and compared byte by byte; digests
that stand for several texts, should there be any, are grouped by the texts themselves.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnbook.llm import fuse
from cairnbook.llm.blocktable import block_table, opened
from cairnbook.llm.common import joined_to_groups, table, written

# Digests of one filter: about 150 kB of filter, 4 MB of digests while it is built.
SHARD_DIGESTS = 1 << 17
# Documents of one table arrive in so many batches, dealt by a hash of the id.
BATCHES = 2

_ROW = pa.schema([("doc_id", pa.int64()), ("batch", pa.int32()), ("block", pa.int64()), ("pos", pa.int32()), ("sha", pa.binary())])
_TEXT = pa.schema([("digest", pa.binary()), ("text", pa.binary())])
_PLACED_TEXT = pa.schema([("batch", pa.int32()), ("block", pa.int64()), ("pos", pa.int32()), ("text", pa.binary())])
_PLACE = ["batch", "block", "pos"]


@dataclass(frozen=True)
class Snapshot:
    """An ingested batch: texts in blocks, a row per document, a group per digest, filters of the digests by shard."""

    texts: DataFrame
    rows: DataFrame
    groups: DataFrame
    filters: DataFrame
    shards: int


def _digest_rows(batches, number: int):
    for block, _ in opened(batches):
        at, data = block.starts.tolist(), memoryview(block.data)
        sha = [hashlib.sha256(data[lo:hi]).digest() for lo, hi in zip(at[:-1], at[1:])]
        yield table({"doc_id": block.id_list(), "batch": [number] * len(sha), "block": [block.number] * len(sha),
                     "pos": range(len(sha)), "sha": sha}, _ROW)


def _keys(digests: pa.Array) -> np.ndarray:
    """The first eight bytes of each digest as a number."""
    return np.array([int.from_bytes(d[:8], "little") for d in digests.to_pylist()], np.uint64)


def _build_filters(batches):
    """A filter for each shard; rows come sorted by shard."""
    held, now = [], None
    names = ["shard", "filter"]
    for batch in batches:
        shard, keys = batch.column("shard").to_numpy(zero_copy_only=False), _keys(batch.column("digest"))
        edges = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if lo == hi:
                continue
            if held and shard[lo] != now:
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([fuse.build(np.concatenate(held))], pa.binary())], names)
                held = []
            now = int(shard[lo])
            held.append(keys[lo:hi])
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([fuse.build(np.concatenate(held))], pa.binary())], names)


def _let_through(batches):
    """Digests that the filter of their shard may hold; the filter comes before the digests of its shard."""
    now, filter_bytes = None, None
    for batch in batches:
        shard = batch.column("shard").to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if lo == hi:
                continue
            part = batch.slice(lo, hi - lo)
            if shard[lo] != now:
                now, filter_bytes = shard[lo], None
            if part.column("digest").null_count:
                filter_bytes, part = part.column("filter")[0].as_py(), part.slice(1)
            if filter_bytes is not None and part.num_rows:
                digest = part.column("digest")
                kept = digest.filter(pa.array(fuse.may_hold(filter_bytes, _keys(digest))))
                yield pa.RecordBatch.from_arrays([kept], ["digest"])


def _shard(shards: int):
    """Shard of a digest, from bytes that the filters do not use as key."""
    return F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int").alias("shard")


def _dealt(df: DataFrame, *order) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, "shard").sortWithinPartitions("shard", *order)


def freeze(docs: DataFrame, number: int = 0, *, digest_bytes: int = 32, shard_digests: int = SHARD_DIGESTS,
           id_col: str = "doc_id", text_col: str = "text") -> Snapshot:
    """A batch as a snapshot: written once, grouped by digest, with its filters.  ``number`` tells batches apart."""
    texts = block_table(docs, id_col, text_col)
    rows = written(texts.mapInArrow(partial(_digest_rows, number=number), "doc_id long, batch int, block long, pos int, sha binary")
                   .withColumn("digest", F.substring("sha", 1, digest_bytes)), "digests")
    groups = written(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", *_PLACE)).alias("top")), "groups")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(parts, -(-groups.count() // shard_digests))
    filters = written(_dealt(groups.select(_shard(shards), "digest")).mapInArrow(_build_filters, "shard int, filter binary"), "filters")
    return Snapshot(texts, rows, groups, filters, shards)


def screened(groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """``digest``: those of ``groups`` that the snapshot's filters let through; each task holds one filter at a time."""
    keys = groups.select(_shard(snapshot.shards), "digest", F.lit(None).cast("binary").alias("filter"))
    filters = snapshot.filters.select("shard", F.lit(None).cast("binary").alias("digest"), "filter")
    return _dealt(keys.unionByName(filters), F.col("digest").asc_nulls_first()).mapInArrow(_let_through, "digest binary")


def matches(groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """``digest, n, top`` of the snapshot's groups whose digest is among ``groups``."""
    return screened(groups, snapshot).join(snapshot.groups, "digest")


def _fetch(batches, placed: bool):
    """Texts at the wanted positions of blocks; with their places, or each different text of a block once."""
    for block, wanted in opened(batches):
        at, data = block.starts.tolist(), block.data
        texts = {pos: data[at[pos]:at[pos + 1]].tobytes() for pos in sorted(w["pos"] for w in wanted)}
        if placed:
            batch = wanted[0]["batch"]
            yield table({"batch": [batch] * len(texts), "block": [block.number] * len(texts), "pos": list(texts), "text": list(texts.values())},
                        _PLACED_TEXT)
        else:
            digest = {w["pos"]: w["digest"] for w in wanted}
            pairs = list(dict.fromkeys((digest[pos], text) for pos, text in texts.items()))
            yield table({"digest": [d for d, _ in pairs], "text": [t for _, t in pairs]}, _TEXT)


def _texts_of(snapshots: list[Snapshot], rows: DataFrame, placed: bool) -> DataFrame:
    """Texts of the given rows, read from their blocks; a block holds at most one Arrow batch of documents."""
    schema = "batch int, block long, pos int, text binary" if placed else "digest binary, text binary"
    found = None
    for number, snapshot in enumerate(snapshots):
        wanted = rows.where(F.col("batch") == number).groupBy("block").agg(F.collect_list(F.struct("batch", "pos", "digest")).alias("replies"))
        here = snapshot.texts.join(wanted, "block").mapInArrow(partial(_fetch, placed=placed), schema)
        found = here if found is None else found.unionByName(here)
    return found


def _groups_over(snapshots: list[Snapshot]) -> DataFrame:
    """``digest, n, top`` of all digests that several rows of all batches have.

    Each batch is screened by the snapshots before it; what they share is put together, the rest stays as grouped.
    """
    met, groups = None, None
    for number, new in enumerate(snapshots):
        for old in snapshots[:number]:
            hit = matches(new.groups, old)
            both = hit.unionByName(new.groups.join(hit.select("digest"), "digest", "left_semi"))
            met = both if met is None else met.unionByName(both)
        several = new.groups.where("n > 1")
        groups = several if groups is None else groups.unionByName(several)
    if met is None:
        return groups
    met = written(met.distinct().groupBy("digest").agg(F.sum("n").alias("n"), F.max("top").alias("top")), "met")
    return groups.join(met.select("digest"), "digest", "left_anti").unionByName(met)


def deduplicate(snapshots: list[Snapshot]) -> DataFrame:
    """``doc_id, batch, block, pos, sha, n, top`` of every document of numbered batches, in the order they arrived.

    ``n`` rows hold the same bytes and ``top`` is the one of largest id among them.
    """
    rows = snapshots[0].rows
    for other in snapshots[1:]:
        rows = rows.unionByName(other.rows)
    groups = written(_groups_over(snapshots), "repeated")
    alone = F.struct("doc_id", *_PLACE)
    rows = written(joined_to_groups(rows, groups, "digest", "n").withColumn("n", F.coalesce("n", F.lit(1).cast("long")))
                   .withColumn("top", F.coalesce("top", alone)), "grouped")
    # Byte check: the texts of all rows that are said to be equal, each once per block and then once per task.
    several = rows.where("n > 1")
    kinds = _texts_of(snapshots, several, placed=False).distinct().groupBy("digest").count()
    mixed = written(kinds.where(F.col("count") > 1).select("digest"), "mixed")
    if mixed.isEmpty():
        return rows.drop("digest")
    apart = several.join(mixed, "digest", "left_semi").drop("n", "top")
    texts = written(_texts_of(snapshots, apart, placed=True).join(apart, _PLACE), "mixed_texts")
    equal = texts.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", *_PLACE)).alias("top"))
    judged = joined_to_groups(texts, equal, ["digest", "text"], "n").drop("text")
    return rows.join(mixed, "digest", "left_anti").unionByName(judged).drop("digest")


def exact_dedup(docs: DataFrame, *, batches: int = BATCHES, digest_bytes: int = 32, shard_digests: int = SHARD_DIGESTS,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256``, one row per document.

    The documents arrive in ``batches`` batches dealt by a hash of their ids; every batch is screened by the filters of
    those before it.  Texts are equal when their UTF-8 bytes are; a null text counts as empty, and all empty
    texts are one group.  Of a group the row of largest id is kept; a null id is smaller than all others, and of
    several rows with the largest id exactly one is kept.  ``keep_id`` is null where all ids of the group are.  A text
    of any length is one document of a block of its own.  An empty table gives an empty one; further columns are not
    read.  With fewer ``digest_bytes`` digests collide, which changes no result.
    """
    which = F.pmod(F.xxhash64(docs[id_col]), F.lit(batches))
    arrived = [freeze(docs.where(which == number), number, digest_bytes=digest_bytes, shard_digests=shard_digests,
                      id_col=id_col, text_col=text_col) for number in range(batches)]
    rows = deduplicate(arrived)
    kept = F.struct(*_PLACE) == F.struct(*[F.col(f"top.{c}") for c in _PLACE])
    return rows.select("doc_id", F.col("top.doc_id").alias("keep_id"), F.col("n").alias("group_size"), kept.alias("kept"),
                       F.lower(F.hex("sha")).alias("text_sha256"))


def unique(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, text`` of the documents that :func:`exact_dedup` keeps; ids must tell documents apart."""
    kept = exact_dedup(docs, id_col=id_col, text_col=text_col, **options).where("kept").select(F.col("doc_id").alias(id_col))
    return docs.select(id_col, text_col).join(kept, id_col, "left_semi")
