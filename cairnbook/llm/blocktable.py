"""Texts as a table of blocks that answer and ask: the frame of the two substring operators.

Documents are packed into blocks of a few MB, written once to the shared folder.  A step reads every block,
sends small *messages* about it to buckets (pre-aggregated: a value met many times in a block is sent once),
brings each bucket together, and returns *replies* that are joined to the blocks again.  So only hashes travel,
a value that a third of all documents hold costs one entry per block, and every step starts from written tables.
"""

from __future__ import annotations

import gc
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnbook.llm.common import blocks, whole_texts
from cairnbook.session import new_dir

# Bytes of the messages that one bucket is planned to hold.
BUCKET_BYTES = 16 << 20


@dataclass
class Block:
    """Documents in order: ids (None: null), their bytes one after the other, and the n + 1 offsets."""

    number: int
    ids: np.ndarray
    null: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    tags: list[str | None]

    def id_list(self) -> list[int | None]:
        return [None if gone else i for i, gone in zip(self.ids.tolist(), self.null.tolist())]


def shrink(*arrays: np.ndarray) -> bytes:
    """Arrays of one payload, compressed."""
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(a.tobytes() for a in arrays))


def expand(payload: bytes, *kinds) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(payload)
    many = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, many, 8)
    at, out = 8 + 8 * many, []
    for kind, size in zip(kinds, sizes.tolist()):
        kind = np.dtype(kind)
        out.append(np.frombuffer(raw, kind, size // kind.itemsize, at))
        at += size
    return out


def _pack(batches):
    number = TaskContext.get().partitionId() << 32
    for batch, data, starts in blocks(batches):
        ids = batch.column("doc_id")
        tags = json.dumps(batch.column("tag").to_pylist()) if "tag" in batch.schema.names else "[]"
        payload = shrink(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64),
                         ids.is_null().to_numpy(zero_copy_only=False).astype(bool), starts.astype(np.int64), data,
                         np.frombuffer(tags.encode(), np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([payload], pa.binary())], names=["block", "texts"])
        number += 1


def block_table(docs: DataFrame, id_col: str, text_col: str, tag_col: str | None = None) -> DataFrame:
    """``block, texts``, written once and bucketed by block: replies come to the texts, which never move again."""
    spark = docs.sparkSession
    tag = [docs[tag_col].cast("string").alias("tag")] if tag_col else []
    packed = whole_texts(docs, id_col, text_col, *tag).mapInArrow(_pack, "block long, texts binary")
    path, name = new_dir(spark, "blocks"), f"cairnbook_blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed.write.bucketBy(buckets, "block").option("path", path).saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the name only; the files stay in the shared folder
    return table


def opened(batches) -> Iterator[tuple[Block, list[bytes]]]:
    """Blocks of Arrow batches with their replies, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, null, starts, data, tags = expand(batch.column("texts")[i].as_py(), np.int64, bool, np.int64, np.uint8, np.uint8)
            replies = batch.column("replies")[i].as_py() if "replies" in batch.schema.names else []
            yield Block(batch.column("block")[i].as_py(), ids, null, data, starts, json.loads(tags.tobytes())), replies or []


def ask(table: DataFrame, step: Callable, schema: str, replies: DataFrame | None = None) -> DataFrame:
    """``step`` over every block, with the list of payloads that ``replies`` (``block, payload``) has for it."""
    if replies is not None:
        mine = replies.groupBy("block").agg(F.collect_list("payload").alias("replies"))
        table = table.join(mine, "block", "left")
    return table.mapInArrow(partial(_each, step=step), schema)


def _each(batches, step):
    for block, replies in opened(batches):
        yield from step(block, replies)


def by_bucket(bucket: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the values by bucket, and the count + 1 offsets of the buckets in it."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(count + 1))


def message_rows(block: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([block] * len(rows), pa.int64()),
                                       pa.array([p for _, p in rows], pa.binary())], names=["bucket", "block", "payload"])


MESSAGE = "bucket int, block long, payload binary"
REPLY = "block long, payload binary"


def reply_rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int64()),
                                       pa.array([p for _, p in rows], pa.binary())], names=["block", "payload"])


def _gather(batches, meet):
    held: list[tuple[int, bytes]] = []
    now = None
    for batch in batches:
        for bucket, block, payload in zip(*(batch.column(n).to_pylist() for n in ("bucket", "block", "payload"))):
            if bucket != now and held:
                yield from meet(now, held)
                held = []
            now = bucket
            held.append((block, payload))
    if held:
        yield from meet(now, held)


def meet_in_buckets(messages: DataFrame, meet: Callable, schema: str) -> DataFrame:
    """``meet(bucket, [(block, payload)])`` once for every bucket, all its messages together."""
    parts = int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = messages.repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(partial(_gather, meet=meet), schema)


def bucket_count(table: DataFrame, bytes_per_block: int) -> int:
    """Buckets so that each holds about ``BUCKET_BYTES`` of messages, and every partition has some."""
    spark = table.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(4 * parts, -(-table.count() * bytes_per_block // BUCKET_BYTES))


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished steps, whose results are written, before the next step."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
