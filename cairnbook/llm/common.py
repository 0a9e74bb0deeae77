"""Helpers of the text operators: keys, bounded byte blocks, memory kept by a worker, written steps."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnbook.session import cut_lineage

# Texts are worked on together until so many bytes are reached; one longer text is a block of its own.
BLOCK_BYTES = 4 << 20
# Rows of one Arrow batch between the JVM and Python; the default of 10000 whole texts is too much memory.
BATCH_ROWS = 1024


def whole_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: Column) -> DataFrame:
    """Only ``doc_id`` and ``text`` (null is empty) of a table, whatever else it carries."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs.select(docs[id_col].cast("long").alias("doc_id"),
                       F.coalesce(docs[text_col], F.lit("")).alias("text"), *more)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps survive lost executors."""
    return cut_lineage(df, label)


def joined_to_groups(rows: DataFrame, groups: DataFrame, key: str | list[str], count: str) -> DataFrame:
    """``rows`` left-joined to one row per key, without a task for all rows of a frequent key.

    ``groups`` says in the column ``count`` how many rows each key has.  Keys with more than a fourth of what a
    partition holds on average are broadcast: there are at most four of them per partition.  All others are shuffled.
    """
    keys = [key] if isinstance(key, str) else key
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    line = max(1, rows.count() // (4 * parts))
    heavy, light = F.broadcast(groups.where(F.col(count) > line)), groups.where(F.col(count) <= line)
    few = rows.join(F.broadcast(groups.where(F.col(count) > line).select(*keys)), keys, "left_anti")
    return rows.join(heavy, keys).unionByName(few.join(light, keys, "left"))


def worker_memory(name: str, make):
    """A value kept by a Python worker from task to task, until a value of another name takes its place."""
    held = sys.modules.setdefault("_cairnbook_worker", types.ModuleType("_cairnbook_worker"))
    if getattr(held, "name", None) != name:
        held.name = held.value = None
        held.name, held.value = name, make()
    return held.value


def forget() -> None:
    """Drop what :func:`worker_memory` keeps; tasks that need none of it begin with this."""
    worker_memory("", lambda: None)


def give_back() -> None:
    """Return memory that a finished task has freed to the machine; workers live on and share it with others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library frees on its own


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string column without nulls, and the n + 1 offsets of its texts in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, starts


def blocks(batches: Iterator[pa.RecordBatch], size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the bytes of their ``text`` and offsets that begin at 0."""
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, starts = text_bytes(batch.column("text"))
            lo = 0
            while lo < batch.num_rows:
                hi = int(np.searchsorted(starts, starts[lo] + size, "right")) - 1
                hi = min(max(hi, lo + 1), batch.num_rows)
                yield batch.slice(lo, hi - lo), raw[starts[lo]:starts[hi]], starts[lo:hi + 1] - starts[lo]
                lo = hi
    finally:
        give_back()


def spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last positions of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edge[::2], edge[1::2]


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Flags of the positions inside any of the half-open ranges."""
    depth = np.zeros(size + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:-1]) > 0


def table(rows: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in schema], schema=schema)
