"""Vectors as short codes: product quantisation in whole numbers, by tables over the values that occur.

Components become whole numbers and every vector is cut into equal parts; each part position has a codebook of at most
256 entries that all vectors refine in a few rounds.  The vectors are written once as blocks: per dimension the sorted
dictionary of the different integers of the block, and per vector their places in it.  To assign a block, the squared
differences of every dictionary value to all entries of a codebook are tabulated; the distance of a part is then
gathered from the tables of its dimensions by dictionary code and added up.  Tasks send one row of sums and counts
per part; the codebooks, a bounded table, are what the driver holds between rounds.
"""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnbook.llm.common import BATCH_ROWS, joined_to_groups, table, written

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
# Vectors of one block: its dictionaries pay once they hold fewer values than the block has vectors.
BLOCK_ROWS = 8192
_BLOCK_VALUES = 1 << 21
# Blocks that come to a task in one Arrow batch.
_BLOCKS_AT_ONCE = 4
_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
# Vectors whose distances are added up at a time.
_AT_ONCE = 512
# Whole numbers below this size keep every sum of a task in 64 bits.
_WIDE = 1 << 24
_LIMB = 30

_CODED = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])


def _sound(vec):
    """Not null, and every component a finite number."""
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def _whole(value: float, scale: int) -> int:
    return math.floor(Fraction(value) * scale)


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of doubles; numbers of any size if some are large."""
    if values.size and np.abs(values).max() * scale >= _WIDE:
        return np.array([_whole(v, scale) for v in values.ravel().tolist()], object).reshape(values.shape)
    return np.floor(values * scale).astype(np.int64)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows of doubles; shorter ones are filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return flat.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _pack(batches, dims: int, scale: int):
    """One row per batch: ids, labels, and per dimension the dictionary and the codes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        whole = whole_numbers(_matrix(batch.column("vec"), dims), scale)
        kind = "o" if whole.dtype == object else "i"
        books, codes = [], []
        for d in range(dims):
            values, at = np.unique(whole[:, d], return_inverse=True)
            books.append([str(v) for v in values.tolist()] if kind == "o" else values.tolist())
            codes.append(at.astype(np.uint16).tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array([batch.column("vec_id").to_pylist()], pa.list_(pa.int64())), pa.array([batch.column("label").to_pylist()], pa.list_(pa.string())),
             pa.array([[[str(v) for v in book] for book in books]], pa.list_(pa.list_(pa.string()))), pa.array([codes], pa.list_(pa.binary()))],
            names=["ids", "labels", "books", "codes"])


def blocks_of(vectors: DataFrame, dims: int, scale: int = SCALE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``ids, labels, books, codes``: vectors ``(vec_id, label, vec)`` in encoded blocks, written once."""
    conf = vectors.sparkSession.conf
    conf.set(_PER_BATCH, str(block_rows))
    packed = written(vectors.mapInArrow(partial(_pack, dims=dims, scale=scale),
                                        "ids array<bigint>, labels array<string>, books array<array<string>>, codes array<binary>"), "vector_blocks")
    conf.set(_PER_BATCH, str(_BLOCKS_AT_ONCE))
    return packed


def _opened(batches):
    """Ids, labels, dictionaries and codes of one block at a time."""
    for batch in batches:
        for row in batch.to_pylist():
            numbers = [[int(v) for v in book] for book in row["books"]]
            large = any(book and max(-book[0], book[-1]) >= _WIDE for book in numbers)
            books = [np.array(book, object if large else np.int64) for book in numbers]
            yield row["ids"], row["labels"], books, [np.frombuffer(c, np.uint16) for c in row["codes"]]


def squared_tables(books: list[np.ndarray], entries: np.ndarray) -> list[np.ndarray]:
    """Per dimension: squared differences of every dictionary value to that component of all entries."""
    if entries.dtype == object or any(book.dtype == object for book in books):
        return [(book[:, None] - entries[None, :, d]) ** 2 for d, book in enumerate(books)]
    # No difference is larger than the largest value and the largest entry together.
    most = [(int(np.abs(book).max(initial=0)) + int(np.abs(entries[:, d]).max(initial=0))) ** 2 for d, book in enumerate(books)]
    kind = np.int32 if sum(most) < 1 << 31 else np.int64 if sum(most) < 1 << 62 else object
    return [(book.astype(kind)[:, None] - entries[:, d].astype(kind)[None, :]) ** 2 for d, book in enumerate(books)]


def assign(books: list[np.ndarray], codes: list[np.ndarray], entries: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each of ``count`` parts and its squared distance; of equal ones the first."""
    tables = squared_tables(books, entries)
    kind = object if any(t.dtype == object for t in tables) else tables[0].dtype if tables else np.int64
    nearest, distance = np.zeros(count, np.int64), np.zeros(count, object if kind is object else np.int64)
    sums = np.empty((min(count, _AT_ONCE), len(entries)), kind)
    found = np.empty_like(sums)
    codes = [code.astype(np.intp) for code in codes]
    for lo in range(0, count, _AT_ONCE):
        hi = min(lo + _AT_ONCE, count)
        total = sums[:hi - lo]
        total[:] = 0
        for own, code in zip(tables, codes):
            # Places in a dictionary are never out of range; the mode spares a copy.
            total += np.take(own, code[lo:hi], axis=0, out=found[:hi - lo], mode="clip")
        nearest[lo:hi] = total.argmin(1)
        distance[lo:hi] = total[np.arange(hi - lo), nearest[lo:hi]]
    return nearest, distance


def _codebooks(kept: list[list[list[int]]]) -> list[np.ndarray]:
    """Entries by part; whole numbers of any size where some are large."""
    large = any(abs(v) >= _WIDE for part in kept for entry in part for v in entry)
    return [np.array(part, object if large else np.int64).reshape(len(part), -1) for part in kept]


def _sums(batches, kept, limbs: int):
    """Sums and counts of the parts assigned to every entry, one row per entry and limb of 30 bits."""
    entries = _codebooks(kept)
    wide = len(entries[0][0])
    total = [np.zeros(e.shape, object if limbs > 1 else np.int64) for e in entries]
    many = [np.zeros(len(e), np.int64) for e in entries]
    for ids, _, books, codes in _opened(batches):
        for p, own in enumerate(entries):
            here = slice(p * wide, (p + 1) * wide)
            nearest, _ = assign(books[here], codes[here], own, len(ids))
            many[p] += np.bincount(nearest, minlength=len(own))
            order = np.argsort(nearest, kind="stable")
            first = np.flatnonzero(np.diff(nearest[order], prepend=-1))
            for d, (book, code) in enumerate(zip(books[here], codes[here])):
                total[p][nearest[order][first], d] += np.add.reduceat(book[code[order]], first)
    for p, own in enumerate(total):
        used = np.flatnonzero(many[p])
        rows = own[used].tolist()
        for limb in range(limbs):
            last = limb == limbs - 1
            values = [[v >> (_LIMB * limb) if last else (v >> (_LIMB * limb)) & ((1 << _LIMB) - 1) for v in row] for row in rows]
            yield pa.RecordBatch.from_arrays([pa.array([p] * len(used), pa.int32()), pa.array(used.astype(np.int32)), pa.array([limb] * len(used), pa.int32()),
                                              pa.array(many[p][used]), pa.array(values, pa.list_(pa.int64()))], names=["part", "entry", "limb", "n", "sums"])


def refined(packed: DataFrame, kept: list[list[list[int]]], limbs: int) -> list[list[list[int]]]:
    """Codebooks after one round: each entry the floored mean of the parts nearest to it, unused entries as they were."""
    wide = len(kept[0][0])
    sent = packed.mapInArrow(partial(_sums, kept=kept, limbs=limbs), "part int, entry int, limb int, n long, sums array<bigint>")
    added = sent.groupBy("part", "entry", "limb").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(wide)])
    totals, counts = {}, {}
    for r in added.collect():  # at most parts * entries * limbs rows
        at = r["part"], r["entry"]
        counts[at] = r["n"]
        totals[at] = [t + (r[f"s{d}"] << (_LIMB * r["limb"])) for d, t in enumerate(totals.get(at, [0] * wide))]
    return [[[t // counts[p, e] for t in totals[p, e]] if (p, e) in counts else entry for e, entry in enumerate(part)]
            for p, part in enumerate(kept)]


def _code(batches, kept):
    entries = _codebooks(kept)
    wide = len(entries[0][0])
    for ids, labels, books, codes in _opened(batches):
        error, nearest = 0, []
        for p, own in enumerate(entries):
            here = slice(p * wide, (p + 1) * wide)
            at, distance = assign(books[here], codes[here], own, len(ids))
            error = distance + error
            nearest.append(at.astype(np.uint8))
        said = np.stack(nearest, 1)
        yield table({"vec_id": ids, "label": labels, "code": [row.tobytes().hex() for row in said], "error": error.tolist()}, _CODED)


def first_entries(vectors: DataFrame, dims: int, scale: int, parts: int, entries: int) -> list[list[list[int]]]:
    """Codebooks of the ``entries`` smallest ids; equal ids in the order of their vectors, null ids last."""
    smallest = vectors.orderBy(F.asc_nulls_last("vec_id"), "vec").limit(entries).select("vec").collect()
    wide = dims // parts
    whole = [[_whole(x, scale) for x in r["vec"]] + [0] * (dims - len(r["vec"])) for r in smallest]
    return [[row[p * wide:(p + 1) * wide] for row in whole] for p in range(parts)]


def digest_of(kept: list[list[list[int]]]) -> str:
    """SHA-256 of all components by part, entry and position, as decimal numbers joined by commas."""
    return hashlib.sha256(",".join(str(v) for part in kept for entry in part for v in entry).encode()).hexdigest()


def codebooks(vectors: DataFrame, *, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
              block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, list[list[list[int]]]]:
    """Encoded blocks of the sound vectors ``(vec_id, label, vec)`` and the codebooks, by part and entry."""
    facts = vectors.agg(F.max(F.size("vec")), F.max(F.abs(F.coalesce(F.array_max(F.transform("vec", lambda x: F.abs(x))), F.lit(0.0)))),
                        F.count(F.lit(1))).first()
    dims = max(parts, -(-(facts[0] or 0) // parts) * parts)
    # Sums of all rows in limbs of 30 bits, so that adding them up in Spark stays within 64 bits.
    largest = abs(_whole(facts[1] or 0.0, scale)) + 1
    limbs = 1 if largest * max(facts[2], 1) < 1 << 62 and largest < _WIDE else -(-largest.bit_length() // _LIMB) + 2
    packed = blocks_of(vectors, dims, scale, min(block_rows, max(64, _BLOCK_VALUES // dims)))
    kept = first_entries(vectors, dims, scale, parts, entries)
    for _ in range(rounds if kept[0] else 0):
        kept = refined(packed, kept, limbs)
    return packed, kept


def vector_codes(vectors: DataFrame, *, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
                 block_rows: int = BLOCK_ROWS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every vector without null or non-finite components.

    Null vectors and vectors with such components are left out.  Vectors shorter than the longest count as filled up with
    zeros, and so does a length that ``parts`` does not divide; vectors without components are all zeros.  Null and
    repeated ids keep their rows; among the first codebook entries equal ids stand in the order of their vectors and
    null ids last.  Fewer rows than ``entries`` give fewer entries.  Null labels are one group.  Components of any size
    count exactly; a squared distance beyond 64 bits ends the run with an error.  An empty table gives an empty one;
    further columns are not read.
    """
    if entries > 256:
        raise ValueError("a code of two hex digits names at most 256 entries")
    spark: SparkSession = vectors.sparkSession
    label = vectors[label_col].cast("string") if label_col in vectors.columns else F.lit(None).cast("string")
    clean = written(vectors.where(_sound(vectors[vector_col])).select(
        vectors[id_col].cast("long").alias("vec_id"), label.alias("label"),
        F.transform(vectors[vector_col], lambda x: x.cast("double")).alias("vec")), "sound_vectors")
    packed, kept = codebooks(clean, scale=scale, parts=parts, entries=entries, rounds=rounds, block_rows=block_rows)
    if not kept[0]:
        spark.conf.set(_PER_BATCH, str(BATCH_ROWS))
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    coded = written(packed.mapInArrow(partial(_code, kept=kept), "vec_id long, label string, code string, error long"), "vector_codes")
    # A text per label, null told apart from all of them, so that nulls meet in the join.
    coded = coded.withColumn("label", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")))
    sums = written(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "label_errors")
    spark.conf.set(_PER_BATCH, str(BATCH_ROWS))
    return joined_to_groups(coded, sums, "label", "n").select(
        "vec_id", "code", "error", "label_error", F.lit(digest_of(kept)).alias("codebooks_sha256"))
