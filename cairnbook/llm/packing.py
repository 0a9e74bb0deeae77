"""Packing of token sequences: minimum bin slack over the multiset of remaining lengths.

Each document is cut into full windows and one remainder.  Which remainders share a window depends only
on how many there are of each length, a table of at most ``window`` numbers, so the plan is made once:
take the longest remainder left, find by a bitset subset-sum over the lengths left (each with its count)
the fill closest to the window, read the counts of each length back from the bitsets, and use that
filling as often as the counts allow.  Documents then find their place by their rank within their length.
"""

from __future__ import annotations

import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnbook.llm.common import blocks, table, whole_texts, worker_memory, written
from cairnbook.llm.tokens import TokenMemory, safe_cuts

WINDOW = 1024
END_ID = 0
# Longer texts are encoded in parts that end where a pre-token begins for certain.
PART_BYTES = 8 << 20

_PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
_PIECE_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def _parts(data: np.ndarray, size: int):
    """Consecutive parts of a text of about ``size`` bytes, cut at safe places only."""
    lo = 0
    while len(data) - lo > size:
        reach = size
        while True:
            cuts = safe_cuts(data[lo:lo + reach], np.array([0, min(reach, len(data) - lo)]))
            if len(cuts) > 1 or lo + reach >= len(data):
                break
            reach *= 2
        hi = lo + int(cuts[-1]) if len(cuts) > 1 else len(data)
        yield data[lo:hi]
        lo = hi
    yield data[lo:]


def _cut(batches, path: str, window: int, end_id: int, part_bytes: int):
    memory = worker_memory(f"tokens {path}", lambda: TokenMemory(path))
    for batch, data, starts in blocks(batches):
        out: list[tuple] = []
        if len(data) <= part_bytes or batch.num_rows > 1:
            flat, at = memory.encode(data, starts)
            streams = ([flat[a:b]] for a, b in zip(at[:-1], at[1:]))
        else:
            whole = any(s in data.tobytes() for s in memory.special)
            parts = [data] if whole else _parts(data, part_bytes)
            streams = [memory.encode(p, np.array([0, len(p)]))[0] for p in parts],
        for doc, stream in zip(batch.column("doc_id").to_pylist(), streams):
            ids = np.concatenate([*stream, [end_id]]).astype("<u4")
            for lo in range(0, len(ids), window):
                piece = ids[lo:lo + window]
                out.append((doc, lo, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
        yield table(dict(zip(_PIECE.names, zip(*out))), _PIECE)


def pieces(docs: DataFrame, tokenizer_file: str, *, window: int = WINDOW, end_id: int = END_ID,
           part_bytes: int = PART_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents as ids cut into windows and one remainder: ``doc_id, start, length, ids_crc32, doc_tokens``."""
    run = partial(_cut, path=tokenizer_file, window=window, end_id=end_id, part_bytes=part_bytes)
    return whole_texts(docs, id_col, text_col).mapInArrow(run, _PIECE_SQL)


def closest_fill(room: int, left: dict[int, int]) -> dict[int, int]:
    """Counts of each length, at most those ``left``, whose sum comes closest to ``room`` from below.

    Bit ``s`` of ``reach`` tells that some choice sums to ``s``.  A count is taken in powers of two, so a
    length costs a few shifts; the bitsets before each step are kept to read the choice back.
    """
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for length, count in sorted(left.items(), key=lambda x: (-x[1], -x[0])):
        count = min(count, room // length)
        batch = 1
        while count and not reach >> room & 1:
            take = min(batch, count)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            count -= take
            batch *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def plan(counts: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[dict[int, int], int]], int]:
    """Fillings with how often each is used, and the number of windows; every item is used once."""
    left = {length: n for length, n in counts.items() if n}
    fillings, windows = [], 0
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        filling = closest_fill(window - longest, {k: n for k, n in rest.items() if n and k <= window - longest})
        filling[longest] = filling.get(longest, 0) + 1
        times = min(left[k] // n for k, n in filling.items())
        fillings.append((filling, times))
        windows += times
        for k, n in filling.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return fillings, windows


def _places(fillings) -> np.ndarray:
    """Rows (length, first rank, items per window, first window, offset) sorted by length and rank."""
    rank: dict[int, int] = {}
    rows, window = [], 0
    for filling, times in fillings:
        offset = 0
        for length, n in sorted(filling.items(), reverse=True):
            rows.append((length, rank.get(length, 0), n, window, offset))
            rank[length] = rank.get(length, 0) + n * times
            offset += length * n
        window += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _place(batches, places: np.ndarray):
    order = places[:, 0] << 44 | places[:, 1]
    for batch in batches:
        length = batch.column("length").to_numpy(zero_copy_only=False)
        rank = batch.column("rank").to_numpy(zero_copy_only=False)
        row = places[np.searchsorted(order, length << 44 | rank, "right") - 1]
        nth = rank - row[:, 1]
        cols = [batch.column(n) for n in _PIECE.names]
        cols += [pa.array(row[:, 3] + nth // np.maximum(row[:, 2], 1)),
                 pa.array(row[:, 4] + nth % np.maximum(row[:, 2], 1) * length)]
        yield pa.RecordBatch.from_arrays(cols, names=[*_PIECE.names, "sequence_id", "offset"])


def pack(docs: DataFrame, tokenizer_file: str, *, window: int = WINDOW, end_id: int = END_ID,
         part_bytes: int = PART_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its ``sequence_id`` and ``offset``; sequence ids run from 0 without gaps.

    A null or empty text is the end id alone; a null id stays null; repeated rows are packed each; an
    empty table gives an empty one; other columns are not read.  Only the counts of at most ``window``
    lengths reach the driver, and the plan sent out has a few entries for each of them.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = written(pieces(docs, tokenizer_file, window=window, end_id=end_id, part_bytes=part_bytes,
                         id_col=id_col, text_col=text_col), "pieces")
    # A length may be shared by most pieces: ranks are counted within hash buckets of a length.
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)).cast("int"))
    sizes = cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    fillings, _ = plan(counts, window)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = (cut.withColumn("nth", F.row_number().over(within) - 1)
              .join(offsets, ["length", "bucket"])
              .select(*_PIECE.names, (F.col("before") + F.col("nth")).alias("rank")))
    return ranked.mapInArrow(partial(_place, places=_places(fillings)),
                             _PIECE_SQL + ", sequence_id long, offset long")
