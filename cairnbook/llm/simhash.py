"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components.

A fingerprint is split into ``blocks`` blocks.  Two that differ in at most ``max_bits`` bits agree in
at least ``blocks - max_bits`` of them, so for every choice of so many blocks all fingerprints are
joined on the bits of these.  Equal fingerprints are one row from the start.  Inside a bucket a search
from neighbour to neighbour emits a spanning forest, never all pairs.  Buckets of more than ``crowd``
different fingerprints are not brought together at all: their fingerprints are linked through the points
that lie within half the distance of both, where everything that meets in a point belongs together.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnbook.llm.common import blocks, forget, table, whole_texts, written
from cairnbook.llm.components import components

SHINGLE = 4
MAX_BITS = 4
BLOCKS = 7
CROWD = 20_000
SEED = 42

_LOWER = bytes(c | 32 if 65 <= c <= 90 else c for c in range(256))
_PRINT = pa.schema([("doc_id", pa.int64()), ("text_key", pa.string()), ("fp", pa.int64())])
_EDGE = pa.schema([("u", pa.int64()), ("v", pa.int64())])
_STEP = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of the XXH64 values of a text's word shingles; 0 without words."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[:-1] + 1))
    many = max(1, len(words) - shingle + 1)
    begins, ends = begins[:many].tolist(), ends[len(ends) - many:].tolist()
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for lo in range(0, many, _STEP):
        values = [digest(flat[a:b], SEED) for a, b in zip(begins[lo:lo + _STEP], ends[lo:lo + _STEP])]
        bits = np.unpackbits(np.array(values, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > many, bitorder="little").view("<i8")[0])


def _fingerprints(batches, shingle: int):
    forget()
    for batch, data, starts in blocks(batches):
        raw = data.tobytes()
        values = [fingerprint(raw[a:b], shingle) for a, b in zip(starts[:-1], starts[1:])]
        yield table({"doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "fp": values}, _PRINT)


def fingerprints(docs: DataFrame, *, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text_key, fp`` per row; ``text_key`` tells rows of one id apart."""
    slim = whole_texts(docs, id_col, text_col).withColumn("text_key", F.md5("text"))
    return slim.mapInArrow(partial(_fingerprints, shingle=shingle), "doc_id long, text_key string, fp long")


def _masks(parts: int, max_bits: int) -> list[int]:
    """For every choice of ``parts - max_bits`` blocks the mask of their bits, as signed numbers."""
    edges = [round(64 * i / parts) for i in range(parts + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    chosen = [sum(c) for c in combinations(block, parts - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def spanning_forest(values: np.ndarray, max_bits: int) -> tuple[list[int], list[int]]:
    """Edges of at most ``max_bits`` differing bits that connect whatever such edges connect."""
    left, us, vs = values, [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= max_bits
            if near.any():
                found, left = left[near], left[~near]
                us += [int(x)] * len(found)
                vs += found.tolist()
                queue += list(found)
    return us, vs


def _forests(batches, max_bits: int):
    """Input sorted by bucket; a bucket may go on in the next batch."""
    held = None
    for batch in batches:
        now = [batch.column(n).to_numpy(zero_copy_only=False) for n in ("t", "key", "fp")]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        if len(held[0]):
            t, key, _ = held
            done = int(np.flatnonzero((t != t[-1]) | (key != key[-1]))[-1]) + 1 if ((t != t[-1]) | (key != key[-1])).any() else 0
            yield _forest([x[:done] for x in held], max_bits)
            held = [x[done:] for x in held]
    if held is not None:
        yield _forest(held, max_bits)


def _forest(rows, max_bits: int) -> pa.RecordBatch:
    t, key, fp = rows
    edge = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (key[1:] != key[:-1]), [True]))) if len(t) else np.zeros(1, int)
    size = np.diff(edge)
    twos = edge[:-1][size == 2]
    close = twos[np.bitwise_count((fp[twos] ^ fp[twos + 1]).view(np.uint64)) <= max_bits]
    us, vs = fp[close].tolist(), fp[close + 1].tolist()
    for a, n in zip(edge[:-1][size > 2], size[size > 2]):
        u, v = spanning_forest(fp[a:a + n].view(np.uint64), max_bits)
        us += np.array(u, np.uint64).view(np.int64).tolist()
        vs += np.array(v, np.uint64).view(np.int64).tolist()
    return table({"u": us, "v": vs}, _EDGE)


def _around(batches, inner: int, outer: int):
    """For every fingerprint the points within ``outer`` bits; near: within ``inner`` bits."""
    flips = [0], *([sum(1 << b for b in c) for c in combinations(range(64), k)] for k in range(1, outer + 1))
    near = np.concatenate([np.full(len(f), k <= inner) for k, f in enumerate(flips)])
    masks = np.array([m for f in flips for m in f], np.uint64).view(np.int64)
    step = max(1, (1 << 18) // len(masks))
    for batch in batches:
        fp = batch.column("fp").to_numpy(zero_copy_only=False)
        for lo in range(0, len(fp), step):
            part = fp[lo:lo + step]
            yield pa.RecordBatch.from_arrays([pa.array((part[:, None] ^ masks).ravel()), pa.array(np.repeat(part, len(masks))),
                                              pa.array(np.tile(near, len(part)))], names=["point", "fp", "near"])


def links(prints: DataFrame, *, max_bits: int = MAX_BITS, parts: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """Edges ``u, v`` between different fingerprints of ``prints.fp`` (distinct) that connect all close ones.

    A fingerprint becomes 35 keys or two thousand points, which the size of its file does not tell: the joins of
    these are merged, or Spark would take them for small and send them through the driver.
    """
    masks = F.array(*[F.lit(m) for m in _masks(parts, max_bits)])
    keys = prints.select("fp", F.posexplode(masks).alias("t", "mask")).select(
        "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    shared = keys.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = written(keys.join(shared.hint("merge"), ["t", "key"]), "buckets")
    near = (members.where(F.col("n") <= crowd).repartition("t", "key").sortWithinPartitions("t", "key", "fp")
            .select("t", "key", "fp").mapInArrow(partial(_forests, max_bits=max_bits), "u long, v long"))
    packed = members.where(F.col("n") > crowd).select("fp").distinct()
    points = packed.mapInArrow(partial(_around, inner=max_bits // 2, outer=max_bits - max_bits // 2),
                               "point long, fp long, near boolean")
    least = points.groupBy("point").agg(F.min(F.expr("IF(near, fp, NULL)")).alias("v"), F.count(F.lit(1)).alias("n"))
    far = points.join(least.where("n > 1 AND v IS NOT NULL").hint("merge"), "point").select(F.col("fp").alias("u"), "v")
    return near.unionByName(far.where("u <> v"))


def near_duplicates(docs: DataFrame, *, shingle: int = SHINGLE, max_bits: int = MAX_BITS, parts: int = BLOCKS,
                    crowd: int = CROWD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id, text_key, kept`` per row of ``docs``.

    ``component_id`` is the smallest id of the rows whose fingerprints are linked, directly or through others.
    ``kept`` marks the rows of that id (and, where rows share an id, of one text): one document of each
    component.  Null and empty texts have fingerprint 0 and are linked like any other; null ids never are the
    smallest unless all are null; repeated rows are one document twice; an empty table gives an empty one;
    other columns are not read.
    """
    rows = written(fingerprints(docs, shingle=shingle, id_col=id_col, text_col=text_col), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first")
    prints = written(rows.groupBy("fp").agg(first), "prints")
    linked = components(links(prints.select("fp"), max_bits=max_bits, parts=parts, crowd=crowd))
    rooted = prints.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("lowest"))
    known = rooted.join(lowest, "root").select("fp", "lowest")
    return rows.join(known.hint("merge"), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("lowest.doc_id").alias("component_id"), "text_key",
        (F.col("doc_id").eqNullSafe(F.col("lowest.doc_id")) & (F.col("text_key") == F.col("lowest.text_key"))).alias("kept"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns as they are, with one document of each component: that of its smallest id.

    A document is an id and a text, told apart by 128 bits of the text; of rows repeated in both one stays.  Null and empty
    texts are linked like any other, a null id is the smallest only among null ids, and an empty table gives an empty one.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).where("kept")
    number = docs[id_col].cast("long")
    key = ["_no_id", "_id", "_text"]

    def named(doc_id, text):
        return [doc_id.isNull().alias("_no_id"), F.coalesce(doc_id, F.lit(0)).alias("_id"), text.alias("_text")]

    kept = found.select(*named(F.col("doc_id"), F.col("text_key"))).distinct()
    keyed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *named(number, F.md5(F.coalesce(docs[text_col], F.lit("")))))
    # Rows repeated with id and text are one document; the join has already brought them together.
    return keyed.join(kept, key, "left_semi").dropDuplicates(key).select("row.*")
