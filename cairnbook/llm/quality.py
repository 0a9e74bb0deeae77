"""Quality by perplexity: an interpolated modified Kneser-Ney model of trusted text, kept in shards.

The model is over bytes (A-Z in lower case, white space as one blank), order 5.  All counts of trusted text are
gathered by shard: a 5-gram belongs to the shard of its third and fourth byte, so everything its probability needs,
the 5-, 4- and 3-grams that end it and the contexts before its last byte, lies in the same shard.  Orders 2 and 1 are
dense tables of 256 x 256 numbers at most and go everywhere, like the discounts, which come from counts of counts.

Scoring is a count join: every block of documents asks each shard once for each distinct 5-gram it holds, the
shards answer with log probabilities, and the block adds them up per document.  A document is kept if its
perplexity lies between two quantiles of trusted documents of its language that were held out of the counts: strange
text lies above, repeated words and boilerplate below.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnbook.llm.blocktable import (MESSAGE, REPLY, Block, ask, block_table, bucket_count, by_bucket, expand,
                                      meet_in_buckets, message_rows, release, reply_rows, shrink)
from cairnbook.llm.common import table, written
from cairnbook.llm.rolling import mix

# Chosen by the labels of sf0.1; the README has what they leave.
QUANTILE = 0.95
LOWEST = 0.02
_ORDER = 5
_LOWER = bytes(c | 32 if 65 <= c <= 90 else c for c in range(256))
_PAD = b"\n" * (_ORDER - 1)
_MODEL = -1


def normal(text: bytes) -> bytes:
    return b" ".join(text.translate(_LOWER).split())


def grams_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 5-gram that ends at each byte of each normalised text, and the n + 1 offsets of the texts."""
    flat = np.frombuffer(b"".join(_PAD + t for t in texts) + b"\n", np.uint8)
    code = np.zeros(max(0, len(flat) - _ORDER + 1), np.uint64)
    for k in range(_ORDER):
        code |= flat[k:k + len(code)].astype(np.uint64) << np.uint64(8 * (_ORDER - 1 - k))
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    # The i-th text begins after i + 1 pads; its first gram is the one that begins with its own pad.
    at = np.repeat((_ORDER - 1) * np.arange(len(texts)), sizes) + np.arange(int(offsets[-1]))
    return code[at], offsets


def _shard(grams: np.ndarray, shards: int) -> np.ndarray:
    return (mix(grams >> np.uint64(8) & np.uint64(0xFFFF)) % np.uint64(shards)).astype(np.int64)


def _sorted_out(grams: np.ndarray, shards: int, *more: np.ndarray):
    """For each shard met: its number, its distinct grams as steps from one to the next, and the other columns."""
    order, edge = by_bucket(_shard(grams, shards), shards)
    for b in np.flatnonzero(np.diff(edge)):
        own = order[edge[b]:edge[b + 1]]
        yield int(b), own, shrink(np.diff(grams[own], prepend=np.uint64(0)), *[m[own] for m in more])


def _texts(block: Block, which=None) -> list[bytes]:
    raw = block.data.tobytes()
    return [normal(raw[block.starts[i]:block.starts[i + 1]]) for i in (range(len(block.ids)) if which is None else which)]


def _who(block: Block, _):
    known = np.flatnonzero(~block.null)
    yield pa.RecordBatch.from_arrays([pa.array(block.ids[known]), pa.array(np.full(len(known), block.number))], names=["doc_id", "block"])


def _ids(batches):
    for batch in batches:
        yield reply_rows([(b, shrink(np.array(ids, np.int64))) for b, ids in zip(
            batch.column("block").to_pylist(), batch.column("ids").to_pylist())])


def _say_counts(block: Block, replies, shards: int):
    if not replies:
        return
    trusted = np.concatenate([expand(r, np.int64)[0] for r in replies])
    which = np.flatnonzero(np.isin(block.ids, trusted) & ~block.null)
    grams, count = np.unique(grams_of(_texts(block, which))[0], return_counts=True)
    yield message_rows(block.number, [(b, p) for b, _, p in _sorted_out(grams, shards, count.astype(np.int64))])


def _meet_counts(bucket: int, messages):
    grams = np.concatenate([np.cumsum(expand(p, np.uint64)[0]) for _, p in messages])
    count = np.concatenate([expand(p, np.uint64, np.int64)[1] for _, p in messages])
    grams, where = np.unique(grams, return_inverse=True)
    total = np.bincount(where, count).astype(np.int64)
    yield message_rows(_MODEL, [(bucket, shrink(np.diff(grams, prepend=np.uint64(0)), total))])


def _levels(grams: np.ndarray, count: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Grams and counts of orders 5, 4 and 3; below 5 the count is that of the distinct bytes before."""
    levels = [(grams, count)]
    for bits in (32, 24):
        levels.append(np.unique(levels[-1][0] & np.uint64((1 << bits) - 1), return_counts=True))
    return levels


def _tally(batches):
    """Counts of counts (kind: order) and, as kind 2, how many distinct bytes stand before each pair of bytes."""
    for batch in batches:
        for payload in batch.column("payload").to_pylist():
            steps, count = expand(payload, np.uint64, np.int64)
            levels = _levels(np.cumsum(steps), count)
            rows = [(order, k, int(np.count_nonzero(c == k))) for order, (_, c) in zip((5, 4, 3), levels) for k in (1, 2, 3, 4)]
            pair, n = np.unique(levels[2][0] & np.uint64(0xFFFF), return_counts=True)
            rows += [(2, int(p), int(k)) for p, k in zip(pair, n)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64()))],
                                             names=["kind", "code", "n"])


def discounts(n: dict[int, int]) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and 3 or more, from how many grams have each count."""
    n1, n2, n3, n4 = (n.get(k, 0) for k in (1, 2, 3, 4))
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))])


def low_orders(pairs: np.ndarray) -> np.ndarray:
    """Probabilities of the last byte after one byte, from the 256 x 256 table of distinct bytes before each pair."""
    d = discounts({k: int(np.count_nonzero(pairs == k)) for k in (1, 2, 3, 4)})
    single = np.count_nonzero(pairs, 0).astype(float)
    d1 = discounts({k: int(np.count_nonzero(single == k)) for k in (1, 2, 3, 4)})
    taken = d1[np.minimum(single, 3).astype(int)]
    whole = max(single.sum(), 1)
    one = (single - taken) / whole + (taken.sum() / whole if single.sum() else 1.0) / 256
    taken = d[np.minimum(pairs, 3).astype(int)]
    whole = pairs.sum(1, keepdims=True)
    seen = np.maximum(whole, 1)
    return np.where(whole > 0, (pairs - taken) / seen + taken.sum(1, keepdims=True) / seen * one, one)


class Shard:
    """Orders 5 to 3 of one shard, ready for questions."""

    def __init__(self, grams: np.ndarray, count: np.ndarray, cut: list[np.ndarray], low: np.ndarray):
        self.low = low
        self.levels = []
        for (g, c), d in zip(_levels(grams, count), cut):
            context, where = np.unique(g >> np.uint64(8), return_inverse=True)
            taken = d[np.minimum(c, 3)]
            self.levels.append((g, c - taken, context, np.bincount(where, c), np.bincount(where, taken)))

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        p = self.low[(grams >> np.uint64(8) & np.uint64(255)).astype(int), (grams & np.uint64(255)).astype(int)]
        for bits, (g, left, context, whole, taken) in zip((24, 32, 40), reversed(self.levels)):
            if not len(g):
                continue
            asked = grams & np.uint64((1 << bits) - 1)
            at = np.minimum(np.searchsorted(g, asked), len(g) - 1)
            own = np.where(g[at] == asked, left[at], 0.0)
            before = asked >> np.uint64(8)
            at = np.minimum(np.searchsorted(context, before), len(context) - 1)
            known = context[at] == before
            p = np.where(known, (own + taken[at] * p) / whole[at], p)
        return np.log(p)


def _say_grams(block: Block, _, shards: int):
    grams = np.unique(grams_of(_texts(block))[0])
    rows = [(b, p) for b, _, p in _sorted_out(grams, shards)]
    if rows:
        yield message_rows(block.number, rows)


def _answer(batches, cut, low: np.ndarray):
    """Rows sorted by shard, its model before the questions; one question at a time."""
    now, shard = None, None
    for batch in batches:
        for bucket, block, payload in zip(*(batch.column(n).to_pylist() for n in ("bucket", "block", "payload"))):
            if bucket != now:
                now, shard = bucket, Shard(np.empty(0, np.uint64), np.empty(0, np.int64), cut, low)
            if block == _MODEL:
                steps, count = expand(payload, np.uint64, np.int64)
                shard = Shard(np.cumsum(steps), count, cut, low)
            else:
                said = shard.log_probability(np.cumsum(expand(payload, np.uint64)[0]))
                yield reply_rows([(block, shrink(np.array([bucket]), said.astype(np.float32)))])


_SCORE = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("n_grams", pa.int64()), ("perplexity", pa.float64())])


def _score(block: Block, replies, shards: int):
    code, offsets = grams_of(_texts(block))
    grams, where = np.unique(code, return_inverse=True)
    value = np.zeros(len(grams))
    order, edge = by_bucket(_shard(grams, shards), shards)
    for reply in replies:
        b, said = expand(reply, np.int64, np.float32)
        value[order[edge[b[0]]:edge[b[0] + 1]]] = said
    sums = np.diff(np.concatenate(([0], np.cumsum(value[where])))[offsets])
    size = np.diff(offsets)
    yield table({"doc_id": block.id_list(), "lang": block.tags, "n_grams": size,
                 "perplexity": [float(np.exp(-s / n)) if n else None for s, n in zip(sums, size)]}, _SCORE)


def split_trusted(trusted: DataFrame, trusted_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Trusted ids to count, and a fifth of them, by crc32 of the id as text, to take the quantiles from."""
    back = F.crc32(trusted[trusted_col].cast("string")) % 5 == 0
    return trusted.where(~back), trusted.where(back)


def quality(docs: DataFrame, trusted: DataFrame, *, held: DataFrame | None = None, quantile: float = QUANTILE,
            lowest: float | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
            trusted_col: str = "doc_id") -> DataFrame:
    """``doc_id, lang, n_grams, perplexity, threshold, kept`` per row; trusted text is that of the ids in ``trusted``.

    All trusted text is counted and every whole text scored.  The threshold is the quantile of the ``held`` documents
    (ids like ``trusted``, which they default to) of the language (a null language is one of its own), of all held
    ones where a language has none, and null, keeping everything, where there are none at all.  With ``lowest``, what
    lies below that quantile both of the held and of the trusted documents is not kept either.  Texts that are null,
    empty or white space have no perplexity and are not kept.  Null ids are scored but never trusted; repeated rows give
    repeated rows; an empty table gives an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    texts = block_table(docs, id_col, text_col, lang_col)
    shards = bucket_count(texts, 1 << 19)
    chosen = trusted.select(trusted[trusted_col].cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    places = ask(texts, _who, "doc_id long, block long").join(chosen, "doc_id")
    mine = places.groupBy("block").agg(F.collect_list("doc_id").alias("ids")).mapInArrow(_ids, REPLY)
    model = written(meet_in_buckets(ask(texts, partial(_say_counts, shards=shards), MESSAGE, mine), _meet_counts, MESSAGE), "model")
    release(spark)
    tally = {(r["kind"], r["code"]): r["n"] for r in model.mapInArrow(_tally, "kind int, code int, n long")
             .groupBy("kind", "code").agg(F.sum("n").alias("n")).collect()}
    cut = [discounts({k: tally.get((order, k), 0) for k in (1, 2, 3, 4)}) for order in (5, 4, 3)]
    pairs = np.zeros((256, 256))
    for (kind, code), n in tally.items():
        if kind == 2:
            pairs[code >> 8, code & 255] = n
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = ask(texts, partial(_say_grams, shards=shards), MESSAGE).unionByName(model)
    answers = written(asked.repartition(parts, "bucket").sortWithinPartitions("bucket", "block")
                      .mapInArrow(partial(_answer, cut=cut, low=low_orders(pairs)), REPLY), "answers")
    release(spark)
    scores = written(ask(texts, partial(_score, shards=shards),
                         "doc_id long, lang string, n_grams long, perplexity double", answers), "scores")
    judges = chosen if held is None else held.select(held[trusted_col].cast("long").alias("doc_id")).distinct()

    def line(ids: DataFrame, share: float, name: str) -> tuple[DataFrame, float | None]:
        sample = scores.join(ids, "doc_id", "left_semi").where("perplexity IS NOT NULL")
        value = F.percentile_approx("perplexity", F.lit(share), F.lit(100_000))
        return sample.groupBy(F.col("lang").alias(f"{name}_lang")).agg(value.alias(name)), sample.agg(value).first()[0]

    lines = {"upper": line(judges, quantile, "upper")}
    if lowest is not None:
        # Counted text scores lower than text like it: what lies below both is stranger than either.
        lines |= {"lower": line(judges, lowest, "lower"), "counted": line(chosen, lowest, "counted")}
    judged, at = scores, {}
    for name, (by_lang, overall) in lines.items():
        judged = judged.join(by_lang, F.col("lang").eqNullSafe(F.col(f"{name}_lang")), "left")
        at[name] = F.coalesce(name, F.lit(overall).cast("double"))
    inside = F.col("perplexity") <= at["upper"]
    if lowest is not None:
        inside &= F.col("perplexity") >= F.least(at["lower"], at["counted"])
    return judged.select("doc_id", "lang", "n_grams", "perplexity", at["upper"].alias("threshold"),
                         (F.col("perplexity").isNotNull() & F.coalesce(inside, F.lit(True))).alias("kept"))
