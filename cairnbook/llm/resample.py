"""Importance resampling towards a target: hashed word n-grams of a corpus weighed against those of the target.

The 256 entries of a byte table lower-case A-Z and blank every separator, ``bytes.split`` then yields the words of a text
in UTF-8.  The CRC-32 of an n-gram is the one of its first word carried on over a blank and the next word, so longer runs
cost one step each.  Tasks count buckets with Counters; Spark adds the counts of the tasks up, one number per bucket
(a bounded table, whatever the corpus).  A second pass turns each document into the floored mean of its features' gains, and a
Gumbel number drawn from its id makes the highest scores a sample without replacement.  The drawn documents are ranked by
range partitions; a histogram of the scores says first which documents can be among them.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnbook.llm.common import BLOCK_BYTES, blocks, table, whole_texts, worker_memory, written
from cairnbook.operators.numbering import number_rows

BUCKETS = 10_000
MAX_WORDS = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
# Hashes of so many different words are remembered by a worker before it starts anew.
_REMEMBERED = 500_000

_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256))

_COUNTED = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])
_WEIGHED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()), ("score", pa.int64())])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


class _Buckets(dict):
    """Bucket of each single word; filled as words are met."""

    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        at = self[word] = zlib.crc32(word) % self.buckets
        return at


def features(words: list[bytes], max_words: int, single: _Buckets):
    """Buckets of all runs of 1 to ``max_words`` words, repeats included."""
    yield from map(single.__getitem__, words)
    if max_words > 1:
        carried, led = list(map(zlib.crc32, words)), [b" " + w for w in words]
        for n in range(1, max_words):
            carried = list(map(zlib.crc32, led[n:], carried))
            yield from (c % single.buckets for c in carried)


def _texts(batches):
    for batch, data, starts in blocks(batches, BLOCK_BYTES):
        at = starts.tolist()
        yield batch, (data[lo:hi].tobytes() for lo, hi in zip(at[:-1], at[1:]))


def _count(batches, buckets: int, max_words: int):
    single = worker_memory(f"buckets {buckets}", lambda: _Buckets(buckets))
    found: Counter = Counter()
    for _, texts in _texts(batches):
        for text in texts:
            found.update(features(words_of(text), max_words, single))
    yield table({"bucket": list(found), "n": list(found.values())}, _COUNTED)


def bucket_counts(texts: DataFrame, *, buckets: int = BUCKETS, max_words: int = MAX_WORDS, text_col: str = "text") -> dict[int, int]:
    """How often the features of all texts fall into each bucket: at most ``buckets`` numbers."""
    texts = whole_texts(texts.select(texts[text_col].alias("text"), F.lit(0).alias("doc_id")))
    counted = texts.mapInArrow(partial(_count, buckets=buckets, max_words=max_words), "bucket int, n long")
    return {r["bucket"]: r["n"] for r in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}


def gains_of(corpus: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """``floor(1000 ln(p_target / p_corpus))`` of every bucket, one occurrence added to each."""
    total, wanted = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log(float(target.get(b, 0) + 1) * total / (float(corpus.get(b, 0) + 1) * wanted))) for b in range(buckets)]


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    """Thousandths of a Gumbel number drawn from the id; a null id counts as the empty text."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weigh(batches, gains: list[int], max_words: int, seed: int):
    single = worker_memory(f"buckets {len(gains)}", lambda: _Buckets(len(gains)))
    for batch, texts in _texts(batches):
        ids = batch.column("doc_id").to_pylist()
        counts, sizes, weights = [], [], []
        for text in texts:
            words = words_of(text)
            counts.append(len(words))
            met = Counter(features(words, max_words, single))
            sizes.append(met.total())
            weights.append(sum(gains[b] * n for b, n in met.items()) // met.total() if met else 0)
        yield table({"doc_id": ids, "n_words": counts, "n_features": sizes, "weight": weights,
                     "score": [w + gumbel(i, seed) for w, i in zip(weights, ids)]}, _WEIGHED)


def weighed(docs: DataFrame, gains: list[int], *, max_words: int = MAX_WORDS, seed: int = SEED,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every document."""
    return whole_texts(docs, id_col, text_col).mapInArrow(
        partial(_weigh, gains=gains, max_words=max_words, seed=seed), "doc_id long, n_words long, n_features long, weight long, score long")


def drawn(scored: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows of ``scored`` with ``rank``: the highest scores of documents long enough, null for all others."""
    fit = F.col("n_words") >= min_words
    # Scores are whole thousandths of logarithms, so there are some ten thousand different ones at most.
    steps = sorted(((r["score"], r["n"]) for r in scored.where(fit).groupBy("score").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    wanted = percent * sum(n for _, n in steps) // 100
    line, above = None, 0
    for score, n in steps:
        if above >= wanted:
            break
        line, above = score, above + n
    if line is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    first = fit & (F.col("score") >= line)
    # Rows that agree in all that is ordered are equal; the last key only spreads them over partitions.
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("n_features"), F.col("weight"), F.col("n_words"), F.col("_row")]
    ranked = number_rows(scored.where(first).withColumn("_row", F.monotonically_increasing_id()), order, "rank", start=1).drop("_row")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank").cast("long")))
    return ranked.unionByName(scored.where(~first).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, *, buckets: int = BUCKETS, max_words: int = MAX_WORDS, min_words: int = MIN_WORDS,
             percent: int = PERCENT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document; ``rank`` is null for documents not drawn.

    Of the documents with at least ``min_words`` words ``percent`` in a hundred (rounded down) are drawn.  Null and
    empty texts have no words, weight 0 and are never drawn; texts of any length are read whole; a null id draws like the
    empty text and comes last among equal scores, repeated ids draw the same number, and rows alike in every
    column get neighbouring ranks.  An empty target gives every bucket one occurrence; an empty table an empty result.
    Further columns are not read.
    """
    own = dict(buckets=buckets, max_words=max_words)
    gains = gains_of(bucket_counts(docs, text_col=text_col, **own), bucket_counts(target, text_col=target_text_col, **own), buckets)
    scored = written(weighed(docs, gains, max_words=max_words, seed=seed, id_col=id_col, text_col=text_col), "scored")
    return drawn(scored, percent, min_words)
