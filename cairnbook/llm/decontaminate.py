"""Benchmark decontamination: one Aho-Corasick automaton over the normalised test items, texts scanned once.

Items and texts are normalised alike: A-Z in lower case, every other ASCII character that is neither a
letter nor a digit a separator, words joined by one blank.  The automaton holds every window of
``window`` consecutive item words (an item of fewer words is one window).  Texts are scanned as
bytes, so each hit is brought back to word numbers and, for ``hit_spans``, to the characters of the original.

The automaton is sent to every executor, so its size is checked: items are dealt by the size of their
text into shards of at most ``shard_bytes`` and texts are scanned once per shard, usually one.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnbook.llm.common import BATCH_ROWS, blocks, covered, spans_of, table, whole_texts, worker_memory, written

WINDOW = 10
# Text of the items in one automaton; the automaton takes a small multiple of it in memory.
SHARD_BYTES = 8 << 20

_NORMAL = bytes((c | 32) if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
                for c in range(256))
_HITS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("words", pa.list_(pa.int64())),
                   ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.int64()))])
_HITS_SQL = "doc_id long, n_words long, words array<long>, items array<long>, spans array<long>"


def windows_of(text: str | None, window: int = WINDOW) -> list[str]:
    """The windows of an item, as the automaton holds them (bytes read as Latin-1)."""
    words = (text or "").encode().translate(_NORMAL).split()
    if not words:
        return []
    many = max(1, len(words) - window + 1)
    return list(dict.fromkeys((b" " + b" ".join(words[i:i + window]) + b" ").decode("latin-1") for i in range(many)))


def automaton(items: list[tuple[int, str]], window: int = WINDOW):
    """Automaton whose values are the number of blanks in the window and the ids of its items."""
    held: dict[str, set[int]] = {}
    for item, text in items:
        for w in windows_of(text, window):
            held.setdefault(w, set()).add(item)
    built = ahocorasick.Automaton()
    for w, ids in held.items():
        built.add_word(w, (len(w), w.count(" ") - 1, tuple(sorted(ids))))
    if held:
        built.make_automaton()
    return built


def _scan(batches, name: str, items: list[tuple[int, str]], window: int):
    built = worker_memory(name, lambda: automaton(items, window))
    empty = not len(built)
    for batch, data, starts in blocks(batches):
        flat = np.frombuffer(data.tobytes().translate(_NORMAL), np.uint8)
        dark = flat != 32
        first = np.empty(len(flat), bool)
        if len(flat):
            first[0] = dark[0]
            first[1:] = dark[1:] & ~dark[:-1]
            first[starts[:-1][starts[:-1] < starts[1:]]] = dark[starts[:-1][starts[:-1] < starts[1:]]]
        n_words = np.diff(np.concatenate(([0], np.cumsum(first)))[starts]) if len(flat) else np.zeros(len(starts) - 1, int)
        words, found, spans = ([None] * batch.num_rows for _ in range(3))
        raw = flat.tobytes()
        for i, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
            if empty or not n_words[i]:
                continue
            text = " " + b" ".join(raw[a:b].split()).decode("latin-1") + " "
            hits = list(built.iter(text))
            if not hits:
                continue
            # Number of the last word of a hit: blanks up to its end, without the one before the first word.
            blank = np.flatnonzero(np.frombuffer(text.encode("latin-1"), np.uint8) == 32)
            last = np.searchsorted(blank, [end for end, _ in hits])
            size = np.array([n for _, (_, n, _) in hits])
            flags = covered(last - size, last, int(n_words[i]))
            words[i] = np.flatnonzero(flags)
            found[i] = sorted({x for _, (_, _, ids) in hits for x in ids})
            own = data[a:b]
            word_at = np.flatnonzero(first[a:b])
            lo, hi = spans_of(flags)
            gaps = np.flatnonzero(~dark[a:b])
            ends = np.append(gaps, b - a)[np.searchsorted(np.append(gaps, b - a), word_at[hi - 1])]
            chars = np.concatenate(([0], np.cumsum((own & 0xC0) != 0x80)))
            spans[i] = np.stack((chars[word_at[lo]], chars[ends]), 1).ravel()
        yield table({"doc_id": batch.column("doc_id"), "n_words": n_words, "words": words, "items": found,
                     "spans": spans}, _HITS)


def _report(batches, schema: pa.Schema):
    for batch in batches:
        out = batch.select(["doc_id", "n_words"]).to_pydict()
        words, items = batch.column("words").to_pylist(), batch.column("items").to_pylist()
        out["n_hit"] = [len(w or ()) for w in words]
        out["n_items"] = [len(x or ()) for x in items]
        out["items_sha256"] = [hashlib.sha256(",".join(sorted(map(str, x or ()))).encode()).hexdigest() for x in items]
        out["contaminated"] = [n > 0 for n in out["n_hit"]]
        out["hit_spans"] = batch.column("spans").to_pylist()
        yield table(out, schema)


_REPORT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
                     ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("hit_spans", pa.list_(pa.int64()))])


def _shards(benchmark: DataFrame, shard_bytes: int, item_col: str, item_text_col: str):
    """How many automata it takes, and the items of each, read one after the other."""
    items = whole_texts(benchmark, item_col, item_text_col).toDF("item", "text").where("item IS NOT NULL AND text <> ''")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-2 * total // shard_bytes)) if total > shard_bytes else 1

    def each():
        for shard in range(shards):
            part = items if shards == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(shards)) == shard)
            yield [(r["item"], r["text"]) for r in part.collect()]

    return shards, each()


def _untouched(batches, name: str, items, window: int, text_col: str):
    for batch in batches:
        slim = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column(text_col).fill_null("")],
                                          names=["doc_id", "text"])
        hit = [x.column("items").is_null() for x in _scan([slim], name, items, window)]
        if hit:
            yield batch.filter(pa.chunked_array(hit).combine_chunks())


def uncontaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, shard_bytes: int = SHARD_BYTES,
                   text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, without any word in a window of the benchmark."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    for held in _shards(benchmark, shard_bytes, item_col, item_text_col)[1]:
        run = partial(_untouched, name=f"benchmark {uuid.uuid4().hex}", items=held, window=window, text_col=text_col)
        docs = docs.mapInArrow(run, docs.schema)
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, shard_bytes: int = SHARD_BYTES,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """One row per document: ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``, ``hit_spans``.

    ``hit_spans`` lists starts and ends (characters of the original, end exclusive) of the runs of hit words.
    Null and empty texts have no words; items without words or id are no items; repeated rows give
    repeated rows; without items nothing is contaminated; other columns are not read.
    """
    slim = whole_texts(docs, id_col, text_col)
    scans = []
    shards, parts = _shards(benchmark, shard_bytes, item_col, item_text_col)
    for held in parts:
        run = partial(_scan, name=f"benchmark {uuid.uuid4().hex}", items=held, window=window)
        if shards == 1:
            found = slim.mapInArrow(run, _HITS_SQL)
        else:
            # Beyond one automaton a document is known by its place in a written copy.
            if not scans:
                slim = written(slim.withColumn("row", F.monotonically_increasing_id()), "texts")
            found = slim.select(F.col("row").alias("doc_id"), "text").mapInArrow(run, _HITS_SQL)
        scans.append(found)
    if shards > 1:
        every = scans[0]
        for scan in scans[1:]:
            every = every.unionByName(scan)
        lists = ("words", "items")
        merged = every.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), *[
            F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in lists],
            F.flatten(F.collect_list("spans")).alias("spans"))
        found = (merged.withColumnRenamed("doc_id", "row").join(slim.select("row", "doc_id"), "row")
                 .select("doc_id", "n_words", "words", "items", "spans"))
    return found.mapInArrow(partial(_report, schema=_REPORT),
                            "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, "
                            "contaminated boolean, hit_spans array<long>")
