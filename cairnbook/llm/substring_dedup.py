"""Substring dedup on words: windows repeated at one length alone are extended, level by level.

A word is removed if a window of ``window`` words covers it whose words also stand, in sequence, in a document of
smaller id.  Every such window holds stretches of half its length.  Level 1 looks at these: of the stretches
in a window only the one of least hash is sent (so a shared window is found whatever stands around it, and about a
quarter of all stretches travel), and only those met in two documents survive.  Level 2 extends the windows
around survivors to twice the length, capped at ``window``; a window met in a smaller document is removed there.
Windows of a level are brought together by hash, each at most once per block of documents.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cairnbook.llm.blocktable import (MESSAGE, REPLY, Block, ask, block_table, bucket_count, by_bucket, expand,
                                      meet_in_buckets, message_rows, release, reply_rows, shrink)
from cairnbook.llm.common import covered, table, written
from cairnbook.llm.rolling import BYTE_VALUE, Rolling, anchors, mix

WINDOW = 13
_PART = 1 << 20
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_NO_DOC = np.iinfo(np.int64).max


class Words:
    """Words of the documents of a block, their hashes, and which document each belongs to."""

    def __init__(self, block: Block):
        dark = ~_BLANK[block.data]
        edge = np.zeros(len(dark) + 1, bool)
        edge[:-1] = dark
        edge[1:-1] &= ~dark[:-1]
        inner = block.starts[:-1][block.starts[:-1] < block.starts[1:]]
        edge[inner] = dark[inner]  # documents stand side by side
        self.lo = np.flatnonzero(edge[:-1])
        stop = np.zeros(len(dark) + 1, bool)
        stop[1:] = dark
        stop[1:-1] &= ~dark[1:]
        last = block.starts[1:][block.starts[:-1] < block.starts[1:]]
        stop[last] = dark[last - 1]
        self.hi = np.flatnonzero(stop)
        self.doc = np.searchsorted(block.starts, self.lo, "right") - 1
        self.first = np.searchsorted(self.doc, np.arange(len(block.ids) + 1))
        self.hash = np.empty(len(self.lo), np.uint64)
        at = 0
        while at < len(self.lo):  # a part of the bytes at a time; a longer word is a part of its own
            to = max(at + 1, int(np.searchsorted(self.hi, self.lo[at] + _PART, "right")))
            a, b = int(self.lo[at]), int(self.hi[to - 1])
            self.hash[at:to] = Rolling(BYTE_VALUE[block.data[a:b]]).part(self.lo[at:to] - a, self.hi[at:to] - a)
            at = to

    def starts_of(self, size: int) -> np.ndarray:
        """Whether a window of ``size`` words of one document begins at each word."""
        flags = np.zeros(len(self.lo), bool)
        if len(flags) >= size:
            flags[:len(flags) - size + 1] = self.doc[:len(flags) - size + 1] == self.doc[size - 1:]
        return flags

    def anchors(self, half: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every stretch of ``half`` words, and the stretch chosen by each window (-1: no window)."""
        grams = Rolling(self.hash).windows(half)
        chosen = np.full(len(self.lo), -1, np.int64)
        reach, step = window - half + 1, 1 << 23
        for lo in range(0, len(grams) - reach + 1, step):
            got = anchors(grams[lo:lo + step + reach - 1], reach)
            chosen[lo:lo + len(got)] = got + lo
        chosen[~self.starts_of(window)] = -1
        return grams, chosen


def _two(words: Words, window: int) -> np.ndarray:
    """Hashes of 128 bits of all windows: rows (bucket and key, second key)."""
    first = Rolling(words.hash).windows(window)
    second = Rolling(mix(words.hash + np.uint64(0x9E3779B97F4A7C15))).windows(window)
    return np.stack((first, second), 1) if len(first) else np.empty((0, 2), np.uint64)


def _least(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each distinct key (rows) its least and greatest document."""
    order = np.lexsort((docs, *keys.T[::-1]))
    keys, docs = keys[order], docs[order]
    fresh = np.ones(len(keys), bool)
    fresh[1:] = (keys[1:] != keys[:-1]).any(1)
    at = np.flatnonzero(fresh)
    last = np.append(at[1:], len(keys)) - 1
    return keys[at], docs[at], docs[last]


def _doc_numbers(block: Block) -> np.ndarray:
    """Ids for comparison; a null id is greater than all."""
    return np.where(block.null, _NO_DOC, block.ids)


def _say_halves(block: Block, _, half: int, window: int, buckets: int):
    words = Words(block)
    grams, chosen = words.anchors(half, window)
    places = np.unique(chosen[chosen >= 0])
    if not len(places):
        return
    key, low, high = _least(grams[places][:, None], _doc_numbers(block)[words.doc[places]])
    key = key[:, 0]
    order, at = by_bucket((key % np.uint64(buckets)).astype(np.int64), buckets)
    key, low, several = key[order], low[order], (low != high)[order]
    code = (key // np.uint64(buckets)) & np.uint64((1 << 40) - 1)
    rows = []
    for b in np.flatnonzero(np.diff(at)):
        own = slice(at[b], at[b + 1])
        ids, index = np.unique(low[own], return_inverse=True)
        index = index.astype(np.uint16 if len(ids) < 1 << 16 else np.uint32)
        rows.append((int(b), shrink((code[own] & np.uint64(0xFFFFFFFF)).astype(np.uint32), (code[own] >> np.uint64(32)).astype(np.uint8),
                                    several[own], ids, index.astype(np.uint32) if len(ids) >= 1 << 16 else index, np.array([index.itemsize]))))
    yield message_rows(block.number, rows)


def _meet_halves(bucket: int, messages, buckets: int):
    parts = []
    for n, (_, payload) in enumerate(messages):
        low32, high8, several, ids, index, size = expand(payload, np.uint32, np.uint8, bool, np.int64, np.uint8, np.int64)
        index = index.view(np.uint16 if size[0] == 2 else np.uint32)
        parts.append((low32 | high8.astype(np.uint64) << np.uint64(32), several, ids[index], np.full(len(low32), n, np.int32)))
    code, several, low, source = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(code, kind="stable")
    code, several, low, source = code[order], several[order], low[order], source[order]
    fresh = np.concatenate(([True], code[1:] != code[:-1]))
    at = np.flatnonzero(fresh)
    lives = (np.minimum.reduceat(low, at) != np.maximum.reduceat(low, at)) | np.logical_or.reduceat(several, at)
    lives = lives[np.cumsum(fresh) - 1]
    keys = code[lives] * np.uint64(buckets) + np.uint64(bucket)
    source = source[lives]
    order, at = by_bucket(source, len(messages))
    yield reply_rows([(messages[n][0], shrink(keys[order[at[n]:at[n + 1]]])) for n in np.flatnonzero(np.diff(at))])


def _say_windows(block: Block, replies, half: int, window: int, buckets: int, half_buckets: int):
    if not replies:
        return
    words = Words(block)
    grams, chosen = words.anchors(half, window)
    alive = np.sort(np.concatenate([expand(r, np.uint64)[0] for r in replies]))
    # A key sent out has 40 bits beyond the bucket; the same part of each stretch's hash is looked up.
    bits = np.uint64((1 << 40) - 1)
    short = (grams // np.uint64(half_buckets) & bits) * np.uint64(half_buckets) + grams % np.uint64(half_buckets)
    place = np.minimum(np.searchsorted(alive, short), len(alive) - 1)
    live = alive[place] == short
    at = np.flatnonzero(chosen >= 0)
    at = at[live[chosen[at]]]
    if not len(at):
        return
    keys, low, high = _least(_two(words, window)[at], _doc_numbers(block)[words.doc[at]])
    order, edge = by_bucket((keys[:, 0] % np.uint64(buckets)).astype(np.int64), buckets)
    rows = []
    for b in np.flatnonzero(np.diff(edge)):
        own = order[edge[b]:edge[b + 1]]
        rows.append((int(b), shrink(keys[own, 0], keys[own, 1].astype(np.uint32), low[own], (low != high)[own])))
    yield message_rows(block.number, rows)


def _meet_windows(bucket: int, messages):
    parts = []
    for n, (_, payload) in enumerate(messages):
        key, more, low, several = expand(payload, np.uint64, np.uint32, np.int64, bool)
        parts.append((key, more, low, several, np.full(len(key), n, np.int32)))
    key, more, low, several, source = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((more, key))
    key, more, low, several, source = (x[order] for x in (key, more, low, several, source))
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (more[1:] != more[:-1])))
    at = np.flatnonzero(fresh)
    least = np.minimum.reduceat(low, at)[np.cumsum(fresh) - 1]
    # Only a block that holds the window in a later document needs to know.
    news = several | (low > least)
    key, more, least, source = key[news], more[news], least[news], source[news]
    order, edge = by_bucket(source, len(messages))
    out = []
    for n in np.flatnonzero(np.diff(edge)):
        own = order[edge[n]:edge[n + 1]]
        out.append((messages[n][0], shrink(key[own], more[own], least[own])))
    yield reply_rows(out)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                  ("kept_text", pa.string())])


def _finish(block: Block, replies, window: int, with_text: bool):
    words = Words(block)
    gone = np.zeros(len(words.lo), bool)
    if replies:
        key, more, least = (np.concatenate(x) for x in zip(*(expand(r, np.uint64, np.uint32, np.int64) for r in replies)))
        order = np.argsort(key, kind="stable")
        key, more, least = key[order], more[order], least[order]
        both = _two(words, window)
        at = np.flatnonzero(words.starts_of(window)[:len(both)])
        place = np.minimum(np.searchsorted(key, both[at, 0]), len(key) - 1)
        hit = (key[place] == both[at, 0]) & (more[place] == both[at, 1].astype(np.uint32))
        hit &= least[place] < _doc_numbers(block)[words.doc[at]]
        gone = covered(at[hit], at[hit] + window, len(gone))
    # Kept words are written with the byte behind each, turned into a blank, and the last blank dropped.
    keep = np.flatnonzero(~gone)
    size = words.hi[keep] - words.lo[keep] + 1
    ends = np.cumsum(size)
    source = np.repeat(words.lo[keep] - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)
    flat = np.concatenate((block.data, np.full(1, 32, np.uint8)))[source] if len(source) else np.empty(0, np.uint8)
    if len(ends):
        flat[ends - 1] = 32
    offsets = np.concatenate(([0], ends))
    edge = offsets[np.searchsorted(keep, words.first)]
    raw = flat.tobytes()
    texts = [raw[a:max(a, b - 1)] for a, b in zip(edge[:-1], edge[1:])]
    n_words = np.diff(words.first)
    removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[words.first])
    yield table({"doc_id": block.id_list(), "n_words": n_words, "n_removed": removed,
                 "kept_sha256": [hashlib.sha256(t).hexdigest() for t in texts],
                 "kept_text": [t.decode() for t in texts] if with_text else [None] * len(texts)}, _OUT)


def substring_dedup(docs: DataFrame, *, window: int = WINDOW, with_text: bool = True, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, kept_text`` per row of ``docs``.

    Words are cut at ASCII white space and kept as they are; windows are judged on the input.  Null and empty texts
    have no words.  Rows that share an id are one document to each other (neither is smaller); a null id counts as
    the greatest.  Repeated rows give repeated rows; an empty table gives an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    half = max(1, -(-window // 2))
    texts = block_table(docs, id_col, text_col)
    buckets = bucket_count(texts, 1 << 20)
    said = ask(texts, partial(_say_halves, half=half, window=window, buckets=buckets), MESSAGE)
    alive = written(meet_in_buckets(said, partial(_meet_halves, buckets=buckets), REPLY), "level1")
    release(spark)
    said = ask(texts, partial(_say_windows, half=half, window=window, buckets=buckets, half_buckets=buckets), MESSAGE, alive)
    known = written(meet_in_buckets(said, _meet_windows, REPLY), "level2")
    release(spark)
    return ask(texts, partial(_finish, window=window, with_text=with_text),
               "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string", known)
