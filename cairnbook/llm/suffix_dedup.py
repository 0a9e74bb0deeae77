"""Suffix-array dedup on bytes: maximal repeats from a common-prefix interval tree, bucket by bucket.

A byte is removed if a string of ``length`` bytes covers it that also starts anywhere else.  All windows of
``length`` bytes are dealt by their *anchor*, the stretch of ``gram`` bytes in them with the least hash: equal windows
have equal anchors, and windows side by side mostly share one, so a *run* of them travels as one context.

1. Per block the distinct (anchor, context) hashes are sent.  A context met twice is repeated as a whole.  An
   anchor met with one context only needs nothing more; one of several contexts goes on with one copy of each.
2. The texts of these contexts meet by anchor; those without a window whose hash occurs again repeat nothing and are
   left out.  Their enhanced suffix array (sorted by prefix doubling, with
   common prefix lengths) is scanned with a stack, which visits every interval of the common-prefix tree; an
   interval of at least ``length`` bytes whose occurrences are preceded by different bytes is a maximal repeat, and
   all its occurrences are marked, not only neighbours in the array.
   Anchors with more than ``crowd`` contexts are never brought together: each of their windows is counted by hash.
3. Marks go back to the blocks, which cut the bytes out.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnbook.llm.blocktable import (BUCKET_BYTES, MESSAGE, REPLY, Block, ask, block_table, bucket_count, by_bucket,
                                      expand, meet_in_buckets, message_rows, release, reply_rows, shrink)
from cairnbook.llm.common import covered, spans_of, table, written
from cairnbook.llm.rolling import BYTE_VALUE, Rolling, anchors, mix

LENGTH = 400
GRAM = 128
CROWD = 2_000
# Window starts worked on at a time, and bytes of one suffix array.
_PART = 1 << 20
_ARRAY_BYTES = 1 << 20
_SALTS = 16
# Symbols of nine bits in one number.
_PACKED = 7
TWICE, MIXED, SPEAKER, CROWDED = 1, 2, 4, 8
_STATUS, _MARKS, _COUNTED = 0, 1, 2


# ---- the suffix array and its interval tree

def suffix_array(symbols: np.ndarray, wanted: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that begin at ``wanted``, in order, and the common prefix of each with the one before.

    Prefix doubling, begun with ranks of seven symbols (below 512) at once; ``reach`` symbols tell suffixes apart as far
    as anyone asks, so the last doubling is one of the wanted places only.
    """
    n = len(symbols)
    padded = np.concatenate((symbols, np.zeros(_PACKED - 1, np.int64)))
    key = np.zeros(n, np.int64)
    for k in range(_PACKED):
        key = (key << 9) | padded[k:k + n]
    ranks, width = [], _PACKED
    while True:
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
        ranks.append((width, rank))
        if 2 * width >= reach:
            break
        key = rank * (n + 1)
        key[:n - width] += rank[width:] + 1
        width *= 2
    key = rank[wanted] * (n + 1)
    behind = wanted + max(reach - width, 0)
    key[behind < n] += rank[behind[behind < n]] + 1
    order = wanted[np.argsort(key)]
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(len(order), np.int64)
    for width, rank in ranks[::-1]:
        same = np.flatnonzero((a < n) & (b < n))
        same = same[rank[a[same]] == rank[b[same]]]
        common[same + 1] += width
        a[same] += width
        b[same] += width
    # What is left of each common prefix is shorter than the first ranks.
    going = np.arange(len(a))
    for _ in range(_PACKED - 1):
        going = going[(a[going] < n) & (b[going] < n)]
        going = going[symbols[a[going]] == symbols[b[going]]]
        common[going + 1] += 1
        a[going] += 1
        b[going] += 1
    return order, common


def maximal_repeats(texts: list[bytes], least: int):
    """``(length, starts)`` of every maximal repeat of at least ``least`` bytes, starts in the joined symbols; and these.

    A repeat is maximal if its occurrences neither all go on nor all begin earlier with the same byte.
    """
    sizes = np.array([len(t) for t in texts]) + 1
    ends = np.cumsum(sizes) - 1
    # Bytes are 1 to 256 and the end of a text is 0, below them all: what is common never goes beyond an end.
    symbols = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
    symbols[ends] = 0
    left_in_text = np.repeat(ends, sizes) - np.arange(len(symbols))
    wanted = np.flatnonzero(left_in_text >= least)
    if not len(wanted):
        return [], symbols, ends
    order, common = suffix_array(symbols, wanted, int(sizes.max()))
    common[1:] = np.minimum(common[1:], np.minimum(left_in_text[order[1:]], left_in_text[order[:-1]]))
    before = np.full(len(symbols), -1, np.int64)
    before[1:] = symbols[:-1]
    # Nothing is known of the byte before a text: such starts differ from each other and all others.
    unknown = np.concatenate(([0], ends[:-1] + 1))
    before[unknown] = -1 - np.arange(len(unknown))
    left = before[order].tolist()
    groups = []
    lo, hi = spans_of(np.concatenate((common[1:] >= least, [False])))
    for a, b in zip(lo.tolist(), hi.tolist()):  # suffixes a to b share at least the length wanted
        heights = common[a + 1:b + 1].tolist()
        stack: list[list] = []  # height, first suffix, byte before all of them (None: several)
        for i, height in enumerate([*heights, 0]):
            at, first, byte = a + i, a + i, left[a + i]
            while stack and stack[-1][0] > height:
                top = stack.pop()
                whole = top[2] if top[2] == byte else None
                if whole is None:
                    groups.append((top[0], order[top[1]:at + 1]))
                first, byte = top[1], whole
            if stack and stack[-1][0] == height:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == byte else None
            elif height:
                stack.append([height, first, byte])
    return groups, symbols, ends


# ---- runs of windows with one anchor

def _runs(block: Block, length: int, gram: int):
    """Of each part of a block: ``rolling, offset, first window, windows, anchor hash, context hash``."""
    data, total = block.data, len(block.data)
    for lo in range(0, total - length + 1, _PART):
        part = data[lo:lo + _PART + length - 1]
        rolling = Rolling(BYTE_VALUE[part])
        grams = rolling.windows(gram)
        chosen = anchors(grams, length - gram + 1)
        edges = block.starts[(block.starts > lo) & (block.starts < lo + len(part))] - lo
        bad = covered(np.maximum(edges - length + 1, 0), np.minimum(edges, len(chosen)), len(chosen)) if len(edges) else np.zeros(len(chosen), bool)
        fresh = np.concatenate(([True], (chosen[1:] != chosen[:-1]) | (bad[1:] != bad[:-1])))
        first = np.flatnonzero(fresh)
        count = np.diff(np.append(first, len(chosen)))
        good = ~bad[first]
        first, count = first[good], count[good]
        context = rolling.part(first, first + count - 1 + length)
        yield rolling, lo, first, count, grams[chosen[first]], mix(context ^ (chosen[first] - first).astype(np.uint64))


def _all_runs(block: Block, length: int, gram: int):
    parts = [(lo + first, count, anchor, context) for _, lo, first, count, anchor, context in _runs(block, length, gram)]
    if not parts:
        return (np.empty(0, np.int64),) * 2 + (np.empty(0, np.uint64),) * 2
    return tuple(np.concatenate(x) for x in zip(*parts))


def _distinct(anchor: np.ndarray, context: np.ndarray):
    """Order by (anchor, context) and, in it, where each distinct pair begins."""
    order = np.lexsort((context, anchor))
    a, c = anchor[order], context[order]
    return order, np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (c[1:] != c[:-1])))) if len(order) else order


def _say_contexts(block: Block, _, length: int, gram: int, buckets: int):
    _, _, anchor, context = _all_runs(block, length, gram)
    if not len(anchor):
        return
    order, at = _distinct(anchor, context)
    several = np.diff(np.append(at, len(order))) > 1
    anchor, context = anchor[order[at]], context[order[at]]
    order, edge = by_bucket((anchor % np.uint64(buckets)).astype(np.int64), buckets)
    yield message_rows(block.number, [
        (int(b), shrink(anchor[own], context[own], several[own]))
        for b in np.flatnonzero(np.diff(edge)) for own in [order[edge[b]:edge[b + 1]]]])


def _split(batches, hot: dict[int, int], buckets: int):
    """Messages to crowded buckets go to ``_SALTS`` buckets by context; others stay."""
    for batch in batches:
        for bucket, block, payload in zip(*(batch.column(n).to_pylist() for n in ("bucket", "block", "payload"))):
            if bucket not in hot:
                yield message_rows(block, [(bucket, payload)])
                continue
            anchor, context, several = expand(payload, np.uint64, np.uint64, bool)
            order, edge = by_bucket((mix(context) % np.uint64(_SALTS)).astype(np.int64), _SALTS)
            yield message_rows(block, [
                (buckets + hot[bucket] * _SALTS + int(b), shrink(anchor[own], context[own], several[own]))
                for b in np.flatnonzero(np.diff(edge)) for own in [order[edge[b]:edge[b + 1]]]])


def _meet_contexts(bucket: int, messages, buckets: int, crowd: int):
    parts = [expand(p, np.uint64, np.uint64, bool) for _, p in messages]
    anchor, context, several = (np.concatenate(x) for x in zip(*parts))
    source = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    order, at = _distinct(anchor, context)
    anchor, context, several, source = anchor[order], context[order], several[order], source[order]
    pair = np.zeros(len(anchor), np.int64)
    pair[at] = 1
    pair = np.cumsum(pair) - 1
    twice = (np.diff(np.append(at, len(anchor))) > 1) | np.logical_or.reduceat(several, at)
    status = np.where(twice, TWICE, 0)[pair]
    status[at] |= SPEAKER
    if bucket >= buckets:  # part of a crowded bucket: nothing is known of the anchor's other contexts
        status |= MIXED | CROWDED
    else:
        group = np.cumsum(np.concatenate(([0], anchor[at][1:] != anchor[at][:-1])))
        contexts = np.bincount(group)[group]
        status |= np.where(contexts > 1, MIXED, 0)[pair] | np.where(contexts > crowd, CROWDED, 0)[pair]
    needed = (status & (TWICE | MIXED)) > 0
    status[(status & MIXED) == 0] &= ~SPEAKER
    anchor, context, status, source = anchor[needed], context[needed], status[needed].astype(np.uint8), source[needed]
    order, edge = by_bucket(source, len(messages))
    yield reply_rows([(messages[n][0], shrink(np.array([_STATUS]), anchor[own], context[own], status[own]))
                      for n in np.flatnonzero(np.diff(edge)) for own in [order[edge[n]:edge[n + 1]]]])


def _kind(payload: bytes) -> int:
    return int(expand(payload, np.int64)[0][0])


class Statuses:
    """Status of the pairs of a block, from the replies of step 1."""

    def __init__(self, replies: list[bytes]):
        parts = [expand(r, np.int64, np.uint64, np.uint64, np.uint8)[1:] for r in replies if _kind(r) == _STATUS]
        if parts:
            anchor, context, status = (np.concatenate(x) for x in zip(*parts))
        else:
            anchor, context, status = np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.uint8)
        self.key = mix(anchor) ^ context
        order = np.argsort(self.key)
        self.key, self.status = self.key[order], status[order]

    def of(self, anchor: np.ndarray, context: np.ndarray) -> np.ndarray:
        if not len(self.key):
            return np.zeros(len(anchor), np.uint8)
        key = mix(anchor) ^ context
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.status[at], 0)


def _window_keys(part_rolling: Rolling, second: Rolling, first: np.ndarray, count: np.ndarray, length: int):
    """All windows of runs: place, and hash of 128 bits."""
    at = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
    return at, part_rolling.part(at, at + length), second.part(at, at + length)


def _second(block: Block, lo: int, length: int) -> Rolling:
    return Rolling(mix(BYTE_VALUE)[block.data[lo:lo + _PART + length - 1]])


def _say_texts(block: Block, replies, length: int, gram: int, buckets: int):
    known = Statuses(replies)
    if not len(known.key):
        return
    said: set[int] = set()
    for rolling, lo, first, count, anchor, context in _runs(block, length, gram):
        status = known.of(anchor, context)
        speak = np.flatnonzero(status & SPEAKER)
        key = (mix(anchor[speak]) ^ context[speak]).tolist()
        speak = speak[[k not in said and not said.add(k) for k in key]] if key else speak
        calm = speak[(status[speak] & CROWDED) == 0]
        order, edge = by_bucket((anchor[calm] % np.uint64(buckets)).astype(np.int64), buckets)
        rows = []
        for b in np.flatnonzero(np.diff(edge)):
            own = calm[order[edge[b]:edge[b + 1]]]
            text = b"".join(block.data[lo + a:lo + a + n - 1 + length].tobytes() for a, n in zip(first[own], count[own]))
            rows.append((int(b), shrink(np.array([_MARKS]), anchor[own], context[own], count[own].astype(np.int32),
                                        status[own], np.frombuffer(text, np.uint8))))
        loud = speak[(status[speak] & CROWDED) > 0]
        if len(loud):
            _, one, two = _window_keys(rolling, _second(block, lo, length), first[loud], count[loud], length)
            twice = np.repeat((status[loud] & TWICE) > 0, count[loud])
            order, edge = by_bucket((one % np.uint64(buckets)).astype(np.int64), buckets)
            for b in np.flatnonzero(np.diff(edge)):
                own = order[edge[b]:edge[b + 1]]
                rows.append((int(b), shrink(np.array([_COUNTED]), one[own], two[own], twice[own])))
        if rows:
            yield message_rows(block.number, rows)


def _sharing(texts: list[np.ndarray], count: np.ndarray, length: int) -> np.ndarray:
    """Whether any of the first ``count`` windows of a text has the hash of another window: others repeat nothing."""
    begin = np.concatenate(([0], np.cumsum([len(t) for t in texts])[:-1]))
    at = np.repeat(begin - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))
    hashes = Rolling(BYTE_VALUE[np.concatenate(texts)]).windows(length)[at]
    order = np.argsort(hashes)
    equal = np.concatenate(([False], hashes[order[1:]] == hashes[order[:-1]], [False]))
    own = np.repeat(np.arange(len(texts)), count)
    return np.bincount(own[order[equal[1:] | equal[:-1]]], minlength=len(texts)) > 0


def _meet_texts(bucket: int, messages, length: int):
    out = []
    texts = [(n, *expand(p, np.int64, np.uint64, np.uint64, np.int32, np.uint8, np.uint8)[1:])
             for n, (_, p) in enumerate(messages) if _kind(p) == _MARKS]
    if texts:
        source = np.concatenate([np.full(len(t[1]), t[0]) for t in texts])
        anchor, context, count, status, data = (np.concatenate(x) for x in zip(*(t[1:] for t in texts)))
        begin = np.concatenate(([0], np.cumsum(count.astype(np.int64) - 1 + length)))
        order = np.argsort(anchor, kind="stable")
        size = np.cumsum(np.diff(begin)[order])
        # Whole anchors share an array, so many as fit in its size.
        batch = size // _ARRAY_BYTES
        fresh = np.concatenate(([True], anchor[order][1:] != anchor[order][:-1]))
        batch = batch[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        edges = np.concatenate((np.flatnonzero(np.concatenate(([True], batch[1:] != batch[:-1]))), [len(order)]))
        for a, b in zip(edges[:-1], edges[1:]):
            own = order[a:b]
            own = own[_sharing([data[begin[i]:begin[i + 1]] for i in own], count[own].astype(np.int64), length)]
            if not len(own):
                continue
            groups, symbols, ends = maximal_repeats([data[begin[i]:begin[i + 1]].tobytes() for i in own], length)
            reach = np.zeros(len(symbols), np.int64)
            for height, starts in groups:
                reach[starts] = np.maximum(reach[starts], height)
            at = np.flatnonzero(reach)
            repeated = covered(at, at + reach[at] - length + 1, len(symbols))
            starts = ends - (np.diff(begin)[own])
            for i, s in zip(own[(status[own] & TWICE) == 0], starts[(status[own] & TWICE) == 0]):
                lo, hi = spans_of(repeated[s:s + count[i]])
                if len(lo):
                    out.append((int(source[i]), anchor[i], context[i], lo, hi))
    rows = []
    by_source: dict[int, list] = {}
    for n, *mark in out:
        by_source.setdefault(n, []).append(mark)
    for n, marks in by_source.items():
        many = [len(m[2]) for m in marks]
        rows.append((messages[n][0], shrink(np.array([_MARKS]), np.repeat(np.array([m[0] for m in marks], np.uint64), many),
                                            np.repeat(np.array([m[1] for m in marks], np.uint64), many),
                                            np.concatenate([m[2] for m in marks]).astype(np.int32),
                                            np.concatenate([m[3] for m in marks]).astype(np.int32))))
    counted = [(n, *expand(p, np.int64, np.uint64, np.uint64, bool)[1:]) for n, (_, p) in enumerate(messages) if _kind(p) == _COUNTED]
    if counted:
        source = np.concatenate([np.full(len(c[1]), c[0]) for c in counted])
        one, two, twice = (np.concatenate(x) for x in zip(*(c[1:] for c in counted)))
        order, at = _distinct(one, two)
        one, two, twice, source = one[order], two[order], twice[order], source[order]
        many = (np.diff(np.append(at, len(one))) > 1) | np.logical_or.reduceat(twice, at)
        tell = np.repeat(many, np.diff(np.append(at, len(one)))) & ~twice
        one, two, source = one[tell], two[tell], source[tell]
        order, edge = by_bucket(source, len(messages))
        rows += [(messages[n][0], shrink(np.array([_COUNTED]), one[own], two[own]))
                 for n in np.flatnonzero(np.diff(edge)) for own in [order[edge[n]:edge[n + 1]]]]
    if rows:
        yield reply_rows(rows)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                  ("kept_sha256", pa.string()), ("removed", pa.list_(pa.int64()))])


def _finish(block: Block, replies, length: int, gram: int):
    known = Statuses(replies)
    gone = np.zeros(len(block.data), bool)
    if len(known.key):
        marks = [expand(r, np.int64, np.uint64, np.uint64, np.int32, np.int32)[1:] for r in replies if _kind(r) == _MARKS]
        marked: dict[int, list] = {}
        for anchor, context, lo, hi in marks:
            for key, a, b in zip((mix(anchor) ^ context).tolist(), lo.tolist(), hi.tolist()):
                marked.setdefault(key, []).append((a, b))
        counted = [expand(r, np.int64, np.uint64, np.uint64)[1:] for r in replies if _kind(r) == _COUNTED]
        loud_one, loud_two = (np.concatenate(x) for x in zip(*counted)) if counted else (np.empty(0, np.uint64),) * 2
        order = np.argsort(loud_one)
        loud_one, loud_two = loud_one[order], loud_two[order]
        starts, ends = [], []
        for rolling, at, first, count, anchor, context in _runs(block, length, gram):
            status = known.of(anchor, context)
            whole = (status & TWICE) > 0
            starts.append(at + first[whole])
            ends.append(at + first[whole] + count[whole] - 1 + length)
            if marked:
                for i in np.flatnonzero(~whole & ((status & MIXED) > 0) & ((status & CROWDED) == 0)):
                    for a, b in marked.get(int(mix(anchor[i:i + 1])[0] ^ context[i]), ()):
                        starts.append(np.array([at + first[i] + a]))
                        ends.append(np.array([at + first[i] + b - 1 + length]))
            loud = np.flatnonzero(~whole & ((status & CROWDED) > 0))
            if len(loud) and len(loud_one):
                places, one, two = _window_keys(rolling, _second(block, at, length), first[loud], count[loud], length)
                slot = np.minimum(np.searchsorted(loud_one, one), len(loud_one) - 1)
                hit = (loud_one[slot] == one) & (loud_two[slot] == two)
                starts.append(at + places[hit])
                ends.append(at + places[hit] + length)
        if starts:
            gone = covered(np.concatenate(starts), np.concatenate(ends), len(gone))
    rows = []
    for doc, a, b in zip(block.id_list(), block.starts[:-1], block.starts[1:]):
        flags = gone[a:b]
        lo, hi = spans_of(flags)
        rows.append((doc, int(b - a), int(flags.sum()), len(lo), hashlib.sha256(block.data[a:b][~flags].tobytes()).hexdigest(),
                     np.stack((lo, hi), 1).ravel()))
    yield table(dict(zip(_OUT.names, zip(*rows))), _OUT)


def suffix_dedup(docs: DataFrame, *, length: int = LENGTH, gram: int | None = None, crowd: int = CROWD,
                 bucket_bytes: int = 8 * BUCKET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed`` per row of ``docs``.

    ``removed`` lists starts and ends (bytes, end exclusive) of the maximal runs cut out.  Texts are UTF-8 bytes and
    null is empty; matches stay within a row.  Repeated rows are copies of each other, whatever their ids; null ids
    stay null; texts shorter than ``length`` are never touched; an empty table gives an empty one; other columns are
    not read.
    """
    spark = docs.sparkSession
    gram = gram or max(1, length * GRAM // LENGTH)
    texts = block_table(docs, id_col, text_col)
    buckets = bucket_count(texts, 1 << 19)
    said = written(ask(texts, partial(_say_contexts, length=length, gram=gram, buckets=buckets), MESSAGE), "contexts")
    full = said.groupBy("bucket").agg(F.sum(F.octet_length("payload")).alias("bytes")).where(F.col("bytes") > bucket_bytes)
    hot = {r["bucket"]: i for i, r in enumerate(full.orderBy("bucket").collect())}
    if hot:
        said = said.mapInArrow(partial(_split, hot=hot, buckets=buckets), MESSAGE)
    status = written(meet_in_buckets(said, partial(_meet_contexts, buckets=buckets, crowd=crowd), REPLY), "status")
    release(spark)
    said = ask(texts, partial(_say_texts, length=length, gram=gram, buckets=buckets), MESSAGE, status)
    marks = written(meet_in_buckets(said, partial(_meet_texts, length=length), REPLY), "marks")
    release(spark)
    return ask(texts, partial(_finish, length=length, gram=gram),
               "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<long>",
               status.unionByName(marks))
