"""JSON files of any layout read in byte ranges: lines, one array, one document, or values one after the other.

A file is a sequence of values; the elements of an outermost array are records, and so is every other outermost value.  A
range is scanned without knowing what stands before it: for both ways it may begin (outside or inside a string) it says
how the brackets outside strings move the depth, how deep they fall, and which bracket opened the value that is open at the
end.  These few numbers per range, put together in file order, tell every range its true beginning; a second pass then
reads the records that begin in a range, on to their end, wherever that lies.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnbook.session import cut_lineage
from cairnbook.sources import fieldtypes

RANGE_BYTES = 16 << 20
# What is read of a file to see how its values lie.
FIRST_LINE_BYTES = 1 << 20
SAMPLE_ROWS = 5

_QUOTE, _BACKSLASH, _OPEN_LIST, _CLOSE_LIST, _OPEN, _CLOSE = 34, 92, 91, 93, 123, 125
_EVENT = np.zeros(256, bool)
_EVENT[[_QUOTE, _OPEN_LIST, _CLOSE_LIST, _OPEN, _CLOSE]] = True
_STEP = np.zeros(256, np.int8)
_STEP[[_OPEN_LIST, _OPEN]], _STEP[[_CLOSE_LIST, _CLOSE]] = 1, -1
# Signs between values, which belong to none.
_BETWEEN = np.zeros(256, bool)
_BETWEEN[[9, 10, 13, 32, 44]] = True


def events_of(data: np.ndarray, lead: int) -> tuple[np.ndarray, np.ndarray]:
    """Places behind the first ``lead`` bytes of brackets and of quotes that are not escaped, and the bytes there.

    Backslashes stand inside strings only, so whether a quote is escaped does not depend on the state.
    """
    at = np.flatnonzero(_EVENT[data])
    quotes = at[data[at] == _QUOTE]
    slashes = np.flatnonzero(data == _BACKSLASH)
    if len(slashes) and len(quotes):
        first = np.flatnonzero(np.diff(slashes, prepend=-2) != 1)
        size = np.diff(np.append(first, len(slashes)))
        run_end = slashes[first] + size  # the place behind each run of backslashes
        run = np.minimum(np.searchsorted(run_end, quotes), len(run_end) - 1)
        escaped = (run_end[run] == quotes) & (size[run] % 2 == 1)
        at = np.setdiff1d(at, quotes[escaped], assume_unique=True)
    at = at[at >= lead]
    return at, data[at]


def range_facts(data: np.ndarray, lead: int) -> tuple[int, list[tuple[int, int, int]]]:
    """``(parity of quotes, per beginning (change of depth, lowest depth, opener of what is open since then))``."""
    _, kind = events_of(data, lead)
    quote = kind == _QUOTE
    inside = (np.cumsum(quote) - quote) % 2
    out = []
    for begins_inside in (0, 1):
        own = kind[~quote & (inside == begins_inside)]
        depth = np.cumsum(_STEP[own], dtype=np.int64)
        low = int(min(depth.min(initial=0), 0))
        last = np.flatnonzero(depth == low)
        behind = int(last[-1]) + 1 if len(last) else 0
        out.append((int(depth[-1]) if len(depth) else 0, low, int(own[behind]) if behind < len(own) else 0))
    return int(quote.sum() % 2), out


def record_spans(data: np.ndarray, lead: int, inside: int, depth: int, opener: int) -> tuple[np.ndarray, np.ndarray]:
    """First and one-past-last places of the records that begin behind ``lead``; an end of -1 lies behind the data."""
    at, kind = events_of(data, lead)
    quote = kind == _QUOTE
    before = (inside + np.cumsum(quote) - quote) % 2  # inside a string in front of each event
    step = np.where(quote | (before == 1), 0, _STEP[kind])
    after_depth = depth + np.cumsum(step)
    before_depth = after_depth - step
    # The outermost bracket in front of each event: the last one that opened at depth 0.
    opened = np.where((step == 1) & (before_depth == 0), np.arange(len(at)), -1)
    last = np.maximum.accumulate(opened) if len(opened) else opened
    outer_after = np.where(last >= 0, kind[np.maximum(last, 0)], opener)
    outer = np.concatenate(([opener], outer_after[:-1])) if len(at) else outer_after
    between = (before == 0) & ((before_depth == 0) | ((before_depth == 1) & (outer == _OPEN_LIST)))
    inside_after = (before + quote) % 2
    between_after = (inside_after == 0) & ((after_depth == 0) | ((after_depth == 1) & (outer_after == _OPEN_LIST)))
    begins = between & (quote | ((step == 1) & ~((kind == _OPEN_LIST) & (before_depth == 0))))
    closing = at[between_after]
    starts = at[begins]
    place = np.searchsorted(closing, starts, "right")
    ends = np.where(place < len(closing), closing[np.minimum(place, max(len(closing) - 1, 0))] + 1, -1) if len(closing) else np.full(len(starts), -1)
    # Numbers and words stand between events; each stretch there is looked through for runs of their signs.
    first_level = inside == 0 and (depth == 0 or (depth == 1 and opener == _OPEN_LIST))
    lo = np.concatenate(([lead], at + 1))
    hi = np.concatenate((at, [len(data)]))
    plain = np.concatenate(([first_level], between_after)) & (hi > lo)
    more_starts, more_ends = [], []
    for a, b in zip(lo[plain].tolist(), hi[plain].tolist()):
        sign = ~_BETWEEN[data[a:b]]
        if not sign.any():
            continue
        edge = np.flatnonzero(np.diff(np.concatenate(([False], sign, [False])).view(np.int8)))
        run, end = edge[::2] + a, edge[1::2] + a
        goes_on = run[0] == a and a == lead and lead > 0 and not (_BETWEEN[data[a - 1]] or _EVENT[data[a - 1]])
        more_starts.append(run[1:] if goes_on else run)
        more_ends.append(np.where(end == len(data), -1, end)[1:] if goes_on else np.where(end == len(data), -1, end))
    starts, ends = np.concatenate([starts, *more_starts]), np.concatenate([ends, *more_ends])
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order]


def _lead(handle, start: int) -> bytes:
    """The byte in front of a range, and the whole run of backslashes there if it is one."""
    size = min(start, 64)
    while True:
        raw = handle.read_at(size, start - size) if size else b""
        if size == start or raw.strip(b"\\"):
            keep = len(raw) - len(raw.rstrip(b"\\"))
            return raw[-max(keep, 1):] if raw else b""
        size = min(start, size * 8)


_FACTS = "path string, start long, swaps int, out_delta long, out_low long, out_open int, in_delta long, in_low long, in_open int, failed boolean"


def _scanner(open_file: Callable, chunk: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _FACTS.split(", ")]
        for batch in batches:
            out = []
            for path, size, start in zip(batch["path"], batch["size_bytes"].tolist(), batch["start"].tolist()):
                try:
                    with open_file(path) as handle:
                        lead = _lead(handle, start)
                        data = np.frombuffer(lead + handle.read_at(min(chunk, size - start), start), np.uint8)
                    swaps, facts = range_facts(data, len(lead))
                    out.append((path, start, swaps, *facts[0], *facts[1], False))
                except Exception:  # noqa: BLE001 - one bad file must not stop the scan
                    out.append((path, start, *[0] * 7, True))
            yield pd.DataFrame(out, columns=names)

    return scan


_BEGINS = "path string, start long, inside int, depth long, opener int, sound boolean"


def _carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How each range begins, from the facts in file order; behind a file's last range a row that says whether all closes."""
    names = [c.split()[0] for c in _BEGINS.split(", ")]
    now, state = None, (0, 0, 0, True)
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if r.path != now:
                if now is not None:
                    out.append((now, None, *state[:3], state[3] and state[:2] == (0, 0)))
                now, state = r.path, (0, 0, 0, True)
            inside, depth, opener, sound = state
            out.append((now, r.start, inside, depth, opener, None))
            delta, low, opened = (r.in_delta, r.in_low, r.in_open) if inside else (r.out_delta, r.out_low, r.out_open)
            state = ((inside + r.swaps) % 2, depth + delta, opened if depth + low <= 0 else opener, sound and depth + low >= 0)
        yield pd.DataFrame(out, columns=names).astype({"start": "Int64"})
    if now is not None:
        yield pd.DataFrame([(now, None, *state[:3], state[3] and state[:2] == (0, 0))], columns=names).astype({"start": "Int64"})


def values_in(handle, start: int, stop: int, size: int, inside: int, depth: int, opener: int) -> Iterator[tuple[int, bytes | None]]:
    """Place and text of every record that begins in ``[start, stop)``, read on to its end; None: the file ends before."""
    lead = _lead(handle, start)
    read_to, more = stop, 1 << 20
    while True:
        raw = lead + handle.read_at(read_to - start, start)
        data = np.frombuffer(raw, np.uint8)
        if start == 0 and raw[:3] == b"\xef\xbb\xbf":  # a byte order mark
            data = np.concatenate((np.full(3, 32, np.uint8), data[3:]))
        first, end = record_spans(data, len(lead), inside, depth, opener)
        own = first < len(lead) + stop - start
        first, end = first[own], end[own]
        if not len(end) or end[-1] >= 0 or read_to >= size:
            break
        read_to, more = min(size, read_to + more), more * 4
    whole = data.tobytes()
    for a, b in zip(first.tolist(), end.tolist()):
        # Without brackets and quotes a value may end with the file.
        if b < 0 and not _EVENT[data[a]]:
            b = len(whole)
        yield start - len(lead) + a, whole[a:b] if b >= 0 else None


_FOLDED = "path string, start long, records long, bad long, name string, flags int, first_at long, first_no int, samples string, failed boolean"


def _folder(open_file: Callable, chunk: int, masked: Callable):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _FOLDED.split(", ")]
        for batch in batches:
            for path, size, start, inside, depth, opener in zip(*(batch[c].tolist() for c in ("path", "size_bytes", "start", "inside", "depth", "opener"))):
                found: dict[str, list[int]] = {}
                samples, count, bad, failed = [], 0, 0, False
                try:
                    with open_file(path) as handle:
                        for at, text in values_in(handle, start, min(start + chunk, size), size, inside, depth, opener):
                            try:
                                value = json.loads(text) if text is not None else None
                            except (ValueError, RecursionError):
                                text = None
                            if text is None:
                                bad += 1
                                continue
                            record = value if isinstance(value, dict) else {"value": value}
                            count += 1
                            if len(samples) < SAMPLE_ROWS:
                                samples.append(record)
                            for no, (name, v) in enumerate(record.items()):
                                seen = found.get(name)
                                if seen is None:
                                    found[name] = [fieldtypes.json_flags(v), at, no]
                                else:
                                    seen[0] &= fieldtypes.json_flags(v)
                except Exception:  # noqa: BLE001 - one bad file must not stop the scan
                    failed = True
                rows = [(path, start, count, bad, None, fieldtypes.UNSEEN, 0, 0, masked(samples), failed)]
                rows += [(path, start, 0, 0, name, *seen, None, False) for name, seen in found.items()]
                yield pd.DataFrame(rows, columns=names)

    return fold


def _layouts(open_file: Callable):
    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, size in zip(batch["path"], batch["size_bytes"].tolist()):
                with open_file(path) as handle:
                    head = handle.read_at(min(size, FIRST_LINE_BYTES), 0).removeprefix(b"\xef\xbb\xbf").lstrip()
                line, end, _ = head.partition(b"\n")
                whole = bool(end) or size <= FIRST_LINE_BYTES
                try:
                    found = json.loads(line) if whole else None
                except ValueError:
                    found = None
                # A document or list that ends with its line; a word or number says nothing and is left to the lines.
                opens = head[:1] in (b"{", b"[")
                out.append((path, bool(head) and opens and not isinstance(found, dict | list)))
            yield pd.DataFrame(out, columns=["path", "by_value"])

    return look


def layouts(files: DataFrame, open_file: Callable, parts: int) -> DataFrame:
    """``path, by_value``: whether a file begins with a document or list that does not end with its first line."""
    return files.where(F.col("size_bytes") > 0).select("path", "size_bytes").repartition(parts, "path").mapInPandas(
        _layouts(open_file), "path string, by_value boolean")


def _teller(open_file: Callable, chunk: int):
    def tell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, size, start, inside, depth, opener in zip(*(batch[c].tolist() for c in ("path", "size_bytes", "start", "inside", "depth", "opener"))):
                out = []
                with open_file(path) as handle:
                    for at, text in values_in(handle, start, min(start + chunk, size), size, inside, depth, opener):
                        if text is not None:
                            # A line end that is not written as a sign of its own is a blank between values.
                            out.append((path, at, text.replace(b"\r", b" ").replace(b"\n", b" ").decode("utf-8", "replace")))
                        if len(out) >= 1000:
                            yield pd.DataFrame(out, columns=["path", "at", "value"])
                            out = []
                if out:
                    yield pd.DataFrame(out, columns=["path", "at", "value"])

    return tell


def json_values(files: DataFrame, open_file: Callable, parts: int, chunk: int = RANGE_BYTES) -> DataFrame:
    """``path, at, value``: the text of every record of JSON files ``(path, size_bytes)``, on one line, by many tasks per file."""
    _, carried = _states(files, open_file, parts, chunk)
    begins = carried.where("start IS NOT NULL").join(files.select("path", "size_bytes"), "path").repartition(parts, "path", "start")
    return begins.select("path", "size_bytes", "start", "inside", "depth", "opener").mapInPandas(
        _teller(open_file, chunk), "path string, at long, value string")


def _states(files: DataFrame, open_file: Callable, parts: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Facts of all ranges, and how each begins."""
    ranges = files.where(F.col("size_bytes") > 0).select("path", "size_bytes", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("size_bytes") - 1, F.lit(chunk).cast("long"))).alias("start"))
    facts = cut_lineage(ranges.repartition(parts, "path", "start").mapInPandas(_scanner(open_file, chunk), _FACTS), "json_ranges")
    # A few numbers per range; the ranges of one file follow each other in one task.
    carried = facts.where("NOT failed").repartition(parts, "path").sortWithinPartitions("path", "start").mapInPandas(_carry, _BEGINS)
    return facts, cut_lineage(carried, "json_begins")


def json_facts(files: DataFrame, open_file: Callable, masked: Callable, parts: int, chunk: int = RANGE_BYTES) -> DataFrame:
    """``path, row_count, fields, sample_rows, problem`` of JSON files ``(path, size_bytes)``.

    ``fields`` are ``(name, flags)`` in the order in which the file first shows them, over all its records.  Records that
    do not parse are counted in ``problem``.  Samples come from the first range in which a record begins.
    """
    facts, carried = _states(files, open_file, parts, chunk)
    unread = facts.where("failed").select("path", F.lit(True).alias("unread")).distinct()
    begins = carried.where("start IS NOT NULL")
    folded = (begins.join(files.select("path", "size_bytes"), "path").repartition(parts, "path", "start")
              .select("path", "size_bytes", "start", "inside", "depth", "opener").mapInPandas(_folder(open_file, chunk, masked), _FOLDED))
    # One row per field and file, then one per file.  The null name is the range itself.
    first = F.min(F.struct("first_at", "first_no")).alias("first")
    fields = folded.groupBy("path", "name").agg(
        F.bit_and("flags").alias("flags"), first, F.sum("records").alias("records"), F.sum("bad").alias("bad"),
        F.min_by("samples", F.when(F.col("records") > 0, F.col("start"))).alias("samples"), F.bool_or("failed").alias("failed"))
    field = F.when(F.col("name").isNotNull(), F.struct("first", "name", "flags"))
    told = fields.groupBy("path").agg(
        F.sum("records").alias("row_count"), F.sum("bad").alias("bad"), F.max("samples").alias("sample_rows"), F.bool_or("failed").alias("failed"),
        F.transform(F.array_sort(F.collect_list(field)), lambda f: F.struct(f["name"].alias("name"), f["flags"].alias("flags"))).alias("fields"))
    sound = carried.where("start IS NULL").select("path", "sound")
    problem = (F.when(F.coalesce("unread", F.lit(False)) | F.coalesce("failed", F.lit(False)), "file could not be read to its end")
               .when(F.col("bad") > 0, F.concat("bad", F.lit(" of its records could not be read")))
               .when(~F.coalesce("sound", F.lit(True)), "its brackets do not close"))
    return (files.select("path").join(told, "path", "left").join(sound, "path", "left").join(unread, "path", "left")
            .select("path", F.coalesce("row_count", F.lit(0).cast("long")).alias("row_count"), "fields", "sample_rows", problem.alias("problem")))
