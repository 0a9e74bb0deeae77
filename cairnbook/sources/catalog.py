"""Catalog scan: one record per listed file with schema, row count and masked samples."""

from __future__ import annotations

import csv
import json
import sys
from collections.abc import Iterator
from itertools import islice, zip_longest

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from cairnbook.functions.html import to_markdown
from cairnbook.functions.text import extension
from cairnbook.operators.privacy import MASK, is_personal, is_personal_col
from cairnbook.session import cut_lineage
from cairnbook.sources import fieldtypes
from cairnbook.sources.jsonranges import RANGE_BYTES, json_facts
from cairnbook.sources.listing import (DEFAULT_EXCLUDES, LISTED_BY_DEFAULT, _file_system, list_files, scan_tier,
                                       scannable, unreadable, walk_folders, within_size)
from cairnbook.sources.workbook import sheet_rows

SAMPLE_ROWS = 5
# Delimited text is counted, split and typed in ranges of this size; a task holds all records of one, as Python objects.
CHUNK_BYTES = 4 << 20
# A buffered read of this size instead of a whole row group when only the first rows are wanted.
SAMPLE_BUFFER = 64 << 10
# Records whose column types are folded at a time.
_FOLD_ROWS = 5000
_DELIMITED, _JSON = ("csv", "tsv"), ("json", "jsonl", "ndjson")

_RECORD = ("path string, relative_path string, size_bytes long, modified timestamp, file_format string, tier string, "
           "row_count long, schema_json string, sample_rows string, samples_redacted boolean, error string")


def _catalog_type(dt: pa.DataType) -> str:
    if pa.types.is_boolean(dt):
        return "BOOLEAN"
    if pa.types.is_integer(dt):
        return "BIGINT"
    if pa.types.is_floating(dt) or pa.types.is_decimal(dt):
        return "DOUBLE"
    if pa.types.is_date(dt):
        return "DATE"
    if pa.types.is_timestamp(dt):
        return "TIMESTAMP"
    return "VARCHAR"


def _open(path: str):
    fs, inner = _file_system(path)
    return fs.open_input_file(inner)


def _stored(dt: pa.DataType) -> str:
    """Spark's name of an Arrow type."""
    return from_arrow_type(dt, True).simpleString()


def _masked(rows: list[dict]) -> str | None:
    if not rows:
        return None
    return json.dumps([{k: MASK if is_personal(k) else v for k, v in r.items()} for r in rows], default=str)


def _sheet_facts(rows: Iterator[list[str]]) -> tuple[int, list[tuple[str, str, str]], list[dict]]:
    """Count, columns and first rows of a sheet whose first row names the columns; types come from all rows."""
    names = next(rows, [])
    flags, first, count = [fieldtypes.UNSEEN] * len(names), [], 0
    while part := list(islice(rows, _FOLD_ROWS)):
        first += part[:SAMPLE_ROWS - len(first)]
        count += len(part)
        flags = _folded(part, flags)[:len(names)]
    cols = [(n, fieldtypes.type_of(f), fieldtypes.NO_VALUES if f == fieldtypes.UNSEEN else fieldtypes.type_of(f)) for n, f in zip(names, flags)]
    return count, cols, [dict(zip(names, r)) for r in first]


def _folded(rows: list[list[str]], flags: list[int]) -> list[int]:
    """Type flags of the columns after some more records; records may be short or long."""
    columns = list(zip_longest(*rows))
    flags = flags + [fieldtypes.UNSEEN] * (len(columns) - len(flags))
    return [fieldtypes.fold_texts(columns[i], f) if i < len(columns) else f for i, f in enumerate(flags)]


def _inspect(path: str, fmt: str, tier: str) -> dict:
    """Footer and first rows of a Parquet file, all rows of a workbook, a page; shallow files are not opened."""
    cols, rows, count = [], [], None
    if tier != "shallow":
        with _open(path) as handle:
            if fmt == "parquet":
                parquet = pq.ParquetFile(handle, buffer_size=SAMPLE_BUFFER)
                cols = [(f.name, _catalog_type(f.type), _stored(f.type)) for f in parquet.schema_arrow]
                count = parquet.metadata.num_rows
                filled = next((i for i in range(parquet.num_row_groups) if parquet.metadata.row_group(i).num_rows), None)
                first = next(parquet.iter_batches(SAMPLE_ROWS, row_groups=[filled]), None) if filled is not None else None
                rows = first.to_pylist()[:SAMPLE_ROWS] if first is not None else []
            elif fmt == "xlsx":
                count, cols, rows = _sheet_facts(sheet_rows(handle))
            elif fmt in ("html", "htm"):
                title, body = to_markdown(handle.read().decode("utf-8", "replace"))
                cols, rows, count = [("title", "VARCHAR"), ("markdown", "VARCHAR")], [{"title": title, "markdown": body}], 1
            else:
                return {"row_count": None, "schema_json": None, "sample_rows": None, "samples_redacted": False}
    return {
        "row_count": count,
        "schema_json": json.dumps([
            {"name": n, "type": t, "nullable": True, "stored": s[0] if s else t} for n, t, *s in cols]) if tier != "shallow" else None,
        "sample_rows": _masked(rows),
        "samples_redacted": any(is_personal(n) for n, *_ in cols),
    }


def _inspect_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for row in batch.to_dict("records"):
            facts = {"row_count": None, "schema_json": None, "sample_rows": None, "samples_redacted": False}
            try:
                facts.update(_inspect(row["path"], row["file_format"], row["tier"]))
                error = None
            except Exception as exc:  # noqa: BLE001 - one bad file must not stop the scan
                error = f"{type(exc).__name__}: {exc}"
            out.append({**row, **facts, "error": error})
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in _RECORD.split(", ")])
        frame["row_count"] = frame["row_count"].astype("Int64")
        yield frame


def quote_states(data: np.ndarray, lead: int, sep: int):
    """How quotes open and close in a range of bytes: ``(starts of quote runs, state after each, state at the end)``.

    ``data`` begins with ``lead`` bytes of what stands before the range.  A quote opens a field only where the field
    begins; inside, two quotes are one sign and a single one closes.  So a run of quotes either swaps inside and
    outside (odd, at a field's start), or closes (odd, elsewhere), or changes nothing.  States are given for both
    beginnings: row 0 for a range that begins outside quotes, row 1 for one that begins inside.
    """
    quote = data == 34
    edge = np.flatnonzero(np.diff(np.concatenate(([False], quote, [False])).astype(np.int8)))
    begin, size = edge[::2], edge[1::2] - edge[::2]
    own = begin >= lead  # a run that began before belongs to the range before
    begin, size = begin[own], size[own]
    before = np.where(begin > 0, data[np.maximum(begin - 1, 0)], 10)
    opening = np.isin(before, (sep, 10, 13))
    odd = size % 2 == 1
    swaps = np.cumsum(odd & opening)
    reset = np.where(odd & ~opening, np.arange(len(begin)), -1)
    last = np.maximum.accumulate(reset) if len(reset) else reset
    since = swaps - np.where(last >= 0, swaps[np.maximum(last, 0)], 0)
    states = np.stack([np.where(last >= 0, since % 2, (start + swaps) % 2) for start in (0, 1)]) if len(begin) else np.empty((2, 0), int)
    return begin, states, [int(states[k, -1]) if len(begin) else k for k in (0, 1)]


def state_at(places: np.ndarray, begin: np.ndarray, states: np.ndarray, start: int) -> np.ndarray:
    """Whether each place lies inside quotes, for a range that begins in the state ``start``."""
    if not len(begin):
        return np.full(len(places), start)
    run = np.searchsorted(begin, places) - 1
    return np.where(run >= 0, states[start][np.maximum(run, 0)], start)


_RANGE_COLUMNS = ["path", "start", "if_outside", "if_inside", "outside_to", "inside_to", "all_lines", "failed"]


def _line_counter(chunk: int):
    """Counter of record ends in byte ranges of at most ``chunk`` bytes."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, size, start, fmt in zip(batch["path"], batch["size_bytes"], batch["start"], batch["file_format"]):
                try:
                    with _open(path) as handle:
                        lead = min(int(start), 2)
                        many = min(chunk, int(size) - int(start))
                        raw = handle.read_at(many + lead, int(start) - lead)
                        more, at = b"", int(start) + many
                        while raw[-1:] == b'"' and at < size:  # a run of quotes is read to its end
                            piece = handle.read_at(64, at)
                            run = len(piece) - len(piece.lstrip(b'"'))
                            more += piece[:run]
                            at += run
                            if run < len(piece):
                                break
                    data = np.frombuffer(b"\n" * (2 - lead) + raw + more, dtype=np.uint8)
                    begin, states, end = quote_states(data, 2, 9 if fmt == "tsv" else 44)
                    line = np.flatnonzero(data[2:2 + many] == 10) + 2
                    before = data[line - 1]
                    line = line[np.where(before == 13, data[line - 2], before) != 10]
                    if int(start) + many >= int(size) and many and data[1 + many] not in (10, 13):
                        line = np.append(line, 2 + many)
                    inside = [state_at(line, begin, states, k) for k in (0, 1)]
                    out.append((path, int(start), *(int((x == 0).sum()) for x in inside), *end, len(line), False))
                except Exception:  # noqa: BLE001 - one bad file must not stop the scan
                    out.append((path, int(start), 0, 0, 0, 1, 0, True))
            yield pd.DataFrame(out, columns=_RANGE_COLUMNS)

    return count


def _parts(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def count_lines(files: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """``(path, lines, failed)``: non-blank records of delimited files, header included.

    Files are cut into byte ranges counted by separate tasks, so one huge file spreads over the cluster.  A line
    end inside quotes is no record end; every range says what it counts and how it ends for both ways it may
    begin, and a file's ranges, a few numbers each, are put together in order.
    """
    return _lines_of(_range_facts(files, chunk))


def _lines_of(counted: DataFrame) -> DataFrame:
    told = F.aggregate(_in_order(), _ZERO(), lambda acc, r: _next(acc, r))
    return counted.groupBy("path").agg(told["lines"].alias("lines"), F.bool_or("failed").alias("failed"))


def _in_order():
    return F.array_sort(F.collect_list(F.struct("start", "if_outside", "if_inside", "outside_to", "inside_to")))


def _ZERO():
    return F.struct(F.lit(0).alias("state"), F.lit(0).cast("long").alias("lines"))


def _next(acc, r):
    """State and records after one more range."""
    return F.struct(F.when(acc["state"] == 0, r["outside_to"]).otherwise(r["inside_to"]).alias("state"),
                    (acc["lines"] + F.when(acc["state"] == 0, r["if_outside"]).otherwise(r["if_inside"])).alias("lines"))


def _range_facts(files: DataFrame, chunk: int) -> DataFrame:
    if "file_format" not in files.columns:
        files = files.withColumn("file_format", extension(F.col("path")))
    ranges = files.where(F.col("size_bytes") > 0).select("path", "size_bytes", "file_format", F.explode(F.sequence(
        F.lit(0).cast("long"), F.col("size_bytes") - 1, F.lit(chunk).cast("long"))).alias("start"))
    # A fixed number of partitions: each tiny row stands for much work, which adaptive
    # merging of small partitions cannot know.
    return ranges.repartition(_parts(files.sparkSession), "path", "start").mapInPandas(
        _line_counter(chunk), "path string, start long, if_outside long, if_inside long, outside_to int, inside_to int, "
                              "all_lines long, failed boolean")


def quoted_line_ends(files: DataFrame, chunk: int = CHUNK_BYTES) -> bool:
    """Whether any record of delimited files spans several lines."""
    facts = _range_facts(files, chunk).groupBy("path").agg(
        F.aggregate(_in_order(), _ZERO(), _next)["lines"].alias("records"), F.sum("all_lines").alias("lines"))
    return not facts.where("records < lines").isEmpty()


def _records_in(path: str, start: int, size: int, state: int, fmt: str, chunk: int) -> list[list[str]]:
    """Records that begin in a range, read on to their end, as fields; blank ones are no records."""
    sep = "\t" if fmt == "tsv" else ","
    with _open(path) as handle:
        lead, stop = min(start, 1), min(start + chunk, size)
        read_to = stop
        while True:
            raw = b"\n" * (1 - lead) + handle.read_at(read_to - start + lead, start - lead)
            data = np.frombuffer(raw, np.uint8)
            begin, states, _ = quote_states(data, 1, ord(sep))
            line = np.flatnonzero(data == 10)
            line = line[(line == 0) | (state_at(line, begin, states, state) == 0)]
            if state:
                line = line[line > 0]
            after = line[line >= stop - start]  # a record end at or behind the last byte of the range
            if len(after) or read_to >= size:
                break
            read_to = min(size, read_to + max(chunk, 1 << 20))
    first = line[line < stop - start + 1]
    if not len(first) or first[0] + 1 >= stop - start + 1:
        return []
    text = raw[first[0] + 1:after[0] + 1 if len(after) else len(raw)].decode("utf-8", "replace")
    return [r for r in csv.reader((x + "\n" for x in text.split("\n")), delimiter=sep) if r]


_RANGE = ("path", "start", "size_bytes", "state", "file_format")


def _splitter(chunk: int):
    """Records that begin in a range, as rows."""
    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            for path, start, size, state, fmt in zip(*(batch[c] for c in _RANGE)):
                rows = _records_in(path, int(start), int(size), int(state), fmt, chunk)
                if rows:
                    yield pd.DataFrame({"path": path, "start": start, "no": range(len(rows)), "fields": rows})

    return split


def _typer(chunk: int):
    """Per range: its first record, some after it as JSON, and the type flags of all columns without and with the first."""
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            for path, start, size, state, fmt in zip(*(batch[c] for c in _RANGE)):
                rows, failed = [], False
                try:
                    rows = _records_in(path, int(start), int(size), int(state), fmt, chunk)
                except Exception:  # noqa: BLE001 - one bad file must not stop the scan
                    failed = True
                if not rows and not failed:
                    continue
                rest: list[int] = []
                for lo in range(1, len(rows), _FOLD_ROWS):
                    rest = _folded(rows[lo:lo + _FOLD_ROWS], rest)
                head = rows[0] if rows else None
                yield pd.DataFrame([(path, int(start), head, _masked([dict(zip(head, r)) for r in rows[1:SAMPLE_ROWS + 1]]) if rows else None,
                                     rest, _folded(rows[:1], rest), failed)],
                                   columns=["path", "start", "head", "samples", "rest", "every", "failed"])

    return fold


def _carry_states(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state each range begins in; a file's ranges come in order, a few numbers each."""
    now, state = None, 0
    for batch in batches:
        out = []
        for path, start, outside_to, inside_to in zip(batch["path"], batch["start"], batch["outside_to"], batch["inside_to"]):
            if path != now:
                now, state = path, 0
            out.append((path, start, state))
            state = inside_to if state else outside_to
        yield pd.DataFrame(out, columns=["path", "start", "state"])


def _ranges_with_states(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Every range of ``files`` with the state it begins in, spread over tasks again."""
    n = _parts(files.sparkSession)
    ordered = facts.select("path", "start", "outside_to", "inside_to").repartition(n, "path").sortWithinPartitions("path", "start")
    ranges = ordered.mapInPandas(_carry_states, "path string, start long, state int")
    return ranges.join(files.select("path", "size_bytes", "file_format"), "path").repartition(n, "path", "start")


def delimited_facts(files: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """``path, row_count, fields, sample_rows, problem`` of delimited files ``(path, size_bytes, file_format)``.

    The first record names the columns; their type flags are folded over all other records, range by range.  Fields
    behind the named ones are not described.
    """
    facts = cut_lineage(_range_facts(files, chunk), "text_ranges")
    folded = cut_lineage(_ranges_with_states(facts.where("NOT failed"), files).mapInPandas(
        _typer(chunk), "path string, start long, head array<string>, samples string, rest array<int>, every array<int>, failed boolean"), "text_types")
    heads = folded.where("head IS NOT NULL").groupBy("path").agg(
        F.min_by("head", "start").alias("head"), F.min_by("samples", "start").alias("sample_rows"), F.min("start").alias("head_at"))
    flags = (folded.join(heads.select("path", "head_at"), "path")
             .select("path", F.posexplode(F.when(F.col("start") == F.col("head_at"), F.col("rest")).otherwise(F.col("every"))))
             .groupBy("path", "pos").agg(F.bit_and("col").alias("flags")))
    flags = flags.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("pos", "flags"))).alias("by_place"))
    fields = F.transform("head", lambda name, i: F.struct(name.alias("name"), F.coalesce(
        F.try_element_at("by_place", i), F.lit(fieldtypes.UNSEEN)).alias("flags")))
    told = heads.join(flags, "path", "left").select("path", fields.alias("fields"), "sample_rows")
    failed = folded.where("failed").select("path").unionByName(facts.where("failed").select("path")).distinct().withColumn("_bad", F.lit(True))
    return (files.select("path").join(_lines_of(facts), "path", "left").join(told, "path", "left").join(failed, "path", "left")
            .select("path", F.when(F.col("_bad").isNull(), F.greatest(F.coalesce("lines", F.lit(0).cast("long")) - 1, F.lit(0).cast("long"))).alias("row_count"),
                    "fields", "sample_rows", F.when(F.col("_bad"), "file could not be read to its end").alias("problem")))


def split_records(files: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """``(path, start, no, fields)``: every non-blank record of delimited files, line ends inside quotes included.

    One huge file is split by many tasks: a first pass tells for each byte range whether it begins inside quotes,
    a second reads the records that begin in it.
    """
    if "file_format" not in files.columns:
        files = files.withColumn("file_format", extension(F.col("path")))
    return _ranges_with_states(_range_facts(files, chunk), files).mapInPandas(
        _splitter(chunk), "path string, start long, no long, fields array<string>")


def scan_files(spark: SparkSession, listing: DataFrame, parts: int | None = None,
               tiers: dict[str, str] | None = None, max_mb: int | None = None, chunk: int | None = None) -> DataFrame:
    """Dataset records of listed files: one for every file, whatever its format.

    Parquet facts come from footers read in the tasks; delimited and JSON files are read in byte ranges, which fold
    names, types and counts of all their records; workbooks and pages are read by their readers; a tier says
    how deep, and shallow files are not opened.  An unreadable file keeps its record and says why, and so does one
    larger than ``max_mb``, if such a bound is asked for.  A listing that has a ``file_format`` overrides the names.
    """
    ext = F.col("file_format") if "file_format" in listing.columns else extension(F.col("path"))
    files = listing.withColumn("file_format", ext).withColumn("tier", F.when(
        ext.isin(*LISTED_BY_DEFAULT, "jsonl", "ndjson"), "full").otherwise(scan_tier(ext, tiers)))
    fits = F.lit(True) if max_mb is None else within_size(F.col("path"), F.col("size_bytes"), max_mb, max_mb)
    files = files.withColumn("tier", F.when(fits, F.col("tier")).otherwise("too large"))
    n = parts or _parts(spark)
    columns = ("path", "relative_path", "size_bytes", "modified", "file_format", "tier")
    files = cut_lineage(files.select(*columns), "scanned")
    by_range = F.col("file_format").isin(*_DELIMITED, *_JSON) & (F.col("tier") == "full")
    records = files.where((F.col("tier") != "too large") & ~by_range).repartition(n, "path").mapInPandas(_inspect_batches, _RECORD)
    left = files.where("tier = 'too large'").select(*columns, F.lit(None).cast("long").alias("row_count"), *[
        F.lit(None).cast("string").alias(c) for c in ("schema_json", "sample_rows")], F.lit(False).alias("samples_redacted"),
        F.lit(f"larger than {max_mb} MB, not read").alias("error"))
    out = records.unionByName(left)
    ranged = files.where(by_range)
    for formats, facts in ((_DELIMITED, lambda own: delimited_facts(own, chunk or CHUNK_BYTES)),
                           (_JSON, lambda own: json_facts(own, _open, _masked, n, chunk or RANGE_BYTES))):
        own = ranged.where(F.col("file_format").isin(*formats))
        if not own.isEmpty():
            out = out.unionByName(_described(own, facts(own)))
    return out


def _described(files: DataFrame, facts: DataFrame) -> DataFrame:
    """Records of files from the facts of their ranges."""
    said = F.transform(F.coalesce("fields", F.array().cast("array<struct<name:string,flags:int>>")), lambda f: F.struct(
        f["name"].alias("name"), fieldtypes.type_column(f["flags"]).alias("type"), F.lit(True).alias("nullable"),
        fieldtypes.stored_column(f["flags"]).alias("stored")))
    personal = F.exists("fields", lambda f: is_personal_col(f["name"]))
    return files.join(facts, "path").select(
        *files.columns, "row_count", F.to_json(said).alias("schema_json"), "sample_rows",
        F.coalesce(personal, F.lit(False)).alias("samples_redacted"), F.col("problem").alias("error"))


def scan_catalog(spark: SparkSession, root: str, glob: str | None = None,
                 patterns: tuple[str, ...] = DEFAULT_EXCLUDES, **options) -> DataFrame:
    """List a folder, drop what is excluded, and describe every remaining file, of whatever format.

    A folder below the root that cannot be read has a record of its own that says why.
    """
    found = walk_folders(spark, root)
    records = scan_files(spark, scannable(list_files(spark, root, glob or "*", found=found), patterns), **options)
    lost = unreadable(found).select("path", F.lit("folder").alias("tier"), F.lit(False).alias("samples_redacted"), "error")
    return records.unionByName(lost, allowMissingColumns=True)


def dataset_schema(columns: DataFrame, key: list[str]) -> DataFrame:
    """``(key…, name, type)`` of datasets made of several files, from :func:`schema_columns` with stored types.

    Types of the files are widened as those of the values are; a file in which a column is empty has no say.
    """
    flags = fieldtypes.flags_column(F.col("type"), F.col("stored"))
    merged = columns.groupBy(*key, "name").agg(F.bit_and(flags).alias("_flags"))
    return merged.select(*key, "name", fieldtypes.type_column(F.col("_flags")).alias("type"))


def schema_columns(records: DataFrame, key: list[str], stored: bool = False) -> DataFrame:
    """``(key…, name, type, nullable)``, one row per column of the records' schema; if asked, with the ``stored`` type."""
    wire = f"array<struct<name:string,type:string,nullable:boolean{',stored:string' if stored else ''}>>"
    return records.select(*key, F.inline(F.from_json("schema_json", wire)))
