"""Streaming jobs: watching files, quiet periods, alerts, counters, rescans, phased records.

Event time drives every window.  Late data waits for ten minutes by default.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from cairnbook.operators import drift, incremental, keyed, leases, logs, paths, sinks
from cairnbook.session import cut_lineage
from cairnbook.sources import catalog, listing
from cairnbook.streaming import changes

LATENESS = "10 minutes"

# Seconds of quiet before a folder is processed, and of duplicate suppression.
QUIET_SECONDS = 2
DUPLICATE_SECONDS = 60

# Groups of keys that share a state of :func:`alert_states`; a checkpoint goes with the number it began with.
ALERT_GROUPS = 2048


def run_available(df: DataFrame, out: str, checkpoint: str) -> None:
    """Process what is there now, append it to Parquet, and stop."""
    (df.writeStream.format("parquet").outputMode("append").option("path", out)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def run_batches(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str,
                mode: str = "append") -> None:
    """Process what is there now, handing every micro-batch to ``each``."""
    (df.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def write_batch(df: DataFrame, out: str, batch_id: int) -> None:
    """Write a micro-batch under its own number; a replay overwrites the same files."""
    df.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")


# --- watching files ---------------------------------------------------------------------

_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch_files(spark: SparkSession, root: str, patterns: tuple[str, ...] = listing.DEFAULT_EXCLUDES,
                **options: str) -> DataFrame:
    """Stream of new data files below a folder, as a listing; contents are not read."""
    files = (spark.readStream.format("binaryFile").schema(_FILE_SCHEMA)
             .option("recursiveFileLookup", "true").options(**options).load(root))
    base = root.rstrip("/") + "/"
    found = files.select(
        "path", F.substring_index("path", base, -1).alias("relative_path"),
        F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    return listing.scannable(found, patterns)


def catalog_of_changes(spark: SparkSession, root: str, base: str, state: str, published: bool = False,
                       patterns: tuple[str, ...] = listing.DEFAULT_EXCLUDES, wait: float = 0.0,
                       lease_seconds: float = leases.LEASE_SECONDS) -> None:
    """Bring the catalog of a folder up to date with what was created, changed and removed since the last run.

    ``base`` is a table by path.  New and changed files are described again and replace their records; records of
    removed files go.  ``state`` keeps the manifests and the checkpoint of this one stream; a batch that is run again
    after a restart is known to the table and changes nothing.  One job at a time works on a folder: another waits so
    many seconds for its lease and then leaves with :class:`LeaseTaken`; a job that has lost its lease cannot commit.
    """
    stream = hashlib.sha256(f"{root}|{state}".encode()).hexdigest()[:16]

    def merge(stored: DataFrame, rows: DataFrame) -> DataFrame:
        kept = stored.join(rows.select("path"), "path", "left_anti")
        return kept.unionByName(rows.where("change <> 'removed'").select(*stored.columns))

    with leases.held(spark, f"{state}/lease", lease_seconds, wait) as lease:
        def each(batch: DataFrame, batch_id: int) -> None:
            told = cut_lineage(batch, "folder_changes")
            records = catalog.scan_files(batch.sparkSession, told.where("change <> 'removed'").drop("change"))
            rows = told.select("path", "change").join(records, "path", "left")
            lease.check()
            keyed.change(rows, base, ["path"], merge, schema=records.schema, batch=(stream, batch_id), lease=lease)

        run_batches(changes.watch_changes(spark, root, f"{state}/manifests", patterns, published), each, f"{state}/checkpoint")


@dataclass(frozen=True)
class Refreshed:
    """A catalog after a refresh, and what the refresh found."""

    records: DataFrame
    drift: DataFrame
    totals: DataFrame
    stats: DataFrame
    published: DataFrame


def refresh(spark: SparkSession, root: str, base: str, state: str, public_root: str | None = None,
            patterns: tuple[str, ...] = listing.DEFAULT_EXCLUDES, wait: float = 0.0) -> Refreshed:
    """The whole refresh of a folder: list, compare, describe what changed, find drift, store, count, publish.

    The folder is listed by a Spark job (:func:`changes.publish`); only new and changed files are opened; drift is looked
    for in the partitions of the catalog that have changed; the published view carries paths below ``public_root``.
    """
    before = keyed.version(spark, base)
    changes.publish(spark, root, f"{state}/manifests")
    catalog_of_changes(spark, root, base, state, True, patterns, wait)
    now = keyed.version(spark, base)
    if now is None:
        raise FileNotFoundError(f"nothing below {root} to describe")
    old, new = keyed.rows_changed(spark, base, before.number if before else 0, now.number)
    records = keyed.read(spark, base, now.number)
    counted = records.withColumn("columns", F.coalesce(F.size(F.from_json("schema_json", "array<struct<name:string>>")), F.lit(0)).cast("long"))
    counted = counted.withColumn("source_id", F.lit(root)).withColumn("scanned_at", F.col("modified"))
    is_document = listing.format_class(F.col("file_format")) == "document"
    return Refreshed(records, drift.catalog_drift(old, new, ["path"]), logs.dataset_totals(counted, is_document),
                     logs.scan_stats(counted), sinks.publish_view(records.withColumn("document_text", F.lit(None).cast("string")), public_root))


def catalog_stream(spark: SparkSession, root: str, out: str, checkpoint: str, **options: str) -> None:
    """Describe new files as they appear, one catalog batch per micro-batch."""
    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(catalog.scan_files(batch.sparkSession, batch), out, batch_id)

    run_batches(watch_files(spark, root, **options), each, checkpoint)


# --- quiet periods and duplicate alerts ---------------------------------------------------

def root_of(path: Column, roots: list[str]) -> Column:
    """First configured root a path starts with; the list is a configuration, hence short."""
    return F.coalesce(*[F.when(path.startswith(r), F.lit(r)) for r in roots])


def debounce(changes: DataFrame, folder: str, ts: str, quiet_seconds: int = QUIET_SECONDS,
             lateness: str = LATENESS) -> DataFrame:
    """``(folder, first_change, last_change, changes)`` once a folder has been quiet.

    A row appears when no further change can fall into the period, so each folder is
    processed once per burst.  Partial sessions are merged before the shuffle, which keeps
    a busy folder from sending every event.
    """
    changes.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    quiet = F.expr(f"INTERVAL {quiet_seconds} SECONDS")
    burst = (changes.withWatermark(ts, lateness)
             .groupBy(F.col(folder), F.session_window(F.col(ts), f"{quiet_seconds} seconds").alias("w"))
             .agg(F.count("*").alias("changes")))
    return burst.select(folder, F.col("w.start").alias("first_change"),
                        (F.col("w.end") - quiet).alias("last_change"), "changes")


def suppress_duplicates(alerts: DataFrame, key: list[str], ts: str, seconds: int = DUPLICATE_SECONDS,
                        lateness: str = LATENESS) -> DataFrame:
    """One row per burst of equal alerts; a repeat within the window extends it."""
    alerts.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    gap = F.expr(f"INTERVAL {seconds} SECONDS")
    return (alerts.withWatermark(ts, lateness)
            .groupBy(*key, F.session_window(F.col(ts), f"{seconds} seconds").alias("w"))
            .agg(F.count("*").alias("repeats"))
            .select(*key, F.col("w.start").alias("first_seen"), (F.col("w.end") - gap).alias("last_seen"), "repeats"))


def open_bursts(spark: SparkSession, checkpoint: str, key: list[str], seconds: int, names: tuple[str, str, str]) -> DataFrame:
    """Bursts still open when a run of :func:`debounce` or :func:`suppress_duplicates` has stopped, read from its state.

    Emitted bursts have left the state, so both together are all bursts; ``names`` are those of the emitted
    first, last and count columns.
    """
    state = spark.read.format("statestore").load(checkpoint).select("value.*")
    gap = F.expr(f"INTERVAL {seconds} SECONDS")
    return state.select(*key, F.col("session_window.start").alias(names[0]), (F.col("session_window.end") - gap).alias(names[1]),
                        F.col("count").alias(names[2]))


def _merge_runs(ts: str, seconds: int, key: list[str]):
    """Collapse an Arrow batch to runs of equal alerts, so a hot key shuffles few rows."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.sort_values([*key, ts], kind="stable")
            new = (batch[key] != batch[key].shift()).any(axis=1)
            gap = batch[ts].diff() > pd.Timedelta(seconds=seconds)
            run_no = (new | gap).cumsum()
            yield batch.groupby(run_no, sort=False).agg(
                **{k: (k, "first") for k in key}, first_seen=(ts, "min"), last_seen=(ts, "max"),
                repeats=(ts, "size")).reset_index(drop=True)

    return run


def _join_alerts(keys: np.ndarray, first: np.ndarray, last: np.ndarray, repeats: np.ndarray, old: int, reach: int) -> tuple[np.ndarray, ...]:
    """Alerts that rows of many keys make, found in one sweep over all keys in order of time.

    Rows of a key within ``reach`` of each other, directly or through others, are one alert.  The first ``old`` rows are
    alerts known before, the others are in the order of arrival.  Gives for each alert its eldest row, its first and last
    time, its repeats and whether it has changed, by key and eldest row; then the known rows that were swallowed by others.
    """
    order = np.lexsort((first, keys))
    # How far the rows of a key have come so far: the running maximum of the ranks of their ends, which starts anew with each key.
    ends, rank = np.unique(last, return_inverse=True)
    base = keys[order] * len(ends)
    far = ends[np.maximum.accumulate(base + rank[order]) - base]
    opens = np.ones(len(order), bool)
    opens[1:] = (np.diff(keys[order]) != 0) | (first[order][1:] - reach > far[:-1])
    starts = np.flatnonzero(opens)
    eldest, fresh = np.minimum.reduceat(order, starts), np.maximum.reduceat(order, starts) >= old
    alert = np.cumsum(opens) - 1
    gone = order[(order < old) & (order != eldest[alert]) & fresh[alert]]
    by = np.lexsort((eldest, keys[eldest]))
    return (eldest[by], first[order[starts]][by], np.maximum.reduceat(last[order], starts)[by],
            np.add.reduceat(repeats[order], starts)[by], fresh[by], gone)


def _joined_alerts(rows: list[tuple], old: int, reach: int) -> tuple[list[list], list[list]]:
    """:func:`_join_alerts` for rows ``(born, first, last, repeats, number)`` of one key, those numbered below ``old`` known.

    Gives the alerts by birth and those that have changed, among them the swallowed ones with 0 repeats.
    """
    if not rows:
        return [], []
    born, first, last, repeats, number = np.array(sorted(rows, key=lambda r: r[4]), dtype="int64").T
    eldest, starts, ends, counts, fresh, gone = _join_alerts(np.zeros(len(rows), "int64"), first, last, repeats, int((number < old).sum()), reach)
    made = np.stack([born[eldest], starts, ends, counts], axis=1)
    lost = np.stack([born[gone], first[gone], last[gone], np.zeros(len(gone), "int64")], axis=1)
    return made.tolist(), [*made[fresh].tolist(), *lost.tolist()]


def _codes(columns: list[pd.Series]) -> np.ndarray:
    """A number for every row, equal for equal values in all columns; missing values are equal."""
    codes = np.zeros(len(columns[0]), "int64")
    for column in columns:
        one, values = pd.factorize(column)
        codes = pd.factorize(codes * (len(values) + 1) + one + 1)[0]
    return codes


def _packed(key: list[pd.Series], born: np.ndarray, first: np.ndarray, last: np.ndarray, repeats: np.ndarray) -> bytes:
    """Open alerts for the state; birth and end are kept as differences, which are small and compress well."""
    rows = pa.table([*[pa.array(k, from_pandas=True) for k in key], *map(pa.array, (born - first, first, last - first, repeats))],
                    names=list(map(str, range(len(key) + 4))))
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(rows)
    return out.getvalue().to_pybytes()


def _unpacked(state: bytes) -> tuple[list[pd.Series], list[np.ndarray]]:
    columns = pa.ipc.open_stream(state).read_all().columns
    born, first, last, repeats = (c.to_numpy() for c in columns[-4:])
    return [c.to_pandas() for c in columns[:-4]], [born + first, first, last + first, repeats]


def alert_states(alerts: DataFrame, key: list[str], ts: str, seconds: int = DUPLICATE_SECONDS,
                 lateness: str = LATENESS) -> DataFrame:
    """Alerts as they change, with an id that stays while repeats extend the window.

    Emits ``(key…, alert_id, first_seen, last_seen, repeats)`` in update mode: the first row of an id is the new
    alert, later ones refresh it.  State per key holds all alerts that late events may still reach, so an event
    belongs to the alert within the window of it on either side, and the id, made from the first event seen, never
    changes.  An event that closes the gap between two alerts makes them one: the older id goes on, the other is
    emitted once more with 0 repeats, which withdraws it.  Alerts leave the state when event time has passed them.

    Keys are dealt by their hash to ``ALERT_GROUPS`` groups with one state each, and the alerts of all keys of a group
    are joined at once; a call of Python for each key would take milliseconds, twice.
    """
    kinds = [alerts.schema[k].dataType for k in key]
    # Whole numbers travel as text: pandas makes them floats where some are missing.
    texts = ["string" if isinstance(kind, T.IntegralType) else kind for kind in kinds]
    plain = [f"key_{i}" for i in range(len(key))]
    slim = alerts.select(*[F.col(k).cast(text).alias(p) for k, text, p in zip(key, texts, plain)], F.col(ts).cast("timestamp").alias("at"))
    # What an id has in place of a key that is missing.
    blanks = ["nan" if isinstance(kind, (T.IntegralType, T.FractionalType)) and not isinstance(kind, T.DecimalType)
              else "NaT" if isinstance(kind, (T.TimestampType, T.TimestampNTZType)) else "None" for kind in kinds]
    fields = [slim.schema[p] for p in plain]
    seen = [T.StructField("first_seen", T.TimestampType()), T.StructField("last_seen", T.TimestampType()), T.StructField("repeats", T.LongType())]
    reach = seconds * 1_000_000

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # Open alerts of the keys of a group, those of a key by birth; times are in microseconds.
        parts = [_unpacked(state.get[0])] if state.exists else []
        old = sum(len(times[0]) for _, times in parts)
        if not state.hasTimedOut:
            for runs in batches:
                first, last = (runs[c].to_numpy("datetime64[ns]").astype("int64") // 1000 for c in ("first_seen", "last_seen"))
                parts.append(([runs[p] for p in plain], [first, first, last, runs["repeats"].to_numpy("int64")]))
        names = [pd.concat(p, ignore_index=True) if len(parts) > 1 else p[0].reset_index(drop=True) for p in zip(*[p for p, _ in parts])]
        born, first, last, repeats = (np.concatenate(c) for c in zip(*[c for _, c in parts]))
        keys = _codes(names)
        eldest, starts, ends, counts, fresh, gone = _join_alerts(keys, first, last, repeats, old, reach)
        # A key is looked through if it has new rows, or if event time has passed the first end of its alerts.
        now, until, of = state.getCurrentWatermarkMs(), ends // 1000 + seconds * 1000, keys[eldest]
        idle, least = np.ones(len(keys), bool), np.full(len(keys), np.iinfo("int64").max)
        idle[keys[old:]] = False
        np.minimum.at(least, of, until)
        kept = (until > now) | (idle & (least >= now))[of]
        if kept.any():
            left = eldest[kept]
            state.update((_packed([k.take(left) for k in names], born[left], starts[kept], ends[kept], counts[kept]),))
            state.setTimeoutTimestamp(int(until[kept].min()))
        elif state.exists:
            state.remove()
        if fresh.any():
            rows = np.concatenate([eldest[fresh], gone])
            told = [k.take(rows).reset_index(drop=True) for k in names]
            words = [k.map(str).where(k.notna(), blank) for k, blank in zip(told, blanks)]
            yield pd.DataFrame({
                **dict(zip(plain, told)), "alert_id": ["-".join(w) for w in zip(*words, map(str, born[rows].tolist()))],
                "first_seen": np.concatenate([starts[fresh], first[gone]]).astype("datetime64[us]"),
                "last_seen": np.concatenate([ends[fresh], last[gone]]).astype("datetime64[us]"),
                "repeats": np.concatenate([counts[fresh], np.zeros(len(gone), "int64")])})

    runs = slim.mapInPandas(_merge_runs("at", seconds, plain), T.StructType([*fields, *seen])).withWatermark("last_seen", lateness)
    states = runs.withColumn("alert_group", F.pmod(F.hash(*plain), F.lit(ALERT_GROUPS))).groupBy("alert_group").applyInPandasWithState(
        step, T.StructType([*fields, T.StructField("alert_id", T.StringType()), *seen]), "open binary", "update", GroupStateTimeout.EventTimeTimeout)
    return states.select(*[F.col(p).cast(kind).alias(k) for p, kind, k in zip(plain, kinds, key)], "alert_id", "first_seen", "last_seen", "repeats")


def current_alerts(states: DataFrame, key: list[str], batch: str = "batch_id", read: DataFrame | None = None) -> DataFrame:
    """The last row of every alert that was not withdrawn; ids listed in ``read`` stay read when they are refreshed."""
    last = states.groupBy(*key, "alert_id").agg(F.max_by(F.struct("first_seen", "last_seen", "repeats"), batch).alias("now"))
    last = last.select(*key, "alert_id", "now.*").where("repeats > 0")
    if read is None:
        return last.withColumn("read", F.lit(False))
    seen = read.select("alert_id").distinct().withColumn("read", F.lit(True))
    return last.join(seen, "alert_id", "left").withColumn("read", F.coalesce("read", F.lit(False)))


def drop_redelivered(alerts: DataFrame, key: list[str], ts: str, lateness: str = LATENESS) -> DataFrame:
    """Alerts without repeats of an id delivered again within the lateness."""
    return alerts.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(key)


# --- counters ---------------------------------------------------------------------------

def daily_counters(log: DataFrame, ts: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """Running ``(day, status, queries, rows)``, updated as entries arrive."""
    return (log.withWatermark(ts, lateness).groupBy(F.window(ts, "1 day").alias("w"), "status")
            .agg(F.count("*").alias("queries"), F.sum("row_count").alias("rows"))
            .select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "status", "queries", "rows"))


def upsert_stream(df: DataFrame, base: str, key: list[str], checkpoint: str, mode: str = "update",
                  rank: str | None = None) -> None:
    """Keep a table in hash partitions (:mod:`cairnbook.operators.keyed`) current from a stream of changed rows.

    Rows of a batch replace stored rows with the same key; only the partitions of these keys are written.  With
    ``rank`` a row is only replaced by one of at least the same rank, as when shallow records are filled in later.
    The table remembers the last batch of the stream, so a replayed batch commits nothing.
    """
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def each(batch: DataFrame, batch_id: int) -> None:
        keyed.upsert(batch, base, key, rank=rank, batch=(stream, batch_id))

    run_batches(df, each, checkpoint, mode)


# --- rescans ------------------------------------------------------------------------------

def rescan(spark: SparkSession, root: str, state: str, glob: str | None = None) -> int:
    """Bring the catalog of a folder up to date; returns how many files were read.

    The fingerprint covers exactly the files listed.  If it is unchanged, the run ends after the listing; otherwise
    the manifest difference picks the files to read, and records of removed files are dropped.  Every root keeps
    its own part of ``state`` (:func:`rescan_state`), so several roots can share it.
    """
    state = rescan_state(state, root)
    walked = listing.walk_folders(spark, root)
    found = cut_lineage(listing.scannable(listing.list_files(spark, root, glob or "*", found=walked)).withColumn(
        "mtime", F.unix_micros("modified")).withColumn("mtime_marker", F.col("mtime").cast("string")), "found")
    marked = found.withColumn("folder", F.lit(root))
    print_now = listing.folder_fingerprint(marked, ["folder"], every=True).select("folder", "fingerprint")
    before = sinks.read_snapshot(spark, f"{state}/fingerprint")
    now = print_now.first() or (root, "")
    if before is not None:
        last = before.first()
        if last is not None and last["fingerprint"] == now[1]:
            return 0
    stored = sinks.read_snapshot(spark, f"{state}/catalog")
    current = found.select("path", "relative_path", "size_bytes", "modified", "mtime_marker")
    if stored is None:
        records = catalog.scan_files(spark, current).join(current.select("path", "mtime_marker"), "path")
        sinks.commit_snapshot(records, f"{state}/catalog")
        changed = sinks.read_snapshot(spark, f"{state}/catalog").count()
    else:
        diff = incremental.manifest_diff(stored, current, "path")
        stale = current.join(diff.where("change IN ('new', 'changed')").select("path"), "path", "left_semi")
        records = cut_lineage(catalog.scan_files(spark, stale).join(stale.select("path", "mtime_marker"), "path"), "rescan")
        # Of what lies in a folder that cannot be read nothing is known; its records stay.
        lost = listing.unreadable(walked).select(F.col("path").alias("root"))
        unseen = paths.allowed(diff.where("change = 'removed'").select("path"), lost)
        kept = stored.join(diff.where("change = 'unchanged'").select("path").unionByName(unseen), "path", "left_semi")
        sinks.commit_snapshot(kept.select(*records.columns).unionByName(records), f"{state}/catalog")
        changed = records.count()
    sinks.commit_snapshot(spark.createDataFrame([tuple(now)], print_now.schema), f"{state}/fingerprint")
    return changed


def rescan_state(state: str, root: str) -> str:
    """Where the state of one root lies."""
    return f"{state}/{hashlib.sha256(root.rstrip('/').encode()).hexdigest()[:16]}"
