"""Gap-based sessions that stay spread out when one key holds most of the events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def event_cells(events: DataFrame, key: list[str], ts_micros: str, gap: int) -> DataFrame:
    """``key…, _start, _end, _n``: events of a key counted in cells of time as wide as the gap.

    Two events in one cell are never further apart than the gap, so a cell lies in one session.  The cells are a plain
    aggregate: counted inside every task first, so a key sends one row per cell and task, however many events it has.
    """
    ts = F.col(ts_micros)
    cell = (ts - F.pmod(ts, F.lit(max(gap, 1)))).alias("_cell")
    return (events.groupBy(*key, cell).agg(F.min(ts).alias("_start"), F.max(ts).alias("_end"), F.count(F.lit(1)).alias("_n"))
            .where("_start IS NOT NULL").drop("_cell"))


def gap_sessions(events: DataFrame, key: list[str], ts_micros: str, gap_seconds: int,
                 bucket_seconds: int = 3600) -> DataFrame:
    """``(key…, session_start, session_end, events)`` in microseconds.

    A session goes on while the next event comes at most ``gap_seconds`` later; events without a time are in none.
    Events are first counted in cells (:func:`event_cells`), so a key in one hour is a few rows, whatever its share of
    the events.  Cells are grouped into local sessions per key and time bucket, so a key over a long time is sorted
    in many tasks.  Only the first and last local session of a bucket can continue in another one; these meet per key,
    at most two per bucket, so their number is limited by the time covered.  All others are already whole.
    """
    gap = gap_seconds * 1_000_000
    place = [*key, "_bucket"]
    rows = event_cells(events, key, ts_micros, gap).withColumn("_bucket", F.floor(F.col("_start") / (bucket_seconds * 1_000_000)))

    local = (_numbered(rows, place, "_start", "_end", gap)
             .groupBy(*place, "_no")
             .agg(F.min("_start").alias("_start"), F.max("_end").alias("_end"), F.sum("_n").alias("_n")))
    last = F.max("_no").over(Window.partitionBy(*place))
    border = (F.col("_no") == 0) | (F.col("_no") == last)
    routed = local.withColumn("_route", F.when(border, F.lit(-1).cast("long")).otherwise(F.col("_bucket")))

    return (_numbered(routed.drop("_no"), [*key, "_route"], "_start", "_end", gap)
            .groupBy(*key, "_route", "_no")
            .agg(F.min("_start").alias("session_start"), F.max("_end").alias("session_end"),
                 F.sum("_n").alias("events"))
            .drop("_route", "_no"))


def _numbered(rows: DataFrame, group: list[str], start: str, end: str, gap: int) -> DataFrame:
    """Rows with ``_no``, counting up from 0 at every gap inside a group."""
    by_time = Window.partitionBy(*group).orderBy(start)
    opens = F.coalesce((F.col(start) - F.lag(end).over(by_time) > gap).cast("int"), F.lit(0))
    running = by_time.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_opens", opens).withColumn("_no", F.sum("_opens").over(running))
