"""Query, audit and notification logs: filters, totals, activity, newest entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnbook.functions.cells import day_key

# Entries kept per log, slack before trimming, proxy bytes per result row.
HISTORY_KEEP = 1000
AUDIT_KEEP = 10_000
NOTIFICATION_KEEP = 500
SKIPPED_KEEP = 10_000
BYTES_PER_ROW = 100


def history_filter(history: DataFrame, status: str = "all", text: str = "") -> DataFrame:
    """Entries by status and text found in path, SQL or error, ignoring case."""
    out = history
    if status in ("success", "error"):
        out = out.where(F.col("status") == status)
    q = text.strip().lower()
    if q:
        out = out.where(F.lower("file_path").contains(q) | F.lower("sql").contains(q)
                        | F.lower(F.coalesce("error", F.lit(""))).contains(q))
    return out


def query_stats(history: DataFrame) -> DataFrame:
    """One row of totals: counts, success share, mean durations, rows returned."""
    ok = F.col("status") == "success"
    total = F.count(F.lit(1))
    timed = ok & (F.col("duration_ms") > 0)
    return history.agg(
        total.alias("total"), F.count_if(ok).alias("success"), F.count_if(~ok).alias("error"),
        F.coalesce(F.floor(F.avg("duration_ms") + 0.5), F.lit(0)).cast("long").alias("avg_ms"),
        F.floor(F.avg(F.when(timed, F.col("duration_ms"))) + 0.5).cast("long").alias("avg_success_ms"),
        F.coalesce(F.sum(F.when(ok, F.col("row_count"))), F.lit(0)).cast("long").alias("total_rows"),
        F.when(total > 0, F.floor(F.count_if(ok) * 100 / total + 0.5)).cast("long").alias("success_percent"))


def top_files(history: DataFrame, n: int = 5) -> DataFrame:
    """Most queried files; ties go by name."""
    return (history.groupBy("file_path").agg(F.count("*").alias("queries"))
            .orderBy(F.desc("queries"), "file_path").limit(n))


def daily_activity(history: DataFrame, as_of: Column, days: int = 7, ts: str = "ts") -> DataFrame:
    """``(day, queries)`` for the last days up to ``as_of``, quiet days included."""
    calendar = history.sparkSession.range(1).select(F.explode(F.sequence(
        F.date_sub(as_of, days - 1), as_of.cast("date"))).alias("d"))
    calendar = calendar.select(F.date_format("d", "yyyy-MM-dd").alias("day"))
    counts = (history.where(F.col(ts).cast("date") >= F.date_sub(as_of, days - 1))
              .groupBy(day_key(F.col(ts)).alias("day")).agg(F.count("*").alias("n")))
    return calendar.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("queries"))


def running_counters(history: DataFrame, as_of: Column, ts: str = "ts") -> DataFrame:
    """Totals, today's count as of a day, outcome counts, proxy bytes read, last query."""
    ok = F.col("status") == "success"
    return history.agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.count_if(F.col(ts).cast("date") == as_of.cast("date")).alias("queries_today"),
        F.count_if(ok).alias("successful_queries"), F.count_if(~ok).alias("failed_queries"),
        F.coalesce(F.sum(F.when(ok, F.col("row_count") * BYTES_PER_ROW)), F.lit(0)).cast("long").alias("total_bytes_read"),
        F.max(ts).alias("last_query_at"))


def visible_audit(audit: DataFrame, hidden: str = "byok_call") -> DataFrame:
    """Audit entries without the hidden kind; old entries have no kind and count as syncs."""
    return audit.where(F.coalesce("kind", F.lit("sync")) != hidden)


def audit_totals(audit: DataFrame) -> DataFrame:
    return visible_audit(audit).agg(
        F.count(F.lit(1)).alias("syncs"), F.sum("dataset_count").alias("datasets"),
        F.sum("column_count").alias("columns"), F.sum("total_bytes").alias("bytes"),
        F.count_if(F.col("status") == "error").alias("errors"))


def counts_by_reason(skipped: DataFrame, reason: str = "reason") -> DataFrame:
    """Entries per reason, with the total under ``all``."""
    return (skipped.rollup(reason).agg(F.count("*").alias("entries"), F.grouping(reason).alias("_g"))
            .select(F.when(F.col("_g") == 1, "all").otherwise(F.col(reason)).alias("reason"), "entries"))


def newest_per_key(log: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Newest entry of every key, as a mergeable aggregate.

    Each task keeps one candidate per key, so a key holding most of the log sends one
    row per task.
    """
    rest = [c for c in log.columns if c not in key]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return log.groupBy(*key).agg(best.alias("_b")).select(*key, *[F.col(f"_b.`{c}`").alias(c) for c in rest])


def newest(log: DataFrame, order: list[str], n: int) -> DataFrame:
    """Newest ``n`` entries, newest first."""
    return log.orderBy(*[F.desc(c) for c in order]).limit(n)


def load_log(lines: DataFrame, schema: str, order: list[str], n: int, body: str = "value") -> DataFrame:
    """Newest entries of a log of JSON lines; lines that do not parse are skipped."""
    first = order[0]
    parsed = lines.select(F.from_json(F.col(body), schema, {"mode": "PERMISSIVE"}).alias("e")).select("e.*")
    return newest(parsed.where(F.col(first).isNotNull()), order, n)


def retain(log: DataFrame, order: list[str], keep: int) -> DataFrame:
    """Newest ``keep`` entries."""
    return newest(log, order, keep)


def dataset_totals(datasets: DataFrame, is_document: Column) -> DataFrame:
    """Datasets, tables, documents, columns and bytes of a catalog."""
    return datasets.agg(
        F.count(F.lit(1)).alias("datasets"), F.count_if(~is_document).alias("tabular"),
        F.count_if(is_document).alias("documents"), F.sum("columns").alias("columns"),
        F.sum("size_bytes").alias("bytes"))


def source_totals(sources: DataFrame, cls: str = "class") -> DataFrame:
    """Datasets, columns and bytes per class of source, and for ``all``; missing stats are zero."""
    def total(c):
        return F.sum(F.coalesce(F.col(c), F.lit(0)))

    return (sources.rollup(cls).agg(
        F.count("*").alias("sources"), total("datasets").alias("datasets"), total("columns").alias("columns"),
        total("total_bytes").alias("bytes"), F.grouping(cls).alias("_g"))
        .select(F.when(F.col("_g") == 1, "all").otherwise(F.col(cls)).alias(cls), "sources", "datasets",
                "columns", "bytes"))


def scan_stats(scans: DataFrame, source: str = "source_id") -> DataFrame:
    """What the latest scan of every source found."""
    return scans.groupBy(source).agg(
        F.count("*").alias("datasets"), F.sum("columns").alias("columns"), F.sum("size_bytes").alias("total_bytes"),
        F.max("scanned_at").alias("last_scan_at"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def merge_scan_stats(old: DataFrame, new: DataFrame, source: str = "source_id") -> DataFrame:
    """Stored stats updated by a scan; where it brought only a time, the figures stay."""
    figures = [c for c in old.columns if c != source]
    n = new.select(source, *[F.col(c).alias(f"_n_{c}") for c in figures])
    return old.join(n, source, "full").select(
        source, *[F.coalesce(f"_n_{c}", c).alias(c) for c in figures])


def needs_attention(sources: DataFrame, as_of: Column, in_flight: str = "scanning", errors: str = "errors",
                    scanned: str = "last_scan_at") -> DataFrame:
    """Sources not being scanned that had errors, were never scanned, or a day ago."""
    old = F.col(scanned).isNull() | (F.col(scanned) < as_of - F.expr("INTERVAL 24 HOURS"))
    return sources.where(~F.col(in_flight) & ((F.coalesce(errors, F.lit(0)) > 0) | old))


def catch_up(roots: DataFrame, workspace: str) -> DataFrame:
    """Scanned roots with data whose last publish went elsewhere or never happened."""
    return roots.where((F.col("datasets") > 0) & ~F.col("published_to").eqNullSafe(F.lit(workspace)))


def unread(notifications: DataFrame) -> DataFrame:
    return notifications.agg(F.count_if(~F.col("read")).alias("unread"), F.count(F.lit(1)).alias("total"))


def mark_read(notifications: DataFrame, ids: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Mark all notifications read, or those whose id is listed."""
    if ids is None:
        return notifications.withColumn("read", F.lit(True))
    hit = ids.select(key).distinct().withColumn("_hit", F.lit(True))
    return (notifications.join(hit, key, "left")
            .withColumn("read", F.col("read") | F.coalesce("_hit", F.lit(False))).drop("_hit"))


def folder_view(listing: DataFrame, as_of: Column, text: str = "", classes: list[str] | None = None,
                max_age_days: float | None = None, sort: str = "name", modified: str = "last_modified") -> DataFrame:
    """Files of a folder filtered by name, format class and age, in one of three orders.

    ``modified`` is text; when age matters, a date that cannot be read leaves the file out.
    """
    q = text.strip().lower()
    out = listing.where(F.lower("relative_path").contains(q)) if q else listing
    if classes:
        out = out.where(F.col("format_class").isin(*classes))
    stamp = F.try_to_timestamp(F.col(modified))
    if max_age_days is not None:
        out = out.where(stamp >= as_of - F.make_dt_interval(secs=F.lit(float(max_age_days) * 86400)))
    order = {"modified-desc": [stamp.desc_nulls_last(), F.asc("relative_path")],
             "size-desc": [F.desc("size_bytes"), F.asc("relative_path")],
             "name": [F.asc("relative_path")]}[sort]
    return out.orderBy(*order)
