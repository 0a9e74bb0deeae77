"""Log queries: filters, totals, activity, newest entries, sessions, renumbering (A5-A12, A18, A20, PF8-PF18, SK6, W1-W3, T6-T9)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from cairnbook.operators import logs, numbering, search, sessions
from cairnbook.plans.registry import query

# The query log stands in the events table: who asked is the file, errors are failures.
HISTORY_SQL = """(SELECT event_id, ts, 'file_' || user_id AS file_path,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status,
  'SELECT ' || event_type || ' WHERE p = ' || props AS sql, CASE WHEN event_type = 'error' THEN 'Code ' || props END AS error,
  CAST(floor(value * 10) AS BIGINT) AS duration_ms, CAST(floor(value) AS BIGINT) AS row_count FROM events)"""


def history(t):
    bad = F.col("event_type") == "error"
    return t.events.select(
        "event_id", "ts", F.concat(F.lit("file_"), "user_id").alias("file_path"),
        F.when(bad, "error").otherwise("success").alias("status"),
        F.concat(F.lit("SELECT "), "event_type", F.lit(" WHERE p = "), "props").alias("sql"),
        F.when(bad, F.concat(F.lit("Code "), "props")).alias("error"),
        F.floor(F.col("value") * 10).cast("long").alias("duration_ms"),
        F.floor("value").cast("long").alias("row_count"))


AS_OF = "2024-01-30"


def _as_of():
    return F.lit(AS_OF).cast("date")


@query("pf10_history_filter", sql=f"""
SELECT event_id, status FROM {HISTORY_SQL} WHERE status = 'error' AND (contains(lower(file_path), 'code {{"k": 4')
 OR contains(lower(sql), 'code {{"k": 4') OR contains(lower(coalesce(error, '')), 'code {{"k": 4'))""")
def _pf10(t):
    return logs.history_filter(history(t), "error", ' CODE {"k": 4').select("event_id", "status")


@query("a7_query_stats", sql=f"""
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'success') AS success,
 count(*) FILTER (WHERE status <> 'success') AS error, CAST(floor(avg(duration_ms) + 0.5) AS BIGINT) AS avg_ms,
 CAST(floor(avg(duration_ms) FILTER (WHERE status = 'success' AND duration_ms > 0) + 0.5) AS BIGINT) AS avg_success_ms,
 CAST(sum(row_count) FILTER (WHERE status = 'success') AS BIGINT) AS total_rows,
 CAST(floor(count(*) FILTER (WHERE status = 'success') * 100.0 / count(*) + 0.5) AS BIGINT) AS success_percent
FROM {HISTORY_SQL}""")
def _a7(t):
    return logs.query_stats(history(t))


@query("a7_top_files", sql=f"""
SELECT file_path, count(*) AS queries FROM {HISTORY_SQL} GROUP BY 1 ORDER BY queries DESC, file_path LIMIT 5""")
def _a7t(t):
    return logs.top_files(history(t))


@query("a8_daily_activity", sql=f"""
SELECT strftime(d, '%Y-%m-%d') AS day, count(event_id) AS queries
FROM (SELECT unnest(generate_series(DATE '2024-02-02' - 6, DATE '2024-02-02', INTERVAL 1 DAY)) AS d)
LEFT JOIN {HISTORY_SQL} ON CAST(ts AS DATE) = CAST(d AS DATE) GROUP BY 1""")
def _a8(t):
    """The last seven days as of two days after the log ends, so some are empty."""
    return logs.daily_activity(history(t), F.lit("2024-02-02").cast("date"))


@query("a9_running_counters", sql=f"""
SELECT count(*) AS total_queries, count(*) FILTER (WHERE CAST(ts AS DATE) = DATE '{AS_OF}') AS queries_today,
 count(*) FILTER (WHERE status = 'success') AS successful_queries, count(*) FILTER (WHERE status = 'error') AS failed_queries,
 CAST(sum(row_count * 100) FILTER (WHERE status = 'success') AS BIGINT) AS total_bytes_read,
 strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_query_at FROM {HISTORY_SQL}""")
def _a9(t):
    return logs.running_counters(history(t), _as_of()).withColumn(
        "last_query_at", F.date_format("last_query_at", "yyyy-MM-dd HH:mm:ss"))


AUDIT_SQL = """(SELECT event_id, ts, 'dir_' || user_id AS folder,
  CASE event_type WHEN 'click' THEN NULL WHEN 'view' THEN 'byok_call' ELSE 'sync' END AS kind,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status, user_id AS dataset_count,
  CAST(json_extract(props, '$.k') AS BIGINT) AS column_count, CAST(floor(value * 100) AS BIGINT) AS total_bytes FROM events)"""


def audit(t):
    e = F.col("event_type")
    return t.events.select(
        "event_id", "ts", F.concat(F.lit("dir_"), "user_id").alias("folder"),
        F.when(e == "click", F.lit(None).cast("string")).when(e == "view", "byok_call").otherwise("sync").alias("kind"),
        F.when(e == "error", "error").otherwise("ok").alias("status"), F.col("user_id").alias("dataset_count"),
        F.get_json_object("props", "$.k").cast("long").alias("column_count"),
        F.floor(F.col("value") * 100).cast("long").alias("total_bytes"))


@query("pf14_visible_kinds", sql=f"SELECT event_id, kind FROM {AUDIT_SQL} WHERE coalesce(kind, 'sync') <> 'byok_call'")
def _pf14(t):
    return logs.visible_audit(audit(t)).select("event_id", "kind")


@query("a10_audit_totals", sql=f"""
SELECT count(*) AS syncs, CAST(sum(dataset_count) AS BIGINT) AS datasets, CAST(sum(column_count) AS BIGINT) AS columns,
 CAST(sum(total_bytes) AS BIGINT) AS bytes, count(*) FILTER (WHERE status = 'error') AS errors
FROM {AUDIT_SQL} WHERE coalesce(kind, 'sync') <> 'byok_call'""")
def _a10(t):
    return logs.audit_totals(audit(t))


@query("a11_counts_by_reason", sql="""
SELECT coalesce(event_type, 'all') AS reason, count(*) AS entries FROM events GROUP BY ROLLUP (event_type)""")
def _a11(t):
    return logs.counts_by_reason(t.events, "event_type")


@query("a12_latest_per_folder", sql=f"""
SELECT folder, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, status, total_bytes FROM {AUDIT_SQL}
QUALIFY row_number() OVER (PARTITION BY folder ORDER BY ts DESC, event_id DESC) = 1""")
def _a12(t):
    best = logs.newest_per_key(audit(t), ["folder"], ["ts", "event_id"])
    return best.select("folder", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"), "status",
                       "total_bytes").orderBy(F.desc("at"), "folder")


@query("w1_newest_per_key", sql="""
SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY row_number() OVER
 (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC) = 1""")
def _w1(t):
    """The window form; its rank filter is also applied before the shuffle."""
    w = Window.partitionBy("l_partkey").orderBy(
        F.desc("l_shipdate"), F.desc("l_orderkey"), F.desc("l_linenumber"), F.desc("l_quantity"))
    return (t.lineitem.withColumn("rn", F.row_number().over(w)).where("rn = 1")
            .select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity"))


@query("w2_renumber", sql="""
SELECT c_custkey AS id, CAST(row_number() OVER (ORDER BY pos NULLS LAST, c_acctbal, c_custkey) - 1 AS BIGINT) AS sort_order
FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS pos FROM orders WHERE o_orderstatus = 'F'
  GROUP BY 1) ON o_custkey = c_custkey""")
def _w2(t):
    items = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("sort_order"))
    listed = (t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("id"))
              .agg(F.max("o_totalprice").alias("position")).join(items.select("id"), "id", "left_semi"))
    return numbering.renumber(items, listed).select("id", "sort_order")


_SESSION_SQL = """
SELECT user_id, event_type, min(us) AS session_start, max(us) AS session_end, count(*) AS events FROM (
 SELECT *, sum(opens) OVER (PARTITION BY user_id, event_type ORDER BY us) AS sid FROM (
  SELECT user_id, event_type, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER
     (PARTITION BY user_id, event_type ORDER BY ts) <= {gap} * 1000000::BIGINT THEN 0 ELSE 1 END AS opens FROM events))
GROUP BY user_id, event_type, sid"""


def _micros(t):
    return t.events.select("user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@query("w3_gap_sessions", sql=_SESSION_SQL.format(gap=60))
def _w3(t):
    return sessions.gap_sessions(_micros(t), ["user_id", "event_type"], "us", 60)


@query("w3_gap_sessions_wide", sql=_SESSION_SQL.format(gap=43200))
def _w3w(t):
    """Half-day gaps: most sessions run over many buckets."""
    return sessions.gap_sessions(_micros(t), ["user_id", "event_type"], "us", 43200)


@query("sk6_retain_newest", sql=f"""
SELECT event_id, status FROM {HISTORY_SQL} ORDER BY ts DESC, event_id DESC LIMIT 1000""")
def _sk6(t):
    return logs.retain(history(t), ["ts", "event_id"], logs.HISTORY_KEEP).select("event_id", "status")


@query("t7_newest_entries", sql="""
SELECT event_id, event_type, value FROM events WHERE event_type <> 'view' ORDER BY event_id DESC LIMIT 500""")
def _t7(t):
    """A log of JSON lines in which every ``view`` line is damaged."""
    line = F.to_json(F.struct("event_id", "event_type", "value"))
    lines = t.events.select(F.when(F.col("event_type") == "view", F.concat(F.lit("x"), line)).otherwise(line).alias("value"))
    return logs.load_log(lines, "event_id long, event_type string, value double", ["event_id"], logs.NOTIFICATION_KEEP)


@query("a5_dataset_totals", sql="""
SELECT count(*) AS datasets, count(*) FILTER (WHERE lang <> 'en') AS tabular, count(*) FILTER (WHERE lang = 'en') AS documents,
 CAST(sum(length(lang)) AS BIGINT) AS columns, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents""")
def _a5(t):
    d = t.documents.select("lang", F.length("lang").alias("columns"), F.col("n_chars").alias("size_bytes"))
    return logs.dataset_totals(d, F.col("lang") == "en")


@query("a6_source_totals", sql="""
SELECT coalesce(c_mktsegment, 'all') AS class, count(*) AS sources, CAST(sum(c_nationkey) AS BIGINT) AS datasets,
 CAST(sum(coalesce(CASE WHEN c_acctbal > 0 THEN c_nationkey END, 0)) AS BIGINT) AS columns,
 CAST(sum(c_custkey) AS BIGINT) AS bytes FROM customer GROUP BY ROLLUP (c_mktsegment)""")
def _a6(t):
    src = t.customer.select(F.col("c_mktsegment").alias("class"), F.col("c_nationkey").alias("datasets"),
                            F.when(F.col("c_acctbal") > 0, F.col("c_nationkey")).alias("columns"),
                            F.col("c_custkey").alias("total_bytes"))
    return logs.source_totals(src)


@query("a18_scan_stats", sql="""
SELECT s_suppkey AS source_id, coalesce(n, s_nationkey) AS datasets, coalesce(c, 1) AS columns,
 coalesce(b, 0) AS total_bytes, strftime(last_at, '%Y-%m-%d') AS last_scan_at, coalesce(e, 0) AS errors
FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS c,
  CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS b, max(l_shipdate) AS last_at,
  count(*) FILTER (WHERE l_returnflag = 'R') AS e FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey
UNION ALL SELECT l_suppkey, count(*), CAST(sum(l_linenumber) AS BIGINT), CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT),
  strftime(max(l_shipdate), '%Y-%m-%d'), count(*) FILTER (WHERE l_returnflag = 'R') FROM lineitem
WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1""")
def _a18(t):
    scans = t.lineitem.select(
        F.col("l_suppkey").alias("source_id"), F.col("l_linenumber").alias("columns"),
        F.col("l_quantity").cast("long").alias("size_bytes"), F.col("l_shipdate").alias("scanned_at"),
        F.when(F.col("l_returnflag") == "R", "bad").alias("error"))
    old = t.supplier.select(
        F.col("s_suppkey").alias("source_id"), F.col("s_nationkey").cast("long").alias("datasets"),
        F.lit(1).cast("long").alias("columns"), F.lit(0).cast("long").alias("total_bytes"),
        F.lit(None).cast("timestamp_ntz").alias("last_scan_at"), F.lit(0).cast("long").alias("errors"))
    return logs.merge_scan_stats(old, logs.scan_stats(scans)).withColumn(
        "last_scan_at", F.date_format("last_scan_at", "yyyy-MM-dd"))


@query("a20_unread_notifications", sql="""
SELECT count(*) FILTER (WHERE event_type NOT IN ('view', 'click') AND user_id NOT IN (SELECT s_suppkey FROM supplier)) AS unread,
 count(*) AS total FROM events""")
def _a20(t):
    notes = t.events.select("event_id", F.col("user_id").alias("id"), F.col("event_type").isin("view", "click").alias("read"))
    marked = logs.mark_read(notes, t.supplier.select(F.col("s_suppkey").alias("id")))
    return logs.unread(marked)


@query("pf13_needs_attention", sql="""
SELECT c_custkey FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_at, bool_or(o_orderstatus = 'P') AS p
  FROM orders GROUP BY 1) ON o_custkey = c_custkey
WHERE c_mktsegment <> 'MACHINERY' AND (c_nationkey < 3 OR last_at IS NULL OR last_at < TIMESTAMP '2001-06-30 00:00:00')""")
def _pf13(t):
    last = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_scan_at"))
    src = t.customer.join(last, "c_custkey", "left").select(
        "c_custkey", (F.col("c_mktsegment") == "MACHINERY").alias("scanning"),
        F.when(F.col("c_nationkey") < 3, 1).alias("errors"), "last_scan_at")
    return logs.needs_attention(src, F.lit("2001-07-01").cast("timestamp_ntz")).select("c_custkey")


@query("pf18_catch_up", sql="""
SELECT c_custkey FROM customer WHERE c_nationkey > 0 AND (CASE WHEN c_acctbal >= 0 THEN c_mktsegment END) IS DISTINCT FROM 'BUILDING'""")
def _pf18(t):
    roots = t.customer.select("c_custkey", F.col("c_nationkey").alias("datasets"),
                              F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("published_to"))
    return logs.catch_up(roots, "BUILDING").select("c_custkey")


def _folder(t):
    return t.documents.select(
        "doc_id", F.concat("source", F.lit("/Doc"), "doc_id", F.lit("."), "lang").alias("relative_path"),
        F.when(F.col("lang") == "en", "document").when(F.col("lang") == "de", "text").otherwise("other").alias("format_class"),
        F.col("n_chars").alias("size_bytes"),
        F.when(F.col("n_chars") > 300, F.date_format(F.timestamp_seconds(F.col("n_chars") * 86400 + 946684800),
                                                      "yyyy-MM-dd HH:mm:ss")).otherwise("someday").alias("last_modified"))


@query("pf8_folder_view", sql="""
SELECT doc_id FROM documents WHERE contains(lower(source || '/Doc' || doc_id || '.' || lang), 'doc1')
 AND lang IN ('en', 'de') AND n_chars > 300 AND n_chars >= 1000 - 700""")
def _pf8(t):
    as_of = F.timestamp_seconds(F.lit(1000 * 86400 + 946684800))
    return logs.folder_view(_folder(t), as_of, " DOC1 ", ["document", "text"], 700).select("doc_id")


@query("t6_listing_sort", sql="""
SELECT doc_id, size_bytes FROM (SELECT doc_id, n_chars AS size_bytes, source || '/Doc' || doc_id || '.' || lang AS p FROM documents)
""")
def _t6(t):
    return logs.folder_view(_folder(t), F.current_timestamp(), sort="size-desc").select("doc_id", "size_bytes")


@query("pf11_keyword_filter", sql="""
SELECT p_partkey FROM part WHERE contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'ring brand#1')""")
def _pf11(t):
    return search.filter_keywords(t.part, ["p_name", "p_brand", "p_type"], "Ring Brand#1").select("p_partkey")


@query("t9_group_and_order", sql="""
SELECT grp, s_name, s_acctbal, CAST(row_number() OVER (ORDER BY grp, s_acctbal, s_name) - 1 AS BIGINT) AS place FROM
 (SELECT CASE WHEN s_nationkey < 5 THEN '' ELSE 'NATION_' || s_nationkey END AS grp, s_name, s_acctbal FROM supplier)""")
def _t9(t):
    """Ungrouped sources first, then groups A to Z, by sort order inside each."""
    src = t.supplier.select(F.coalesce(F.when(F.col("s_nationkey") >= 5, F.concat(F.lit("NATION_"), "s_nationkey")),
                                       F.lit("")).alias("grp"), "s_name", "s_acctbal")
    return numbering.number_rows(src, [F.asc("grp"), F.asc("s_acctbal"), F.asc("s_name")], "place")


@query("t8_list_catalog", sql="""
SELECT doc_id, path FROM (SELECT doc_id, source || '/' || lang || '/' || doc_id AS path FROM documents)
WHERE starts_with(path, 'src1/') ORDER BY path""")
def _t8(t):
    rows = t.documents.select("doc_id", F.concat_ws("/", "source", "lang", "doc_id").alias("path"),
                              F.lit("w").alias("workspace_id"))
    return search.list_catalog(rows, "w", "src1").select("doc_id", "path")
