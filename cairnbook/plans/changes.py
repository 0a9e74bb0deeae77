"""Incremental refresh, drift, relationships and database catalogs (J1-J8, J11, J13, A15-A17, A19, SO2)."""

from pyspark.sql import functions as F

from cairnbook.operators import dbcatalog, drift, incremental, relations
from cairnbook.plans.registry import query

# Two states of the same files: orders before a cut-off date, and orders not finished,
# where urgent ones have been touched again since.
OLD_SQL = """(SELECT 'f/' || o_orderkey AS key, CAST(o_totalprice * 100 AS BIGINT) AS size_bytes,
  strftime(o_orderdate, '%Y-%m-%d') AS mtime_marker FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01')"""
NEW_SQL = """(SELECT 'f/' || o_orderkey AS key, CAST(o_totalprice * 100 AS BIGINT) AS size_bytes,
  strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderpriority = '1-URGENT' THEN 'T1' ELSE '' END AS mtime_marker
  FROM orders WHERE o_orderstatus <> 'F')"""


def _files(df, marker):
    return df.select(F.concat(F.lit("f/"), "o_orderkey").alias("key"),
                     F.round(F.col("o_totalprice") * 100).cast("long").alias("size_bytes"),
                     marker.alias("mtime_marker"))


def old_state(t):
    return _files(t.orders.where(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz")),
                  F.date_format("o_orderdate", "yyyy-MM-dd"))


def new_state(t):
    touched = F.when(F.col("o_orderpriority") == "1-URGENT", "T1").otherwise("")
    return _files(t.orders.where("o_orderstatus <> 'F'"),
                  F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), touched))


@query("j1_freshness_lookup", sql=f"""
SELECT n.key, CASE WHEN o.key IS NULL THEN 'miss' WHEN n.mtime_marker <> o.mtime_marker THEN 'stale'
  WHEN n.size_bytes >= 25000000 AND o.size_bytes < 30000000 THEN 'miss' ELSE 'hit' END AS state
FROM {NEW_SQL} n LEFT JOIN {OLD_SQL} o USING (key)""")
def _j1(t):
    listing = new_state(t).withColumnRenamed("mtime_marker", "mtime")
    cache = old_state(t).withColumnRenamed("mtime_marker", "mtime").withColumn(
        "has_text", F.col("size_bytes") >= 30000000)
    return incremental.freshness(listing, cache, ["key"], F.col("size_bytes") >= 25000000, "has_text").select(
        "key", "state")


@query("j2_manifest_diff", sql=f"""
SELECT coalesce(o.key, n.key) AS key, CASE WHEN o.key IS NULL THEN 'new' WHEN n.key IS NULL THEN 'removed'
  WHEN o.size_bytes = n.size_bytes AND o.mtime_marker = n.mtime_marker THEN 'unchanged' ELSE 'changed' END AS change
FROM {OLD_SQL} o FULL JOIN {NEW_SQL} n ON o.key = n.key""")
def _j2(t):
    return incremental.manifest_diff(old_state(t), new_state(t))


@query("j3_drop_missing", sql=f"""
SELECT key, key IN (SELECT key FROM {NEW_SQL}) AS kept FROM {OLD_SQL}""")
def _j3(t):
    kept, dropped = incremental.drop_missing(old_state(t), new_state(t))
    return kept.select("key", F.lit(True).alias("kept")).unionByName(
        dropped.select("key", F.lit(False).alias("kept")))


@query("so2_key_differences", sql=f"""
SELECT key, 'added' AS side FROM {NEW_SQL} WHERE key NOT IN (SELECT key FROM {OLD_SQL})
UNION ALL SELECT key, 'removed' FROM {OLD_SQL} WHERE key NOT IN (SELECT key FROM {NEW_SQL})""")
def _so2(t):
    return incremental.key_differences(old_state(t), new_state(t))


@query("j13_orphans", sql="""
SELECT DISTINCT l_partkey AS file_id FROM lineitem WHERE l_returnflag = 'A'
 AND l_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 25)
 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 30)""")
def _j13(t):
    ids = F.col("l_partkey").alias("file_id")
    return incremental.orphans(
        t.lineitem.where("l_returnflag = 'A'").select(ids),
        t.lineitem.where("l_returnflag = 'R' AND l_quantity > 25").select(ids),
        t.part.where("p_size > 30").select(F.col("p_partkey").alias("file_id")))


@query("pf15_changed_roots", sql="""
SELECT c_custkey AS root, CASE WHEN c_mktsegment = 'BUILDING' THEN true
  ELSE coalesce(newest > TIMESTAMP '2000-01-01', false) END AS changed
FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS newest FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def _pf15(t):
    listing = t.orders.select(F.col("o_custkey").alias("root"), F.col("o_orderdate").alias("mtime"))
    last = t.customer.select(F.col("c_custkey").alias("root"), F.when(
        F.col("c_mktsegment") != "BUILDING", F.lit("2000-01-01").cast("timestamp_ntz")).alias("last_scan"))
    return incremental.changed_roots(listing, last)


# Column catalogs of many datasets: every order is a dataset, its line numbers are columns.
_COLS_OLD = """(SELECT l_orderkey AS dataset, 'Col' || l_linenumber AS name, max(l_returnflag) AS type FROM lineitem
  WHERE l_shipdate < TIMESTAMP '2000-01-01' GROUP BY ALL)"""
_COLS_NEW = """(SELECT l_orderkey AS dataset, CASE WHEN l_quantity > 45 THEN 'col' ELSE 'Col' END || l_linenumber AS name,
  max(l_returnflag) AS type FROM lineitem WHERE l_quantity > 5 GROUP BY ALL)"""
_DIFF = f"""SELECT coalesce(o.dataset, n.dataset) AS dataset, CASE WHEN o.name IS NULL THEN 'Added'
   WHEN n.name IS NULL THEN 'Removed' ELSE 'TypeChanged' END AS kind, coalesce(o.name, n.name) AS name,
  o.type AS old_type, n.type AS new_type
 FROM {_COLS_OLD} o FULL JOIN {_COLS_NEW} n ON o.dataset = n.dataset AND o.name = n.name
 WHERE o.type IS DISTINCT FROM n.type"""


def _cols_old(t):
    return (t.lineitem.where(F.col("l_shipdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
            .select(F.col("l_orderkey").alias("dataset"), F.concat(F.lit("Col"), "l_linenumber").alias("name"),
                    F.col("l_returnflag").alias("type")))


def _cols_new(t):
    case = F.when(F.col("l_quantity") > 45, "col").otherwise("Col")
    return t.lineitem.where("l_quantity > 5").select(
        F.col("l_orderkey").alias("dataset"), F.concat(case, "l_linenumber").alias("name"),
        F.col("l_returnflag").alias("type"))


@query("j4_schema_diff", sql=_DIFF)
def _j4(t):
    return drift.schema_diff(_cols_old(t), _cols_new(t), ["dataset"])


@query("a19_change_counts", sql=f"""
SELECT dataset, count(*) FILTER (WHERE kind = 'Added') AS added, count(*) FILTER (WHERE kind = 'Removed') AS removed,
 count(*) FILTER (WHERE kind = 'TypeChanged') AS type_changed FROM ({_DIFF}) GROUP BY dataset""")
def _a19(t):
    return drift.change_counts(drift.schema_diff(_cols_old(t), _cols_new(t), ["dataset"]), ["dataset"])


def _as_json(cols):
    """Per dataset the schema JSON its catalog record would hold (a few columns each)."""
    one = cols.groupBy("dataset", "name").agg(F.max("type").alias("type"))
    return one.groupBy("dataset").agg(F.to_json(F.collect_list(F.struct("name", "type"))).alias("schema_json"))


@query("j5_catalog_drift", sql=f"""
SELECT * FROM ({_DIFF}) WHERE dataset IN (SELECT dataset FROM {_COLS_OLD}) AND dataset IN (SELECT dataset FROM {_COLS_NEW})""")
def _j5(t):
    return drift.catalog_drift(_as_json(_cols_old(t)), _as_json(_cols_new(t)), ["dataset"])


# Datasets for relationship search: one per part, named after its name and number.
_DS = """(SELECT p_partkey AS id, replace(p_name, ' ', '') || p_size || CASE WHEN p_partkey <= 1000 THEN '' ELSE 's' END
  || '.csv' AS name FROM part)"""
_DCOL = """(SELECT p_partkey AS id, unnest([CASE WHEN p_size > 10 THEN 'ID' ELSE 'code' END, 'amount',
   replace(p_name, ' ', '') || p_size || '_id']) AS name FROM part)"""
_BYNAME = f"(SELECT lower(replace(name, '.csv', '')) AS table_name, max(id) AS target_id FROM {_DS} GROUP BY 1)"


def _datasets(t):
    plural = F.when(F.col("p_partkey") <= 1000, "").otherwise("s")
    return t.part.select(F.col("p_partkey").alias("id"), F.concat(
        F.replace("p_name", F.lit(" "), F.lit("")), "p_size", plural, F.lit(".csv")).alias("name"))


def _dataset_columns(t):
    own = F.when(F.col("p_size") > 10, "ID").otherwise("code")
    ref = F.concat(F.replace("p_name", F.lit(" "), F.lit("")), "p_size", F.lit("_id"))
    return t.part.select(F.col("p_partkey").alias("id"), F.explode(F.array(own, F.lit("amount"), ref)).alias("name"))


_NAME_EDGES = f"""(SELECT id AS source_id, first(target_id ORDER BY rank) AS target_id, name AS source_column,
  'id' AS target_column, 60 AS confidence, 'schema_fk_pattern' AS method
 FROM (SELECT c.id, c.name, rank, CASE rank WHEN 0 THEN s WHEN 1 THEN s || 's' ELSE rtrim(s, 's') END AS table_name
   FROM (SELECT id, name, lower(replace(name, '_id', '')) AS s FROM {_DCOL} WHERE ends_with(lower(name), '_id')) c,
        (VALUES (0), (1), (2)) r(rank))
 JOIN {_BYNAME} USING (table_name)
 WHERE target_id IN (SELECT id FROM {_DCOL} WHERE lower(name) = 'id') GROUP BY id, name)"""


@query("j6_name_relations", sql=f"SELECT * FROM {_NAME_EDGES}")
def _j6(t):
    return relations.name_relations(_datasets(t), _dataset_columns(t))


def _history(t):
    """Past queries made of order rows: joins of two tables, one of them under an alias."""
    sql = F.concat(F.lit("SELECT * FROM nation"), F.col("o_orderkey"), F.lit(" n JOIN customer AS c ON n."),
                   F.substring("o_orderpriority", 3, 3), F.lit(" = C.key join orders o on customer.key=o."),
                   F.substring("o_orderpriority", 3, 3))
    return t.orders.select(F.when(F.col("o_orderstatus") == "F", "error").otherwise("success").alias("status"),
                           sql.alias("sql"), F.col("o_orderdate").alias("ts"))


_MINED = """(SELECT * FROM (
  SELECT 'n' AS left_table, 'customer' AS right_table, lower(substr(o_orderpriority, 3, 3)) AS left_column,
   'key' AS right_column, count(*) AS times FROM orders WHERE o_orderstatus <> 'F' GROUP BY 3
  UNION ALL SELECT 'customer', 'orders', 'key', lower(substr(o_orderpriority, 3, 3)), count(*) FROM orders
  WHERE o_orderstatus <> 'F' GROUP BY 4))"""


@query("j7_join_mining", sql=f"SELECT * FROM {_MINED}")
def _j7(t):
    return relations.mined_joins(_history(t))


@query("j8_edge_merge", sql="""
SELECT l_suppkey AS source_id, l_linenumber AS target_id, 'a' AS source_column, 'b' AS target_column,
 CAST(least(100, first(CASE WHEN l_returnflag = 'R' THEN 80 ELSE 60 END ORDER BY seq) + 20 * (count(*) - 1)) AS INTEGER) AS confidence,
 CASE WHEN count(*) FILTER (WHERE l_returnflag = 'R') > first(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END ORDER BY seq)
  THEN 'query_history_join+schema'
  ELSE first(CASE WHEN l_returnflag = 'R' THEN 'query_history_join' ELSE 'schema_fk_pattern' END ORDER BY seq) END AS method
FROM (SELECT *, l_orderkey * 100000000 + l_partkey AS seq FROM lineitem) GROUP BY l_suppkey, l_linenumber""")
def _j8(t):
    hist = F.col("l_returnflag") == "R"
    seq = F.col("l_orderkey") * 100000000 + F.col("l_partkey")
    edges = t.lineitem.select(
        F.col("l_suppkey").alias("source_id"), F.col("l_linenumber").alias("target_id"),
        F.lit("a").alias("source_column"), F.lit("b").alias("target_column"),
        F.when(hist, 80).otherwise(60).alias("confidence"),
        F.when(hist, "query_history_join").otherwise("schema_fk_pattern").alias("method"), seq.alias("seq"))
    return relations.merge_edges(edges)


# Past queries that join a part's table with another, as often as its lines were returned.
_JOINED = """(SELECT lower(replace(p_name, ' ', '') || p_size) AS l, lower(replace(p_name, ' ', '') || p_size || 's') AS r,
  l_returnflag = 'R' AS good FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def _part_history(t):
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("")), "p_size")
    rows = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return rows.select(F.when(F.col("l_returnflag") == "R", "success").otherwise("error").alias("status"),
                       F.concat(F.lit("SELECT 1 FROM x JOIN "), name, F.lit("s AS b ON "), name, F.lit("."), name, F.lit("_id = b.id")).alias("sql"))


@query("j6_j8_detect", sql=f"""
WITH hist AS (
  SELECT a.target_id AS source_id, b.target_id, l || '_id' AS source_column, 'id' AS target_column, count(*) AS times
  FROM {_JOINED} JOIN {_BYNAME} a ON a.table_name = l JOIN {_BYNAME} b ON b.table_name = r WHERE good GROUP BY ALL
), edge AS (
  SELECT source_id, target_id, source_column, target_column, 60 AS first, 1 AS times, 0 AS h, 'schema_fk_pattern' AS method, 0 AS seq FROM {_NAME_EDGES}
  UNION ALL SELECT source_id, target_id, source_column, target_column, 80, times, times, 'query_history_join', 1 FROM hist)
SELECT source_id, target_id, source_column, target_column, CAST(least(100, first(first ORDER BY seq) + 20 * (sum(times) - 1)) AS INTEGER) AS confidence,
  CASE WHEN sum(h) > first(CASE WHEN seq = 1 THEN 1 ELSE 0 END ORDER BY seq) THEN 'query_history_join+schema' ELSE first(method ORDER BY seq) END AS method
FROM edge GROUP BY source_id, target_id, source_column, target_column""")
def _j68(t):
    """Relationships by name and by history together, each edge once."""
    return relations.detect(_datasets(t), _dataset_columns(t), _part_history(t))


# Listing tables of a database made of order lines: orders are tables, lines are columns.
_ICOL = """(SELECT DISTINCT 't' || l_orderkey AS table_name, l_linenumber AS ordinal, 'c' || l_linenumber AS column_name FROM lineitem)"""


def _info_columns(t):
    return t.lineitem.select(F.concat(F.lit("t"), "l_orderkey").alias("table_name"),
                             F.col("l_linenumber").alias("ordinal"),
                             F.concat(F.lit("c"), "l_linenumber").alias("column_name"))


def _index_rows(t):
    return t.lineitem.select(
        F.concat(F.lit("t"), "l_orderkey").alias("table_name"),
        F.concat(F.lit("ix_"), "l_returnflag").alias("index_name"), F.col("l_linenumber").alias("ordinal"),
        F.concat(F.lit("c"), "l_linenumber").alias("column_name"))


_IDX = """(SELECT table_name, index_name, string_agg(column_name, ',' ORDER BY ordinal) AS cols FROM
  (SELECT DISTINCT 't' || l_orderkey AS table_name, 'ix_' || l_returnflag AS index_name, l_linenumber AS ordinal,
    'c' || l_linenumber AS column_name FROM lineitem) GROUP BY ALL)"""


@query("a15_index_groups", sql=f"SELECT * FROM {_IDX}")
def _a15(t):
    return dbcatalog.index_groups(_index_rows(t), ["table_name", "index_name"]).select(
        "table_name", "index_name", F.array_join("columns", ",").alias("cols"))


def _fk_rows(t):
    table = F.concat(F.lit("t"), "l_orderkey").alias("table_name")
    usage = t.lineitem.select(table, F.concat(F.lit("fk"), "l_orderkey", "l_linestatus").alias("constraint_name"),
                              F.col("l_linenumber").alias("ordinal"),
                              F.concat(F.lit("c"), "l_linenumber").alias("column_name"))
    constraints = t.orders.select(F.explode(F.array(F.lit("F"), F.lit("O"))).alias("s"), "o_orderkey", "o_custkey").select(
        F.concat(F.lit("fk"), "o_orderkey", "s").alias("constraint_name"),
        F.concat(F.lit("pk"), "o_custkey").alias("unique_name"))
    target = t.customer.select(
        F.concat(F.lit("pk"), "c_custkey").alias("unique_name"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("ordinal"),
        F.concat(F.lit("cust"), "c_custkey").alias("target_table")).withColumn(
        "target_column", F.concat(F.lit("k"), "ordinal"))
    return dbcatalog.resolve_foreign_keys(usage, constraints, target)


_FK = """(SELECT table_name, 'fk' || l_orderkey || l_linestatus AS constraint_name, max('cust' || o_custkey) AS target_table,
   string_agg('c' || ordinal, ',' ORDER BY ordinal) AS cols, string_agg('k' || ordinal, ',' ORDER BY ordinal) AS target_cols
  FROM (SELECT DISTINCT 't' || l_orderkey AS table_name, l_orderkey, l_linestatus, l_linenumber AS ordinal FROM lineitem)
  JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY ALL)"""


@query("a16_foreign_key_groups", sql=f"SELECT * FROM {_FK}")
def _a16(t):
    return dbcatalog.foreign_key_groups(_fk_rows(t), ["table_name", "constraint_name"]).select(
        "table_name", "constraint_name", "target_table", F.array_join("columns", ",").alias("cols"),
        F.array_join("target_columns", ",").alias("target_cols"))


@query("j11_table_catalog", sql=f"""
SELECT c.table_name, c.cols, c.keys, CAST(floor(o_totalprice) AS BIGINT) AS row_estimate, i.indexes, f.fks
FROM (SELECT table_name, string_agg(column_name, ',' ORDER BY ordinal) AS cols,
        count(*) FILTER (WHERE ordinal = 1) AS keys FROM {_ICOL} GROUP BY 1) c
LEFT JOIN orders ON 't' || o_orderkey = c.table_name
LEFT JOIN (SELECT table_name, string_agg(index_name || '(' || cols || ')', ';' ORDER BY index_name) AS indexes FROM {_IDX} GROUP BY 1) i
  ON i.table_name = c.table_name
LEFT JOIN (SELECT table_name, string_agg(constraint_name || '>' || target_table || '(' || target_cols || ')', ';' ORDER BY constraint_name) AS fks
  FROM {_FK} GROUP BY 1) f ON f.table_name = c.table_name""")
def _j11(t):
    cols = _info_columns(t)
    made = dbcatalog.table_catalog(
        cols.withColumn("data_type", F.lit("BIGINT")).withColumn("nullable", F.lit(True)),
        cols.where("ordinal = 1"),
        t.orders.select(F.concat(F.lit("t"), "o_orderkey").alias("table_name"),
                        F.floor("o_totalprice").cast("long").alias("row_estimate"), F.lit(0).alias("size_bytes")),
        _index_rows(t), _fk_rows(t))
    return made.select(
        "table_name", F.array_join(F.col("columns.column_name"), ",").alias("cols"),
        F.size(F.filter("columns", lambda c: c["is_primary_key"])).cast("long").alias("keys"), "row_estimate",
        F.array_join(F.transform("indexes", lambda i: F.concat(
            i["index_name"], F.lit("("), F.array_join(i["columns"], ","), F.lit(")"))), ";").alias("indexes"),
        F.array_join(F.transform("foreign_keys", lambda k: F.concat(
            k["constraint_name"], F.lit(">"), k["target_table"], F.lit("("), F.array_join(k["target_columns"], ","),
            F.lit(")"))), ";").alias("fks"))


@query("a17_field_types", sql="""
SELECT 'k' AS name, 'Int32' AS data_type, count(*) AS seen FROM events
UNION ALL SELECT 'v', CASE WHEN (SELECT value FROM events ORDER BY event_id LIMIT 1) > 100 THEN 'String' ELSE 'Double' END, count(*) FROM events
UNION ALL SELECT event_type, 'Array', count(*) FROM events GROUP BY 1""")
def _a17(t):
    v = F.col("value").cast("decimal(12,2)").cast("string")
    shown = F.when(F.col("value") > 100, F.concat(F.lit('"'), v, F.lit('"'))).otherwise(v)
    doc = F.concat(F.regexp_replace("props", r"\}$", ""), F.lit(',"v":'), shown, F.lit(',"'), "event_type", F.lit('":[1]}'))
    return dbcatalog.infer_fields(t.events.select("event_id", doc.alias("doc")), "doc", "event_id")
