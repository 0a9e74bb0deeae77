"""Writing queries: conversion, upserts, caches, deletes, publishing, import and export (SK1-SK9, J12)."""

import pandas as pd
from pyspark.sql import functions as F

from cairnbook.operators import keyed, sinks
from cairnbook.plans.logs import history
from cairnbook.plans.registry import query
from cairnbook.session import hadoop_path, new_dir


@query("sk1_convert", sql="SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment, true AS first_free, true AS second_numbered FROM customer")
def _sk1(t):
    """CSV to zstd Parquet twice: the second conversion takes the next free name."""
    folder = new_dir(t.spark, "convert")
    source = f"{folder}/customer.csv"
    t.customer.write.option("header", "true").csv(source)
    first = sinks.convert(t.spark, source, folder)
    second = sinks.convert(t.spark, source, folder)
    df = t.spark.read.parquet(second["target"])
    return df.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name",
                     F.col("c_nationkey").cast("int").alias("c_nationkey"), "c_acctbal", "c_mktsegment",
                     F.lit(first["target"].endswith("/customer.parquet")).alias("first_free"),
                     F.lit(second["target"].endswith("/customer-converted-1.parquet")).alias("second_numbered"))


@query("sk1_convert_workbook", sql="""
SELECT c_custkey, c_mktsegment || ',"x"' AS segment, c_acctbal, c_nationkey > 10 AS far FROM customer WHERE c_custkey % 50 <> 0""")
def _sk1w(t):
    """Workbooks of fifty customers each, converted to Parquet as one folder; the first customer of a book names its columns."""
    from cairnbook.plans.sources import _book

    folder = new_dir(t.spark, "workbooks")
    root = f"{folder}/customers.xlsx"
    hadoop_path(t.spark, root)[0].mkdirs(hadoop_path(t.spark, root)[1])

    def pack(key, pdf):
        from cairnbook.sources.listing import _file_system

        fs, inner = _file_system(f"{root if ':' in root else 'file:' + root}/book-{key[0]}.xlsx")
        with fs.open_output_stream(inner) as out:
            out.write(_book(pdf.sort_values("c_custkey")))
        return pd.DataFrame({"n": [len(pdf)]})

    books = t.customer.withColumn("book", F.floor(F.col("c_custkey") / 50))
    books.groupBy("book").applyInPandas(pack, "n long").count()
    made = sinks.convert(t.spark, root, folder)
    df = t.spark.read.parquet(made["target"])
    number, segment, _, balance, far, _ = [F.col(f"`{c}`") for c in df.columns]
    return df.select(number.cast("long").alias("c_custkey"), segment.alias("segment"), balance.cast("double").alias("c_acctbal"), far.alias("far"))


# Catalog rows made of conversation turns: the turn is the file, its text the description.
_CAT = "SELECT 'id-' || conv_id || '-' || turn AS id, 'w' || (conv_id // 10) AS workspace_id, '/c' || conv_id || '/' || turn AS path, role AS name, length(text) AS size_bytes FROM conversations"
_UPD = """SELECT conv_id * 1000 + turn AS seq, CASE role WHEN 'system' THEN 'new-' || conv_id ELSE 'id-' || conv_id || '-' || (turn // 2) END AS id,
 'w' || (conv_id // 10) AS workspace_id, '/c' || conv_id || '/' || (turn // 3) AS path, 'upd' AS name, turn AS size_bytes
 FROM conversations WHERE role <> 'assistant'"""


def _catalog(t):
    ws = F.concat(F.lit("w"), F.floor(F.col("conv_id") / 10))
    return t.conversations.select(
        F.concat_ws("-", F.lit("id"), "conv_id", "turn").alias("id"), ws.alias("workspace_id"),
        F.concat(F.lit("/c"), "conv_id", F.lit("/"), "turn").alias("path"), F.col("role").alias("name"),
        F.length("text").cast("long").alias("size_bytes"))


def _updates(t):
    ws = F.concat(F.lit("w"), F.floor(F.col("conv_id") / 10))
    ident = F.when(F.col("role") == "system", F.concat(F.lit("new-"), "conv_id")).otherwise(
        F.concat(F.lit("id-"), "conv_id", F.lit("-"), F.floor(F.col("turn") / 2)))
    return t.conversations.where("role <> 'assistant'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), ident.alias("id"), ws.alias("workspace_id"),
        F.concat(F.lit("/c"), "conv_id", F.lit("/"), F.floor(F.col("turn") / 3)).alias("path"),
        F.lit("upd").alias("name"), F.col("turn").alias("size_bytes"))


@query("sk2_catalog_upsert", sql=f"""
WITH c AS ({_CAT}), u AS ({_UPD})
SELECT * FROM c WHERE id NOT IN (SELECT id FROM u) AND (workspace_id, path) NOT IN (SELECT (workspace_id, path) FROM u)
UNION ALL SELECT id, workspace_id, path, name, size_bytes FROM u
WHERE seq IN (SELECT max(seq) FROM u GROUP BY id) AND seq IN (SELECT max(seq) FROM u GROUP BY workspace_id, path)""")
def _sk2(t):
    return sinks.upsert_catalog(_catalog(t), _updates(t), "seq")


@query("sk2_partitioned_upsert", sql=f"""
WITH c AS ({_CAT}), u AS ({_UPD})
SELECT * FROM c WHERE id NOT IN (SELECT id FROM u) AND (workspace_id, path) NOT IN (SELECT (workspace_id, path) FROM u)
UNION ALL SELECT id, workspace_id, path, name, size_bytes FROM u
WHERE seq IN (SELECT max(seq) FROM u GROUP BY id) AND seq IN (SELECT max(seq) FROM u GROUP BY workspace_id, path)""")
def _sk2p(t):
    """The same catalog as a table in hash partitions: written once, updated twice, dealt anew between."""
    base = new_dir(t.spark, "keyed-catalog")
    rows = _catalog(t).withColumn("seq", F.lit(-1).cast("long"))
    keyed.upsert_catalog(rows, base, "seq", buckets=16)
    updates = _updates(t).withColumn("seq", F.col("seq").cast("long"))
    middle = updates.agg(F.max("seq")).first()[0] // 2
    keyed.upsert_catalog(updates.where(F.col("seq") <= middle), base, "seq")
    keyed.compact(t.spark, base, buckets=32)
    keyed.upsert_catalog(updates.where(F.col("seq") > middle), base, "seq")
    return keyed.read(t.spark, base)


@query("sk2_snapshot_round_trip", sql=f"SELECT * FROM ({_CAT})")
def _sk2s(t):
    """Three committed versions of the catalog; readers see the last."""
    base = new_dir(t.spark, "catalog")
    rows = _catalog(t)
    for version in (rows.where("name = 'user'"), rows.where("name <> 'user'"), rows):
        sinks.commit_snapshot(version, base)
    return sinks.read_snapshot(t.spark, base)


@query("sk3_cache_upsert", sql="""
SELECT conv_id, turn, role AS payload FROM conversations WHERE role = 'assistant' AND (conv_id, turn // 2) NOT IN
  (SELECT (conv_id, turn // 2) FROM conversations WHERE role = 'user') AND (conv_id, turn) NOT IN (SELECT (conv_id, turn // 2) FROM conversations WHERE role = 'user')
UNION ALL SELECT conv_id, turn, role FROM conversations WHERE role = 'assistant' AND (conv_id, turn) NOT IN (SELECT (conv_id, turn // 2) FROM conversations WHERE role = 'user')
  AND (conv_id, turn // 2) IN (SELECT (conv_id, turn // 2) FROM conversations WHERE role = 'user')
UNION ALL SELECT conv_id, turn // 2, 'u' || max(turn) FROM conversations WHERE role = 'user' GROUP BY conv_id, turn // 2""")
def _sk3(t):
    base = t.conversations.where("role = 'assistant'").select("conv_id", "turn", F.col("role").alias("payload"))
    upd = t.conversations.where("role = 'user'").select(
        "conv_id", F.floor(F.col("turn") / 2).alias("turn"), F.concat(F.lit("u"), "turn").alias("payload"),
        F.col("turn").alias("seq"))
    return sinks.upsert_keyed(base, upd, ["conv_id", "turn"], "seq")


@query("sk4_cache_get", sql="""
SELECT l.event_id, CASE WHEN l.event_type <> 'error' AND value >= 5 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
 l.event_type <> 'error' AND value >= 5 AS hit FROM events l""")
def _sk4(t):
    """Small values have changed since they were cached, error payloads are damaged."""
    wanted = t.events.select("event_id", F.col("user_id").alias("mtime"), F.col("value").alias("size_bytes"))
    stale = F.when(F.col("value") < 5, F.col("value") + 1).otherwise(F.col("value"))
    broken = F.when(F.col("event_type") == "error", F.concat(F.lit("{"), "props")).otherwise(F.col("props"))
    cache = t.events.select("event_id", F.col("user_id").alias("mtime"), stale.alias("size_bytes"),
                            broken.alias("payload_json"))
    return sinks.cache_get(wanted, cache, ["event_id"], "k long").select("event_id", "payload.k", "hit")


@query("sk5_delete_under", sql="""
SELECT doc_id, path FROM (SELECT doc_id, lang, source || '/' || lang || '/' || doc_id AS path FROM documents)
WHERE NOT (starts_with(path, 'src1/') AND lang <> 'de')""")
def _sk5(t):
    """Deleting ``src1`` leaves its siblings ``src10`` to ``src19`` and the other workspace alone."""
    rows = t.documents.select("doc_id", "lang", F.concat_ws("/", "source", "lang", "doc_id").alias("path"))
    return sinks.delete_under(rows, "src1", scope=F.col("lang") != "de").select("doc_id", "path")


@query("sk7_import_merge", sql="""
SELECT c_custkey, src, added, skipped, replaced FROM (
 SELECT c_custkey, 'current' AS src FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')
 UNION ALL SELECT c_custkey, 'imported' FROM customer WHERE c_nationkey < 12 AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY')),
(SELECT count(*) FILTER (WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')) AS added,
  count(*) FILTER (WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')) AS skipped, 0 AS replaced FROM customer WHERE c_nationkey < 12)""")
def _sk7(t):
    """An export of some folders, read back from its JSON lines and merged by path."""
    path = F.concat(F.lit("/data/"), "c_custkey").alias("path")
    current = t.customer.where("c_mktsegment IN ('BUILDING', 'MACHINERY')").select("c_custkey", path, F.lit("current").alias("src"))
    other = t.customer.where("c_nationkey < 12").select("c_custkey", path, F.lit("imported").alias("src"))
    bundle = sinks.export_bundle(other, t.part, history(t), "w1", "ts")
    out = new_dir(t.spark, "bundle")
    bundle.write.json(out)
    stored = t.spark.read.schema("kind string, body string").json(out)
    imported = sinks.bundle_part(stored, "folder", "c_custkey long, path string, src string")
    merged, counts = sinks.import_folders(current, imported)
    totals = counts.first()
    return merged.select("c_custkey", "src", *[F.lit(totals[c]).cast("long").alias(c) for c in counts.columns])


@query("sk7_export_bundle", sql="""
SELECT 'header' AS kind, 1 AS n UNION ALL SELECT 'folder', count(*) FROM customer
UNION ALL SELECT 'dataset', count(*) FROM part UNION ALL SELECT 'query', least(count(*), 500) FROM events""")
def _sk7e(t):
    bundle = sinks.export_bundle(t.customer, t.part, history(t), "w1", "ts")
    return bundle.groupBy("kind").agg(F.count("*").alias("n"))


@query("j12_import_merge", sql="""
SELECT l_partkey AS path, 'current' AS src FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1
UNION ALL SELECT l_partkey, 'imported' FROM lineitem WHERE l_returnflag = 'A' AND l_partkey NOT IN
  (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1""")
def _j12(t):
    def paths(flag, src):
        return (t.lineitem.where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("path")).distinct()
                .withColumn("src", F.lit(src)))

    return sinks.import_folders(paths("R", "current"), paths("A", "imported"), "skip")[0]


@query("sk8_publish_view", sql="""
SELECT page_id, CASE WHEN contains(url, '?') THEN url ELSE 's3://bucket/in/' || regexp_replace(url, '^[a-z]+://', '') END AS relative_path,
 CAST(NULL AS VARCHAR) AS document_text FROM pages""")
def _sk8(t):
    rows = t.pages.select("page_id", F.when(F.col("url").contains("?"), F.col("url")).otherwise(
        F.regexp_replace("url", "^[a-z]+://", "")).alias("relative_path"), F.col("html").alias("document_text"))
    return sinks.publish_view(rows, "s3://bucket/in//")


@query("sk9_register_sources", sql="""
WITH old AS (SELECT 'c' || c_custkey AS id, 'a' || c_nationkey || c_mktsegment || c_custkey AS address, c_custkey AS sort_order FROM customer WHERE c_acctbal > 0),
 offer AS (SELECT o_orderkey AS seq, 'o' || o_orderkey AS id, CASE WHEN o_orderpriority <> '5-LOW' THEN 'a' || c_nationkey || c_mktsegment || c_custkey END AS address
   FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'P'),
 fresh AS (SELECT * FROM offer WHERE address IS NULL OR (address NOT IN (SELECT address FROM old)
   AND seq IN (SELECT min(seq) FROM offer WHERE address IS NOT NULL GROUP BY address)))
SELECT * FROM old UNION ALL SELECT id, address, (SELECT max(sort_order) FROM old) + row_number() OVER (ORDER BY seq) FROM fresh""")
def _sk9(t):
    address = F.concat(F.lit("a"), "c_nationkey", "c_mktsegment", "c_custkey")
    old = t.customer.where("c_acctbal > 0").select(
        F.concat(F.lit("c"), "c_custkey").alias("id"), address.alias("address"), F.col("c_custkey").alias("sort_order"))
    offer = (t.orders.where("o_orderstatus = 'P'").join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
             .select(F.concat(F.lit("o"), "o_orderkey").alias("id"),
                     F.when(F.col("o_orderpriority") != "5-LOW", address).alias("address"),
                     F.col("o_orderkey").alias("seq")))
    return sinks.register_sources(old, offer)
