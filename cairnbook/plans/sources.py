"""Reader queries: Parquet, CSV, JSON, workbooks, collections, key-value dumps, trees."""

import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from cairnbook.operators import drift
from cairnbook.plans.registry import query
from cairnbook.session import new_dir
from cairnbook.sources import catalog, keyvalue, listing, readers, tree, workbook


@query("sc1_parquet_scan", sql="""
SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY ALL""")
def _sc1(t):
    return (readers.read_table(t.spark, t.path("lineitem"))
            .where(F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
            .groupBy("l_returnflag", "l_linestatus")
            .agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty")))


@query("sc2_csv_ladder_strict", sql="""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate,
 o_orderpriority, 1 AS rung FROM orders""")
def _sc2(t):
    path = new_dir(t.spark, "orders-csv")
    t.orders.write.option("header", "true").csv(path)
    df, rung = readers.read_csv_ladder(t.spark, path)
    return df.select(
        F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"),
        "o_orderstatus", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        "o_orderpriority", F.lit(rung).alias("rung"))


@query("sc2_csv_ladder_ragged", sql="""
SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey >= 5 THEN c_acctbal END AS c_acctbal,
 CASE WHEN c_nationkey >= 5 THEN c_mktsegment END AS c_mktsegment, 2 AS rung
FROM customer WHERE c_nationkey < 20""")
def _sc2r(t):
    """Rows with too few fields are padded, rows with too many are dropped."""
    full = F.concat_ws(",", "c_custkey", "c_name", "c_nationkey", F.col("c_acctbal").cast("decimal(12,2)"),
                       "c_mktsegment")
    k = F.col("c_nationkey")
    line = (F.when(k < 5, F.concat_ws(",", "c_custkey", "c_name", "c_nationkey"))
            .when(k >= 20, F.concat(full, F.lit(",x,y"))).otherwise(full))
    path = new_dir(t.spark, "ragged-csv")
    (t.customer.select(line.alias(",".join(t.customer.columns))).write.option("header", "true")
     .option("sep", "\x01").option("quote", "\x02").csv(path))
    df, rung = readers.read_csv_ladder(t.spark, path)
    return df.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name",
                     F.col("c_nationkey").cast("int").alias("c_nationkey"), "c_acctbal", "c_mktsegment",
                     F.lit(rung).alias("rung"))


def _documents_csv(t):
    """Documents as CSV: texts hold line ends, every field is quoted, and names hold a stray quote."""
    path = new_dir(t.spark, "documents-csv")
    (t.documents.select("doc_id", F.replace("text", F.lit(" "), F.lit(" \r\n")).alias("text"), "lang",
                        F.concat("doc_id", F.lit('" pipe')).alias("size")).write
     .option("header", "true").option("quoteAll", "true").option("escape", '"').csv(path))
    return path


@query("sc2_csv_quoted_line_ends", sql="""
SELECT doc_id, md5(replace(text, ' ', ' ' || chr(13) || chr(10))) AS digest, lang, doc_id || '" pipe' AS size, 1 AS rung FROM documents""")
def _sc2q(t):
    """Line ends inside quotes are part of the field; every record comes back as it was written."""
    df, rung = readers.read_csv_ladder(t.spark, _documents_csv(t))
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("digest"), "lang", "size", F.lit(rung).alias("rung"))


@query("sc7_csv_record_counts", sql="SELECT count(*) AS table_rows, count(*) AS catalog_rows FROM documents")
def _sc7c(t):
    """The catalog counts as many records as the table has, line ends inside quotes or not."""
    path = _documents_csv(t)
    df, _ = readers.read_csv_ladder(t.spark, path)
    records = catalog.scan_catalog(t.spark, path, "*.csv")
    both = df.select(F.lit(1).cast("long").alias("t"), F.lit(0).cast("long").alias("c")).unionByName(
        records.select(F.lit(0).cast("long").alias("t"), F.col("row_count").alias("c")))
    return both.agg(F.sum("t").alias("table_rows"), F.sum("c").alias("catalog_rows"))


@query("sc3_delimited_scan", sql="SELECT * FROM part WHERE p_size < 40")
def _sc3(t):
    """Tab-separated rows; those whose size column holds no number are left out."""
    path = new_dir(t.spark, "part-tsv")
    size = F.when(F.col("p_size") < 40, F.col("p_size").cast("string")).otherwise("n/a")
    t.part.withColumn("p_size", size).write.option("header", "true").option("sep", "\t").csv(path)
    return readers.read_delimited(t.spark, path, "\t", t.part.schema)


@query("sc4_json_scan", sql="""
SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value FROM events""")
def _sc4(t):
    path = new_dir(t.spark, "events-json")
    doc = F.concat(F.lit('{"event_id":'), "event_id", F.lit(',"event_type":"'), "event_type", F.lit('","value":'),
                   F.col("value").cast("decimal(12,2)"), F.lit(',"props":'), "props", F.lit("}"))
    t.events.select(doc.alias("value")).write.text(path)
    return readers.read_table(t.spark, path, "jsonl").select("event_id", "event_type", "props.k", "value")


def _book(pdf: pd.DataFrame) -> bytes:
    """A small workbook with one row per customer."""
    rows = []
    for r in pdf.itertuples():
        rows.append(
            f'<row><c r="A1"><v>{r.c_custkey}</v></c><c r="B1" t="inlineStr"><is><t>{escape(r.c_mktsegment)},"x"'
            f'</t></is></c><c r="D1"><v>{r.c_acctbal!r}</v></c><c r="E1" t="b"><v>{int(r.c_nationkey > 10)}</v></c>'
            f'<c r="F1" t="e"><v>#DIV/0!</v></c></row>')
    ns = "http://schemas.openxmlformats.org"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}/spreadsheetml/2006/main" xmlns:r="{ns}/officeDocument'
                   '/2006/relationships"><sheets><sheet name="a" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{ns}/package/2006/relationships">'
                   '<Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}/spreadsheetml/2006/main"><sheetData>'
                   + "".join(rows) + "</sheetData></worksheet>")
    return out.getvalue()


@query("sc5_workbook_rows", sql='''
SELECT c_custkey || ',"' || c_mktsegment || ',""x""",,' || regexp_replace(CAST(c_acctbal AS VARCHAR), '\\.0$', '')
  || ',' || CASE WHEN c_nationkey > 10 THEN 'true' ELSE 'false' END || ',#ERR:#DIV/0!' AS line FROM customer''')
def _sc5(t):
    """Customers packed into workbooks of at most fifty rows, then read back."""
    def pack(key, pdf):
        return pd.DataFrame({"path": [f"book-{key[0]}.xlsx"], "content": [_book(pdf)]})

    books = (t.customer.withColumn("book", F.floor(F.col("c_custkey") / 50))
             .groupBy("book").applyInPandas(pack, "path string, content binary"))
    return workbook.read_workbooks(books).where("error IS NULL").select(
        workbook.csv_line(F.col("cells")).alias("line"))


@query("sc10_collections", sql="""
SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL""")
def _sc10(t):
    path = new_dir(t.spark, "collection")
    t.events.select("event_type", F.from_json("props", "struct<k:long>").alias("props")).write.json(path)
    readers.register_collections(t.spark, {"event_docs": path})
    return t.spark.sql("SELECT event_type, props.k AS k, count(*) AS n FROM event_docs GROUP BY ALL")


@query("sc11_key_value_table", sql="""
SELECT 'conv:' || conv_id || ':' || turn || ':' || role AS key, CASE role
  WHEN 'system' THEN '{len=' || length(text) || ', role=' || role || '}'
  WHEN 'user' THEN '[' || array_to_string(string_split(text, ' ')[1:10], ', ') || ']'
  ELSE text END AS value,
 CASE role WHEN 'system' THEN 'hash' WHEN 'user' THEN 'list' ELSE 'string' END AS value_type, -1 AS ttl
FROM conversations""")
def _sc11(t):
    role = F.col("role")
    dump = t.conversations.select(
        F.concat_ws(":", F.lit("conv"), "conv_id", "turn", "role").alias("key"),
        F.when(role == "system", "hash").when(role == "user", "list").otherwise("string").alias("value_type"),
        F.lit(None).cast("int").alias("ttl"), "text",
        F.when(role == "user", F.split("text", " ")).alias("items"),
        F.create_map(F.lit("len"), F.length("text").cast("string"), F.lit("role"), role).alias("fields"))
    return keyvalue.render_kv(dump)


def _edges(t):
    folder = F.lit(tree.FOLDER_TYPE)

    def part(df, parent, ident, name, mime):
        return df.select(parent.alias("parent"), ident.alias("id"), name.alias("name"), mime.alias("mime"))

    def key(prefix, col):
        return F.concat(F.lit(prefix), F.col(col))

    o = F.col("o_orderstatus")
    mime = (F.when(F.col("o_orderpriority") == "1-URGENT", F.lit(tree.EXPORTABLE[0]))
            .when(F.col("o_orderpriority") == "5-LOW", tree.NATIVE_PREFIX + "form").otherwise("application/x"))
    name = F.concat(F.lit("o"), "o_orderkey", F.when(o == "F", ".csv").when(o == "O", ".MP4").otherwise(".Pdf"))
    return (
        part(t.region, F.lit("root"), key("r", "r_regionkey"), F.col("r_name"), folder)
        .unionByName(part(t.nation, key("r", "n_regionkey"), key("n", "n_nationkey"), F.col("n_name"), folder))
        .unionByName(part(t.nation, key("n", "n_nationkey"), key("r", "n_regionkey"), F.lit("loop"), folder))
        .unionByName(part(t.nation, key("n", "n_nationkey"), F.lit("root"), F.lit("loop"), folder))
        .unionByName(part(t.customer, key("n", "c_nationkey"), key("c", "c_custkey"), F.col("c_name"), folder))
        .unionByName(part(t.orders, key("c", "o_custkey"), key("o", "o_orderkey"), name, mime)))


_ORDER_CLASS = """CASE WHEN o_orderpriority = '1-URGENT' THEN 'export' WHEN o_orderpriority = '5-LOW' THEN 'native'
  WHEN o_orderstatus = 'O' THEN 'unsupported' ELSE 'file' END"""


@query("sc12_walk_tree", sql=f"""
SELECT 'r' || r_regionkey AS id, 'folder' AS class, 1 AS depth FROM region
UNION ALL SELECT 'n' || n_nationkey, 'folder', 2 FROM nation
UNION ALL SELECT 'c' || c_custkey, 'folder', 3 FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation)
UNION ALL SELECT 'o' || o_orderkey, {_ORDER_CLASS}, 4 FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)""")
def _sc12(t):
    return tree.walk_tree(_edges(t), "root").select("id", "class", "depth")


@query("sc12_walk_totals", sql=f"""
SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + 1 AS folders,
 count(*) FILTER (WHERE k IN ('file', 'export')) AS files, count(*) FILTER (WHERE k = 'native') AS skipped_native,
 count(*) FILTER (WHERE k = 'unsupported') AS skipped_unsupported
FROM (SELECT {_ORDER_CLASS} AS k FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))""")
def _sc12t(t):
    return tree.walk_totals(tree.walk_tree(_edges(t), "root"))


# Documents of which the last has a word where the others have a number, and the only value of one field.
_LATE_SQL = """(SELECT CAST(doc_id AS VARCHAR) AS id, lang, CASE WHEN doc_id = last THEN 'many' ELSE CAST(n_chars AS VARCHAR) END AS size,
  CAST(n_chars % 7 / 2.0 AS VARCHAR) AS half, CASE WHEN doc_id = last THEN '2024-02-29' END AS late
  FROM documents, (SELECT max(doc_id) AS last FROM documents))"""
_NARROWED_SQL = """CASE WHEN count(v) = 0 THEN 'VARCHAR' WHEN bool_and(lower(v) IN ('true', 'false')) THEN 'BOOLEAN'
  WHEN bool_and(regexp_full_match(v, '[+-]?[0-9]{1,18}')) THEN 'BIGINT' WHEN bool_and(v IS NULL OR TRY_CAST(v AS DOUBLE) IS NOT NULL) THEN 'DOUBLE'
  WHEN bool_and(v IS NULL OR regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND TRY_CAST(v AS DATE) IS NOT NULL) THEN 'DATE' ELSE 'VARCHAR' END"""


def _late_folder(t, kind, late=True):
    """The documents as CSV or JSON lines in several files, in the order of their ids."""
    last = F.col("doc_id") == F.col("last")
    rows = t.documents.join(F.broadcast(t.documents.agg(F.max("doc_id").alias("last")))).withColumn("half", F.col("n_chars") % 7 / 2)
    own = [F.col("doc_id").alias("id"), "lang"]
    path = new_dir(t.spark, f"late-{kind}")
    if kind == "csv":
        size = F.when(last & F.lit(late), "many").otherwise(F.col("n_chars").cast("string"))
        rows = rows.select(*own, size.alias("size"), "half", F.when(last & F.lit(late), "2024-02-29").alias("late"))
        rows.repartitionByRange(3, "id").sortWithinPartitions("id").write.option("header", "true").csv(path)
    else:
        plain = rows.where(~last).select("doc_id", F.to_json(F.struct(*own, F.col("n_chars").alias("size"), "half")).alias("value"))
        odd = rows.where(last).select("doc_id", F.to_json(F.struct(
            *own, F.lit("many").alias("size"), "half", F.lit("2024-02-29").alias("late"))).alias("value"))
        lines = plain.unionByName(odd).repartitionByRange(3, "doc_id").sortWithinPartitions("doc_id").select("value")
        lines.write.text(path)
    return path


@query("sc7_late_types", sql=f"""
WITH odd AS {_LATE_SQL}
SELECT kind, name, rows, CASE WHEN kind = 'json' AND name = 'late' THEN 'VARCHAR' ELSE type END AS type FROM (
 SELECT name, {_NARROWED_SQL} AS type, (SELECT count(*) FROM documents) AS rows FROM (
  SELECT name, v FROM odd UNPIVOT INCLUDE NULLS (v FOR name IN (id, lang, size, half, late))) GROUP BY name), (VALUES ('csv'), ('json')) k(kind)""")
def _sc7t(t):
    """Columns of documents written as CSV and as JSON lines; what the last record changes is in the schema."""
    found = None
    for kind in ("csv", "json"):
        files = listing.list_files(t.spark, _late_folder(t, kind), "part-*").withColumn("file_format", F.lit(kind))
        records = catalog.scan_files(t.spark, files).withColumn("kind", F.lit(kind))
        counts = records.groupBy("kind").agg(F.sum("row_count").alias("rows"))
        columns = catalog.dataset_schema(catalog.schema_columns(records, ["kind"], stored=True), ["kind"])
        found = columns.join(counts, "kind") if found is None else found.unionByName(columns.join(counts, "kind"))
    return found.select("kind", "name", "rows", "type")


@query("j5_late_drift", sql="""
SELECT 'TypeChanged' AS kind, 'size' AS name, 'BIGINT' AS old_type, 'VARCHAR' AS new_type WHERE (SELECT count(*) FROM documents) > 1
UNION ALL SELECT 'TypeChanged', 'late', 'VARCHAR', 'DATE' WHERE (SELECT count(*) FROM documents) > 1""")
def _j5l(t):
    """Drift between two versions of a CSV folder that differ in their last record only."""
    versions = []
    for late in (False, True):
        columns = catalog.schema_columns(catalog.scan_catalog(t.spark, _late_folder(t, "csv", late), "*.csv").withColumn(
            "dataset", F.lit("documents")), ["dataset"], stored=True)
        versions.append(catalog.dataset_schema(columns, ["dataset"]))
    return drift.schema_diff(*versions, ["dataset"]).select("kind", "name", "old_type", "new_type")
