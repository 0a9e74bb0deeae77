"""Listings, path predicates, fingerprints and the catalog scan."""

from pyspark.sql import functions as F

from cairnbook.functions.text import extension
from cairnbook.plans.profiles import TABLES, _TYPE_CASE
from cairnbook.plans.registry import query
from cairnbook.session import new_dir
from cairnbook.sources import catalog, listing

# A listing derived from part: folder, file name with an extension by size class, bytes, time.
PART_LISTING_SQL = """(SELECT p_partkey, p_type, lower(p_type) ||
  CASE p_brand WHEN 'Brand#2' THEN '/node_modules' WHEN 'Brand#3' THEN '/~$old' ELSE '' END || '/' ||
  replace(p_name, ' ', '_') || '_' || p_partkey || ext AS relative_path, substr(lower(ext), 2) AS ext,
  p_size * 1048576 * 2 AS size_bytes, 1700000000 + p_partkey AS mtime
 FROM (SELECT *, CASE WHEN p_size < 8 THEN '.csv' WHEN p_size < 14 THEN '.Parquet' WHEN p_size < 20 THEN '.exe'
   WHEN p_size < 30 THEN '.docx' WHEN p_size < 35 THEN '.py' WHEN p_size < 40 THEN '.tmp'
   WHEN p_size < 46 THEN '.json' ELSE '' END AS ext FROM part))"""


def part_listing(t):
    s = F.col("p_size")
    ext = (F.when(s < 8, ".csv").when(s < 14, ".Parquet").when(s < 20, ".exe").when(s < 30, ".docx")
           .when(s < 35, ".py").when(s < 40, ".tmp").when(s < 46, ".json").otherwise(""))
    folder = F.concat(F.lower("p_type"), F.when(F.col("p_brand") == "Brand#2", "/node_modules")
                      .when(F.col("p_brand") == "Brand#3", "/~$old").otherwise(""))
    return t.part.select(
        "p_partkey", "p_type",
        F.concat(folder, F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"),
                 F.col("p_partkey"), ext).alias("relative_path"),
        (s.cast("long") * (2 * 1048576)).alias("size_bytes"),
        (F.col("p_partkey") + 1700000000).alias("mtime"))


_EXCLUDED = "(contains(relative_path, '/node_modules/') OR contains(relative_path, '/~$old/'))"


@query("sc6_list_files", sql="SELECT * FROM (VALUES " + ",".join(f"('{n}', 'parquet')" for n in TABLES)
       + ") v(dataset, file_format)")
def _sc6(t):
    """All files below the data folder, as datasets named by their first path part."""
    files = listing.list_files(t.spark, t.root)
    return files.select(F.regexp_extract("relative_path", r"^([^/.]+)\.", 1).alias("dataset"),
                        extension(F.col("path")).alias("file_format")).distinct()


@query("sc6_list_partitions", sql="""
SELECT coalesce(source, '__HIVE_DEFAULT_PARTITION__') AS source, coalesce(lang, '__HIVE_DEFAULT_PARTITION__') AS lang, 1 AS files,
 CAST(length('doc_id') + 1 + sum(length(CAST(doc_id AS VARCHAR)) + 1) AS BIGINT) AS size_bytes FROM documents GROUP BY 1, 2""")
def _sc6p(t):
    """Documents written as one CSV file per source and language, then listed: every folder with its file and its bytes."""
    root = new_dir(t.spark, "partitions")
    t.documents.select("doc_id", "source", "lang").repartition("source", "lang").write.partitionBy("source", "lang").option("header", "true").csv(root)
    files = listing.list_files(t.spark, root, "*.csv")
    part = [F.regexp_extract("relative_path", rf"{name}=([^/]*)/", 1).alias(name) for name in ("source", "lang")]
    return files.groupBy(*part).agg(F.count("*").cast("int").alias("files"), F.sum("size_bytes").alias("size_bytes"))


@query("sc7_catalog_scan", sql=" UNION ALL ".join(
    f"""SELECT '{n}' AS dataset, (SELECT count(*) FROM {n}) AS row_count, column_name AS name,
    {_TYPE_CASE} AS type, true AS has_samples FROM (DESCRIBE {n})""" for n in TABLES))
def _sc7(t):
    records = catalog.scan_catalog(t.spark, t.root)
    records = records.withColumn("dataset", F.regexp_extract("relative_path", r"^([^/.]+)\.", 1))
    per_set = records.groupBy("dataset").agg(
        F.sum("row_count").alias("row_count"), F.max("schema_json").alias("schema_json"),
        F.bool_or(F.col("sample_rows").isNotNull()).alias("has_samples"))
    return catalog.schema_columns(per_set, ["dataset", "row_count", "has_samples"]).drop("nullable")


@query("sc8_reader_dispatch", sql=f"""
SELECT p_partkey, CASE WHEN ext = 'parquet' THEN 'parquet' WHEN ext = 'csv' THEN 'csv'
  WHEN ext = 'docx' THEN NULL WHEN p_type = 'ECONOMY' THEN 'parquet' ELSE 'csv' END AS reader FROM {PART_LISTING_SQL}""")
def _sc8(t):
    ext = extension(F.col("relative_path"))
    ctype = F.when(F.col("p_type") == "ECONOMY", "application/vnd.apache.parquet").when(
        F.col("p_type") == "PROMO", "text/plain")
    return part_listing(t).select("p_partkey", listing.reader_for(
        F.when(ext == "docx", "XLSX").otherwise(ext), ctype).alias("reader"))


@query("pf1_exclude_globs", sql=f"SELECT p_partkey, {_EXCLUDED} AS excluded FROM {PART_LISTING_SQL}")
def _pf1(t):
    return part_listing(t).select("p_partkey", listing.excluded(F.col("relative_path")).alias("excluded"))


@query("pf2_always_skip", sql=f"SELECT p_partkey, ext IN ('exe','tmp') AS skipped FROM {PART_LISTING_SQL}")
def _pf2(t):
    return part_listing(t).select("p_partkey", listing.always_skipped(F.col("relative_path")).alias("skipped"))


@query("pf3_size_cap", sql=f"""
SELECT p_partkey, size_bytes FROM {PART_LISTING_SQL}
WHERE size_bytes <= CASE WHEN ext = 'docx' THEN 50 ELSE 80 END * 1048576""")
def _pf3(t):
    files = part_listing(t)
    return files.where(listing.within_size(F.col("relative_path"), F.col("size_bytes"), max_mb=80)).select(
        "p_partkey", "size_bytes")


@query("pf4_format_class", sql=f"""
SELECT CASE WHEN ext = 'docx' THEN 'document' WHEN ext = 'py' THEN 'text'
  WHEN ext IN ('csv','parquet','json') THEN 'tabular' ELSE 'other' END AS format_class, count(*) AS files
FROM {PART_LISTING_SQL} GROUP BY 1""")
def _pf4(t):
    cls = listing.format_class(extension(F.col("relative_path")))
    return part_listing(t).groupBy(cls.alias("format_class")).agg(F.count("*").alias("files"))


@query("pf5_scan_tier", sql=f"""
SELECT p_partkey, CASE WHEN ext = 'docx' THEN 'shallow' WHEN ext = 'py' THEN 'content'
  WHEN ext IN ('csv','parquet','json') THEN 'full' ELSE 'shallow' END AS tier FROM {PART_LISTING_SQL}""")
def _pf5(t):
    tiers = {"docx": "SHALLOW", "py": "Content", "csv": "everything"}
    return part_listing(t).select("p_partkey", listing.scan_tier(
        extension(F.col("relative_path")), tiers).alias("tier"))


@query("a13_subtree_sizes", sql=f"""
SELECT folder, CAST(sum(size_bytes) AS BIGINT) AS total_bytes, count(*) AS files FROM (
  SELECT size_bytes, unnest(list_transform(range(1, len(p)), lambda n: array_to_string(p[1:n], '/'))) AS folder
  FROM (SELECT size_bytes, string_split(relative_path, '/') AS p FROM {PART_LISTING_SQL})) GROUP BY folder""")
def _a13(t):
    return listing.subtree_sizes(part_listing(t), "relative_path", "size_bytes")


@query("a14_folder_fingerprint", sql=f"""
SELECT p_type, files, sha256(files || ':' || w0 || ':' || w1 || ':' || w2 || ':' || w3) AS fingerprint FROM (
 SELECT p_type, count(*) AS files, sum(('0x' || substr(d, 1, 16))::UBIGINT) AS w0,
  sum(('0x' || substr(d, 17, 16))::UBIGINT) AS w1, sum(('0x' || substr(d, 33, 16))::UBIGINT) AS w2,
  sum(('0x' || substr(d, 49, 16))::UBIGINT) AS w3
 FROM (SELECT p_type, sha256(relative_path || '|' || size_bytes || '|' || mtime) AS d FROM {PART_LISTING_SQL}
       WHERE ext IN ('csv','parquet','docx') AND NOT {_EXCLUDED}) GROUP BY p_type)""")
def _a14(t):
    return listing.folder_fingerprint(part_listing(t), ["p_type"])
