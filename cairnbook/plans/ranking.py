"""Search, path ownership, address resolution and set queries (T1-T3, J9, J10, PF12, SO1, SO3)."""

from pyspark.sql import functions as F

from cairnbook.operators import paths, routes, search
from cairnbook.plans.registry import query

# Search entries: documents and pages with their text, parts as tables with two columns.
_ENTRIES = """(SELECT source AS folder_path, lang || '/' || doc_id || '.txt' AS relative_path, text,
   CAST(NULL AS VARCHAR) AS c0, CAST(NULL AS VARCHAR) AS c1 FROM documents
 UNION ALL SELECT 'web', regexp_replace(url, '^[a-z]+://', ''), html, NULL, NULL FROM pages
 UNION ALL SELECT 'parts', lower(p_type) || '/' || p_partkey || '.csv', NULL, p_name, p_type || '_en' FROM part)"""


def _grade(text, q, scores):
    a, b, c = scores
    return f"CASE WHEN {text} = '{q}' THEN {a} WHEN starts_with({text}, '{q}') THEN {b} WHEN contains({text}, '{q}') THEN {c} ELSE 0 END"


def _search_sql(q):
    base = "regexp_extract(lower(relative_path), '[^/]*$')"
    name = f"greatest({_grade(base, q, (120, 95, 75))}, CASE WHEN contains(lower(relative_path), '{q}') THEN 40 ELSE 0 END)"
    s0, s1 = (f"coalesce({_grade(f'lower({c})', q, (95, 75, 55))}, 0)" for c in ("c0", "c1"))
    pos = f"instr(lower(text), '{q}')"
    n = len(q)
    return f"""SELECT folder_path, relative_path, score, match_column, snippet FROM (
 SELECT *, CAST(name_score + greatest(s0, s1) + CASE WHEN pos > 0 THEN 50 ELSE 0 END AS INTEGER) AS score,
  CASE WHEN greatest(s0, s1) = 0 THEN NULL WHEN s0 >= s1 THEN c0 ELSE c1 END AS match_column,
  CASE WHEN pos > 0 THEN trim(replace(substr(text, greatest(pos - 40, 1), pos + {n + 40} - greatest(pos - 40, 1)), chr(10), ' '),
     ' ' || chr(9) || chr(10) || chr(13)) END AS snippet
 FROM (SELECT *, {name} AS name_score, {s0} AS s0, {s1} AS s1, coalesce({pos}, 0) AS pos FROM {_ENTRIES}))
WHERE score > 0"""


def entries(t):
    schema = "array<struct<name:string,type:string>>"
    docs = t.documents.select(F.col("source").alias("folder_path"), F.concat(
        "lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("relative_path"),
        F.lit(None).cast(schema).alias("schema"), "text")
    pages = t.pages.select(F.lit("web").alias("folder_path"), F.regexp_replace("url", "^[a-z]+://", "").alias(
        "relative_path"), F.lit(None).cast(schema).alias("schema"), F.col("html").alias("text"))
    parts = t.part.select(
        F.lit("parts").alias("folder_path"), F.concat(F.lower("p_type"), F.lit("/"), "p_partkey", F.lit(".csv")).alias("relative_path"),
        F.array(F.struct(F.col("p_name").alias("name"), F.lit("VARCHAR").alias("type")),
                F.struct(F.concat("p_type", F.lit("_en")).alias("name"), F.lit("BIGINT").alias("type"))).alias("schema"),
        F.lit(None).cast("string").alias("text"))
    return docs.unionByName(pages).unionByName(parts)


_SHOWN = ["folder_path", "relative_path", "score", "match_column", "snippet"]


@query("t1_ranked_search", sql=_search_sql("en") + " ORDER BY score DESC, relative_path, folder_path LIMIT 200")
def _t1(t):
    return search.search(entries(t), " EN ").select(*_SHOWN)


@query("t1_column_search", sql=_search_sql("ring") + " ORDER BY score DESC, relative_path, folder_path LIMIT 200")
def _t1c(t):
    return search.search(entries(t), "Ring").select(*_SHOWN)


_SKIPPED = f"""SELECT '' AS folder_path, n AS relative_path, CAST({_grade('lower(n)', 'en', (100, 75, 55))} AS INTEGER) AS score,
  NULL AS match_column, NULL AS snippet FROM (SELECT CASE WHEN c_nationkey = 3 THEN 'EN' ELSE lower(c_mktsegment) || '-en' || c_custkey || '.MP4' END AS n
  FROM customer WHERE c_nationkey < 6) WHERE contains(lower(n), 'en')"""


def _skipped(t):
    name = F.when(F.col("c_nationkey") == 3, "EN").otherwise(
        F.concat(F.lower("c_mktsegment"), F.lit("-en"), "c_custkey", F.lit(".MP4")))
    return t.customer.where("c_nationkey < 6").select(
        name.alias("name"), F.lit(None).cast("long").alias("size_bytes"), F.lit("too_large").alias("reason"))


@query("t2_search_with_skipped", sql=f"""
SELECT * FROM (({_search_sql('en')}) UNION ALL ({_SKIPPED})) ORDER BY score DESC, relative_path, folder_path LIMIT 200""")
def _t2(t):
    return search.search_everything(entries(t), _skipped(t), "en").select(*_SHOWN)


@query("so1_union_of_shapes", sql=f"""
SELECT * FROM (SELECT folder_path, relative_path, score, snippet, CAST(NULL AS BIGINT) AS size_bytes FROM ({_search_sql('ring')})
 UNION ALL SELECT '', n, CAST(55 AS INTEGER), NULL, 0 FROM (SELECT lower(c_mktsegment) || '-en' || c_custkey || '.MP4' AS n
  FROM customer WHERE c_nationkey < 6 AND c_nationkey <> 3) WHERE contains(n, 'ing-en'))""")
def _so1(t):
    """Indexed and skipped matches have different columns; missing ones become null."""
    found = search.score_entries(entries(t), "ring")
    extra = search.score_skipped(_skipped(t), "ing-en")
    return found.unionByName(extra, allowMissingColumns=True).select(
        "folder_path", "relative_path", "score", "snippet", "size_bytes")


@query("t3_catalog_search", sql="""
SELECT p_partkey, CAST(CASE WHEN lower(p_name) = 'steel' THEN 100 WHEN starts_with(lower(p_name), 'steel') THEN 90
  WHEN contains(lower(p_name), 'steel') THEN 70 WHEN contains(lower(p_type), 'steel') THEN 60
  WHEN contains(lower(p_brand), 'steel') THEN 50 ELSE 40 END AS INTEGER) AS score FROM part
WHERE p_size > 5 AND (contains(lower(p_name), 'steel') OR contains(lower(p_type), 'steel') OR contains(lower(p_brand), 'steel') OR p_size > 45)
ORDER BY score DESC, p_name, p_partkey LIMIT 300""")
def _t3(t):
    rows = t.part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 5, "w").alias("workspace_id"),
                         F.col("p_name").alias("name"), F.col("p_type").alias("path"), F.col("p_brand").alias("description"),
                         F.when(F.col("p_size") > 45, F.array(F.lit("x"), F.lit("Steelish"))).alias("tags"))
    return search.search_catalog(rows, "STEEL", 300, "w").select(F.col("id").alias("p_partkey"), "score")


_ROOTS = """(SELECT min(regexp_extract(url, '^[a-z]+://[^/]+(/[a-z]+)?')) AS root, min(page_id) AS ord FROM pages
   WHERE starts_with(url, 'http:') GROUP BY regexp_extract(url, '^[a-z]+://[^/]+(/[a-z]+)?')
  UNION ALL SELECT regexp_extract(url, '^[a-z]+://[a-z]+'), 1000000 + min(page_id) FROM pages GROUP BY 1)"""


def _roots(t):
    near = t.pages.where(F.col("url").startswith("http:")).groupBy(
        F.regexp_extract("url", "^[a-z]+://[^/]+(/[a-z]+)?", 0).alias("root")).agg(F.min("page_id").alias("order"))
    far = t.pages.groupBy(F.regexp_extract("url", "^[a-z]+://[a-z]+", 0).alias("root")).agg(
        (F.min("page_id") + 1000000).alias("order"))
    return near.unionByName(far)


@query("j9_owning_root", sql=f"""
SELECT url AS path, first(root ORDER BY ord) AS root FROM pages LEFT JOIN {_ROOTS} ON starts_with(url, root) GROUP BY url""")
def _j9(t):
    return paths.owning_root(t.pages.select(F.col("url").alias("path")), _roots(t))


@query("pf12_path_allow_list", sql="""
SELECT DISTINCT p AS path FROM (SELECT '/' || source || '/' || lang || '/' || doc_id AS p FROM documents),
 (SELECT '/src' || (n_nationkey // 2) || CASE WHEN n_nationkey > 10 THEN '/en' ELSE '' END AS r FROM nation WHERE n_nationkey > 5)
WHERE p = r OR starts_with(p, r || '/')""")
def _pf12(t):
    """``/src1`` as a root lets ``/src1/…`` pass but not ``/src10/…``."""
    files = t.documents.select(F.concat_ws("/", F.lit(""), "source", "lang", "doc_id").alias("path"))
    root = F.concat(F.lit("/src"), F.floor(F.col("n_nationkey") / 2), F.when(F.col("n_nationkey") > 10, "/en/").otherwise(""))
    return paths.allowed(files, t.nation.where("n_nationkey > 5").select(root.alias("root")))


_ADDR = """(SELECT doc_id, CASE WHEN lang = 'de' THEN 'file:///' || source WHEN lang = 'fr' THEN 'local://other/' || source || '/' || doc_id
  WHEN n_chars < 1000 THEN 'local://me/' || source || '/d%20' || doc_id || '.csv#S' WHEN n_chars < 2000 THEN 'local://me/d%20' || doc_id || '.csv'
  ELSE 'local://me/gone/' || doc_id END AS address, '/' || source || '/d ' || doc_id || '.csv' AS file, lang, n_chars, source FROM documents)"""


@query("j10_resolve_address", sql=f"""
SELECT address, CASE WHEN lang IN ('en', 'es') AND n_chars < 2000 AND (n_chars < 1000 OR source IN ('src1', 'src2', 'src3')) THEN file END AS file,
 CASE WHEN lang = 'de' THEN 'bad-format' WHEN lang = 'fr' THEN 'mismatch' WHEN n_chars >= 2000 OR (n_chars >= 1000 AND source NOT IN ('src1', 'src2', 'src3')) THEN 'not-found' END AS error,
 CASE WHEN lang IN ('en', 'es') AND (n_chars >= 2000 OR (n_chars >= 1000 AND source NOT IN ('src1', 'src2', 'src3'))) THEN 3 END AS tried
FROM (SELECT DISTINCT address, lang, source, CASE WHEN lang = 'de' THEN 0 ELSE n_chars END AS n_chars, CASE WHEN lang = 'de' THEN '' ELSE file END AS file FROM {_ADDR})""")
def _j10(t):
    c = F.col("n_chars")
    address = (F.when(F.col("lang") == "de", F.concat(F.lit("file:///"), "source"))
               .when(F.col("lang") == "fr", F.concat(F.lit("local://other/"), "source", F.lit("/"), "doc_id"))
               .when(c < 1000, F.concat(F.lit("local://me/"), "source", F.lit("/d%20"), "doc_id", F.lit(".csv#S")))
               .when(c < 2000, F.concat(F.lit("local://me/d%20"), "doc_id", F.lit(".csv")))
               .otherwise(F.concat(F.lit("local://me/gone/"), "doc_id")))
    files = t.documents.select(F.concat(F.lit("/"), "source", F.lit("/d "), "doc_id", F.lit(".csv")).alias("file"))
    roots = t.documents.where("source IN ('src1', 'src2', 'src3')").groupBy("source").agg(
        F.min("doc_id").alias("order")).select(F.concat(F.lit("/"), "source").alias("root"), "order")
    return paths.resolve_addresses(t.documents.select(address.alias("address")), roots, files, "me")


@query("j10_places_tried", sql="""
SELECT 'local://me/gone/' || doc_id AS address, array_to_string(['/gone/' || doc_id] || (SELECT list(r || '/gone/' || doc_id ORDER BY o) FROM (
  SELECT '/' || source AS r, min(doc_id) AS o FROM documents WHERE source IN ('src1', 'src2', 'src3') GROUP BY 1)), '|') AS places
FROM documents WHERE n_chars >= 2000""")
def _j10p(t):
    """Where an address was looked for that leads nowhere: as it is, then below every root in their order."""
    missing = t.documents.where("n_chars >= 2000").select(F.concat(F.lit("local://me/gone/"), "doc_id").alias("address"))
    roots = t.documents.where("source IN ('src1', 'src2', 'src3')").groupBy("source").agg(
        F.min("doc_id").alias("order")).select(F.concat(F.lit("/"), "source").alias("root"), "order")
    return routes.places_tried(missing, roots).select("address", F.array_join("places", "|").alias("places"))


@query("so3_distinct_union", sql="""
SELECT p AS path, CAST(min(seq) AS BIGINT) AS seq FROM (SELECT o_custkey AS p, o_orderkey AS seq FROM orders WHERE o_orderstatus = 'F'
 UNION ALL SELECT o_custkey, 100000000 + o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1""")
def _so3(t):
    """Roots of two lists, each once, with the position it was first seen at."""
    first = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("seq"))
    second = t.orders.where("o_orderstatus = 'O'").select(
        F.col("o_custkey").alias("path"), (F.col("o_orderkey") + 100000000).alias("seq"))
    return first.unionByName(second).groupBy("path").agg(F.min("seq").alias("seq"))
