"""Scalar function queries (F1-F25) over whole tables."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnbook.functions import cells, html, sqltext, text, urls
from cairnbook.plans.registry import query

_ADDR_SQL = "regexp_replace(url, '^https', 'S3')"


def _addr():
    return F.regexp_replace("url", "^https", "S3")


@query("f1_url_predicates", sql=f"""
SELECT page_id, regexp_matches(lower(a), '^(https?|s3)://') AS remote,
       starts_with(lower(a), 's3://') AS bucket,
       starts_with(lower(a), 's3://') AND (ends_with(a, '/') OR contains(a, '*')) AS listing
FROM (SELECT page_id, {_ADDR_SQL} AS a FROM pages)""")
def _f1(t):
    a = _addr()
    return t.pages.select("page_id", urls.is_remote(a).alias("remote"),
                          urls.is_bucket(a).alias("bucket"),
                          urls.is_bucket_listing(a).alias("listing"))


_HOST = "'^[a-z0-9]+://[^/]+'"


@query("f2_join_url", sql=f"""
SELECT page_id, CASE WHEN ltrim(rel, '/') = '' THEN listing
       ELSE host || '/' || ltrim(rel, '/') END AS address
FROM (SELECT page_id, regexp_extract(url, {_HOST}) AS host,
             regexp_extract(url, {_HOST}) || '/*.html' AS listing,
             regexp_replace(url, {_HOST}, '') AS rel FROM pages)""")
def _f2(t):
    host = F.regexp_extract("url", "^[a-z0-9]+://[^/]+", 0)
    return t.pages.select("page_id", urls.join_url(
        F.concat(host, F.lit("/*.html")),
        F.regexp_replace("url", "^[a-z0-9]+://[^/]+", "")).alias("address"))


@query("f3_expand_listing", sql=f"""
SELECT page_id, CASE WHEN ends_with(a, '/') THEN a || '**/*' WHEN contains(a, '*') THEN a
                     ELSE a || '/**/*' END AS pattern
FROM (SELECT page_id, regexp_replace({_ADDR_SQL}, '\\.html$', '/*.parquet') AS a FROM pages)""")
def _f3(t):
    a = F.regexp_replace(_addr(), r"\.html$", "/*.parquet")
    return t.pages.select("page_id", urls.expand_listing(a).alias("pattern"))


@query("f4_validate_url", sql="""
SELECT page_id,
  CASE WHEN reason IS NULL THEN lower(scheme) || rest ||
       CASE WHEN lower(scheme) = 's3://' AND NOT contains(rest, '/') THEN '/' ELSE '' END END AS normalised,
  CASE WHEN reason IS NULL THEN lower(scheme) = 'http://' END AS insecure, reason
FROM (SELECT *, CASE WHEN a = '' THEN 'no address'
                     WHEN scheme = '' THEN 'scheme is none of https, http, s3'
                     WHEN rest = '' THEN 'no bucket named' END AS reason
  FROM (SELECT page_id, a, regexp_extract(a, '(?i)^(https?://|s3://)', 1) AS scheme,
               regexp_replace(a, '(?i)^(https?://|s3://)', '') AS rest
    FROM (SELECT page_id, trim(CASE
        WHEN ends_with(url, '/') THEN regexp_replace(url, '^https?(://[^/]+).*$', 'S3\\1')
        WHEN contains(url, '?') THEN regexp_replace(url, '^https?', 'FTP')
        WHEN contains(url, '#') THEN 's3://'
        ELSE '  ' || regexp_replace(url, '^http', 'HTTP') END) AS a FROM pages)))""")
def _f4(t):
    u = F.col("url")
    raw = (F.when(u.endswith("/"), F.regexp_replace(u, r"^https?(://[^/]+).*$", "S3$1"))
           .when(u.contains("?"), F.regexp_replace(u, "^https?", "FTP"))
           .when(u.contains("#"), F.lit("s3://"))
           .otherwise(F.concat(F.lit("  "), F.regexp_replace(u, "^http", "HTTP"))))
    return t.pages.select("page_id", urls.validate_url(raw).alias("v")).select("page_id", "v.*")


@query("f5_sheet_export_url", sql="""
SELECT page_id, CASE WHEN contains(url, '?') THEN NULL ELSE
  'https://docs.google.com/spreadsheets/d/' || page_id || '_x/export?format=csv' ||
  CASE WHEN contains(url, '#') THEN '&gid=' || length(url) ELSE '' END END AS export_url FROM pages""")
def _f5(t):
    u = F.col("url")
    doc = F.concat(F.lit("https://docs.google.com/spreadsheets/d/"), F.col("page_id"), F.lit("_x"))
    link = (F.when(u.contains("?"), u)
            .when(u.contains("#"), F.concat(doc, F.lit("/edit#a=1&GID="), F.length(u)))
            .otherwise(F.concat(doc, F.lit("/edit"))))
    return t.pages.select("page_id", urls.sheet_export_url(link).alias("export_url"))


_NAME_SQL = """regexp_extract(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''),
   '^[a-z]+://[^/]*', ''), '/+$', ''), '[^/]*$')"""


@query("f6_url_file_name", sql=f"""
SELECT page_id, CASE WHEN n = '' THEN 'remote' ELSE n || ' é+%zz' END AS file_name
FROM (SELECT page_id, {_NAME_SQL} AS n FROM pages)""")
def _f6(t):
    u = F.regexp_replace("url", r"^([^?#]*?)(/*)([?#].*)?$", "$1%20%C3%A9+%zz$2$3")
    return t.pages.select("page_id", urls.url_file_name(u).alias("file_name"))


@query("f7_url_extension", sql=f"""
SELECT page_id, CASE WHEN contains(n, '.') THEN lower(regexp_extract(n, '[^.]*$'))
                     WHEN contains(url, '?') THEN 'tsv' ELSE '' END AS extension
FROM (SELECT page_id, url, {_NAME_SQL} AS n FROM pages)""")
def _f7(t):
    u = F.regexp_replace("url", r"\?.*$", "?ref=x&Format=TSV")
    return t.pages.select("page_id", urls.url_extension(u).alias("extension"))


@query("f8_relative_key", sql="""
SELECT page_id, CASE WHEN starts_with(url, 'https') THEN regexp_replace(url, '^https://[^/]+/', '') END AS rel
FROM pages""")
def _f8(t):
    u = F.col("url")
    host = F.regexp_replace(F.regexp_extract(u, "^[a-z0-9]+://[^/]+", 0), "^http:", "https:")
    return t.pages.select("page_id", urls.relative_key(u, F.concat(host, F.lit("/*.csv"))).alias("rel"))


@query("f9_dataset_names", sql="""
SELECT p_partkey, replace(p_name, ' ', '.') AS stem,
       lower(replace(p_name, ' ', '_')) AS relation FROM part""")
def _f9(t):
    path = F.concat(F.lit("/data/"), F.col("p_type"), F.lit("/"),
                    F.replace("p_name", F.lit(" "), F.lit(".")), F.lit(".parquet"))
    name = F.concat(F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))),
                    F.when(F.col("p_size") > 25, ".csv.csv").otherwise(".xlsx.csv"))
    return t.part.select("p_partkey", text.dataset_name(path).alias("stem"),
                         text.relation_name(name).alias("relation"))


@query("f10_http_date", sql="""
SELECT event_id, CASE WHEN event_type IN ('click','view','purchase')
   THEN CAST(floor(epoch(ts)) AS BIGINT) END AS epoch FROM events""")
def _f10(t):
    kind = F.col("event_type")
    raw = (F.when(kind == "click", F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss 'GMT'"))
           .when(kind == "view", F.date_format("ts", "EEEE, dd-MMM-yy HH:mm:ss 'GMT'"))
           .when(kind == "purchase", F.date_format("ts", "EEE MMM  d HH:mm:ss yyyy"))
           .otherwise(F.col("props")))
    return t.events.select("event_id", cells.http_date_epoch(raw).alias("epoch"))


def _txt(c):
    return f"regexp_replace(CAST({c} AS VARCHAR), '\\.0$', '')"


@query("f11_cell_text", sql=f"""
SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
  {_txt('l_quantity')} AS l_quantity, {_txt('l_extendedprice')} AS l_extendedprice,
  {_txt('l_discount')} AS l_discount, l_returnflag,
  CAST(epoch_us(l_shipdate) AS VARCHAR) AS l_shipdate,
  coalesce(CASE WHEN l_tax > 0.02 THEN {_txt('l_tax')} END, 'NULL') AS tax,
  '<' || strlen(l_linestatus || l_returnflag) || ' bytes>' AS blob FROM lineitem""")
def _f11(t):
    df = t.lineitem
    shown = ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
             "l_returnflag", "l_shipdate"]
    out = [cells.cell_text(F.col(c), df.schema[c].dataType).alias(c) for c in shown]
    tax = F.when(F.col("l_tax") > 0.02, F.col("l_tax"))
    blob = F.concat("l_linestatus", "l_returnflag").cast("binary")
    return df.select(*out, cells.cell_text(tax, T.DoubleType()).alias("tax"),
                     cells.cell_text(blob, T.BinaryType()).alias("blob"))


@query("f12_json_safe_number", sql=f"""
SELECT l_orderkey, l_linenumber, l_extendedprice,
  CASE WHEN abs(big) > 9007199254740991 THEN '"' || big || '"' ELSE CAST(big AS VARCHAR) END AS big,
  CASE WHEN l_discount > 0.05 THEN 'null' ELSE {_txt('l_extendedprice')} END AS num,
  '"' || CAST(CAST(l_extendedprice AS DECIMAL(14,2)) AS VARCHAR) || '"' AS dec
FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * l_orderkey * 1000000000000 AS big
      FROM lineitem)""")
def _f12(t):
    sign = F.when(F.col("l_returnflag") == "R", F.lit(-1)).otherwise(F.lit(1))
    big = sign * F.col("l_orderkey") * F.lit(1000000000000)
    num = F.when(F.col("l_discount") > 0.05, F.lit(float("nan"))).otherwise(F.col("l_extendedprice"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", "l_extendedprice",
        cells.json_safe(big, T.LongType()).alias("big"),
        cells.json_safe(num, T.DoubleType()).alias("num"),
        cells.json_safe(F.col("l_extendedprice").cast("decimal(14,2)"), T.DecimalType(14, 2)).alias("dec"))


@query("f13_binary_text", sql="""
SELECT p_partkey, '0x' || lower(hex(p_name)) AS hex,
  CASE WHEN p_size > 25 THEN p_name ELSE '(BLOB) ' || (strlen(p_name) + 3) || ' bytes' END AS preview,
  right('0000000000' || bin(p_size), 10) AS bits FROM part""")
def _f13(t):
    raw = F.col("p_name").cast("binary")
    tail = F.when(F.col("p_size") > 25, F.unhex(F.lit("000000"))).otherwise(F.unhex(F.lit("FF0000")))
    bits = F.unhex(F.lpad(F.hex("p_size"), 4, "0"))
    return t.part.select("p_partkey", cells.hex_text(raw).alias("hex"),
                         cells.binary_preview(F.concat(raw, tail)).alias("preview"),
                         cells.bit_text(bits, 10).alias("bits"))


@query("f14_float_text", sql=f"""
SELECT event_id, {_txt('value')} AS cell,
       {_txt('CASE WHEN value >= 10 THEN floor(value) ELSE round(value / 7, 4) END')} AS average FROM events""")
def _f14(t):
    v = F.col("value")
    return t.events.select("event_id", cells.workbook_number(v).alias("cell"), cells.average_text(
        F.when(v >= 10, F.floor(v).cast("double")).otherwise(v / 7)).alias("average"))


@query("f15_snippet", sql="""
SELECT doc_id, CASE WHEN p > 0 THEN trim(replace(
         substr(text, greatest(p - 40, 1), p + 43 - greatest(p - 40, 1)), chr(10), ' '), ' ' || chr(9) || chr(10) || chr(13)) END AS snippet
FROM (SELECT doc_id, text, instr(lower(text), 'ent') AS p FROM documents)""")
def _f15(t):
    return t.documents.select("doc_id", text.snippet(F.col("text"), "ENT").alias("snippet"))


@query("f16_truncate_pages", sql="""
SELECT doc_id,
  CASE WHEN n = 1 AND length(text) <= 5000 THEN text
       WHEN n = 1 THEN guess
       WHEN n > 2 THEN body || chr(10) || chr(10) || '---' || chr(10) || '*Showing first 2 of ' || n ||
            ' pages. Click "Read all pages" to extract the full document.*'
       ELSE body END AS shown
FROM (
 SELECT doc_id, text, len(pages) AS n,
   '## Page 1' || chr(10) || chr(10) || coalesce(nullif(trim(pages[1], w), ''), e) ||
   CASE WHEN len(pages) > 1 THEN chr(10) || chr(10) || '## Page 2' || chr(10) || chr(10) ||
        coalesce(nullif(trim(pages[2], w), ''), e) ELSE '' END AS body,
   CASE WHEN instr(reverse(substr(text, 1, 5000)), chr(10) || chr(10)) > 0
        THEN substr(text, 1, 5000 - instr(reverse(substr(text, 1, 5000)), chr(10) || chr(10)) - 1)
        ELSE substr(text, 1, 5000) END || chr(10) || chr(10) || '---' || chr(10) ||
        '*Showing first ~2 pages. Click "Read all pages" to extract the full document.*' AS guess
 FROM (SELECT doc_id, x AS text, string_split(x, chr(12)) AS pages,
              ' ' || chr(9) || chr(10) || chr(13) AS w, '*(no text — may be a scanned image)*' AS e
   FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN replace(text, chr(10), chr(12))
                             ELSE replace(text, chr(10), chr(10) || chr(10)) END AS x FROM documents)))""")
def _f16(t):
    body = F.when(F.col("lang") == "en", F.replace("text", F.lit("\n"), F.lit("\x0c"))).otherwise(
        F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return t.documents.select("doc_id", text.truncate_pages(body, 2).alias("shown"))


@query("f17_cap_text", sql="""
SELECT doc_id, CASE WHEN length(text) > 4000
   THEN substr(text, 1, 4000) || chr(10) || chr(10) || '[content truncated at 500 KB]' ELSE text END AS capped
FROM documents""")
def _f17(t):
    return t.documents.select("doc_id", text.cap_text(F.col("text"), 4000).alias("capped"))


@query("f18_index_columns", sql="""
SELECT p_partkey, lower(p_brand) || ';' || p_type AS cols, 2 AS n FROM part""")
def _f18(t):
    ddl = F.concat(F.lit("CREATE INDEX ix ON part(x) USING btree ( "), F.lower("p_brand"),
                   F.lit(' , "'), F.col("p_type"), F.lit('",) WHERE true'))
    cols = sqltext.index_columns(ddl)
    return t.part.select("p_partkey", F.array_join(cols, ";").alias("cols"), F.size(cols).alias("n"))


@query("f19_file_names", sql="""
SELECT c_custkey, regexp_replace(c_name || ' é.v1', '[^A-Za-z0-9_-]', '_', 'g') AS safe,
  CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN c_name || '.CSV' ELSE c_name || '.csv' END AS named
FROM customer""")
def _f19(t):
    name = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"),
                  F.concat("c_name", F.lit(".CSV"))).otherwise(F.col("c_name"))
    return t.customer.select(
        "c_custkey", text.safe_file_name(F.concat("c_name", F.lit(" é.v1"))).alias("safe"),
        text.ensure_extension(name, "csv").alias("named"))


@query("f21_collection_names", sql="""
SELECT o_orderkey, 'ord_' || o_orderstatus || ',cust_' || o_custkey AS names FROM orders""")
def _f21(t):
    sql = F.concat(F.lit("select a from ord_"), F.col("o_orderstatus"), F.lit(" o JOIN  cust_"),
                   F.col("o_custkey"), F.lit(" c on 1=1 join ord_"), F.col("o_orderstatus"), F.lit(" p"))
    return t.orders.select("o_orderkey", F.array_join(sqltext.collection_names(sql), ",").alias("names"))


@query("f22_leading_keyword", sql="""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'WITH' WHEN 'O' THEN 'SHOW' ELSE 'SELECT' END AS keyword,
       o_orderstatus IN ('F', 'P') AS reads FROM orders""")
def _f22(t):
    word = (F.when(F.col("o_orderstatus") == "F", "with recursive x")
            .when(F.col("o_orderstatus") == "O", "Show tables").otherwise("SELECT 1"))
    sql = F.concat(F.lit("  /* "), F.col("o_orderpriority"), F.lit(" */ -- drop\n /*x*/"), word)
    return t.orders.select("o_orderkey", sqltext.leading_keyword(sql).alias("keyword"),
                           sqltext.starts_with_keyword(sql, ["SELECT", "WITH"]).alias("reads"))


@query("f23_cap_sql", sql="""
SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '…' ELSE text END AS sql_text
FROM documents""")
def _f23(t):
    return t.documents.select("doc_id", text.cap_sql(F.col("text")).alias("sql_text"))


@query("f24_day_key", sql="""
SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1""")
def _f24(t):
    return t.events.groupBy(cells.day_key(F.col("ts")).alias("day")).agg(F.count("*").alias("n"))


def _replaced(text: str, *steps: tuple[str, str]) -> str:
    """SQL that replaces patterns in turn; line feeds of a replacement are written as ``§``."""
    for pattern, by in steps:
        text = f"regexp_replace({text}, '{pattern}', replace('{by}', '§', chr(10)), 'g')"
    return text


def _named_signs(text: str) -> str:
    for name, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "''"), ("copy", "©"), ("middot", "·"), ("nbsp", " "), ("amp", "&")):
        text = f"replace({text}, '&{name};', '{sign}')"
    return text


_MARKED = _named_signs(_replaced(
    "html", (r"(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->|<![^>]*>|<title>.*?</title>", ""), (r"\s+", " "),
    *[(rf"<h{k}(?: [^>]*)?>", "§§" + "#" * k + " ") for k in range(1, 7)],
    (r'<a(?: [^>]*?)?href="([^"]*)"[^>]*>(.*?)</a>', r"[\2](\1)"), (r"<li(?: [^>]*)?>", "§- "), (r"<br */?>", "§"),
    (r"</?(?:b|strong)>", "**"), (r"</?(?:i|em)>", "*"),
    (r"</?(?:p|div|section|article|main|header|footer|nav|aside|ul|ol|table|tr|blockquote|pre|form|figure)(?: [^>]*)?>|</h[1-6]>", "§§"),
    (r"</?[a-z][^>]*>", "")))
_TITLE = _named_signs("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")


@query("f25_html_to_markdown", sql=f"""
SELECT page_id, trim(regexp_replace({_TITLE}, '\\s+', ' ', 'g')) AS title,
 regexp_replace(regexp_replace(array_to_string(list_transform(string_split(body, chr(10)), lambda l: trim(l)), chr(10)),
  '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g') AS markdown
FROM (SELECT page_id, html, {_MARKED} AS body FROM pages)""")
def _f25(t):
    """Every page as markdown."""
    return html.html_to_markdown(t.pages, parts=t.spark.sparkContext.defaultParallelism)


_VISIBLE = "regexp_replace(html, '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g')"


@query("f25_html_titles_and_links", sql=f"""
SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'),
   '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS title,
 len(regexp_extract_all(v, '<a[ >]')) AS links, len(regexp_extract_all(v, '<h[1-6][ >]')) AS headings
FROM (SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS t, {_VISIBLE} AS v FROM pages)""")
def _f25t(t):
    """What can be counted in the markup must show up in the markdown."""
    def times(pattern):
        return F.size(F.regexp_extract_all("markdown", F.lit(pattern), 0)).cast("long")

    return html.html_to_markdown(t.pages, parts=t.spark.sparkContext.defaultParallelism).select(
        "page_id", "title", times(r"\]\(").alias("links"), times(r"(?m)^#{1,6}(?: |$)").alias("headings"))
