"""Guarded SQL: policy over statements, capping, and the query shapes it accepts (PF16, PF17, Q1-Q7, SO4)."""

from pyspark.sql import functions as F

from cairnbook.operators import guard, routes
from cairnbook.plans.registry import query
from cairnbook.session import new_dir


def shape(name, table, spark_sql, duck_sql=None, limit=None):
    """Register one accepted SQL shape, uncapped; ``{{file}}`` is the table on both sides."""
    @query(name, sql=(duck_sql or spark_sql).replace("{{file}}", table))
    def _run(t):
        return guard.guarded_sql(t.spark, spark_sql, getattr(t, table), limit)


def _statement(t):
    e = F.col("event_type")
    tail = F.concat(F.lit(" FROM {{file}} WHERE k = "), F.col("value").cast("decimal(12,2)"))
    body = (F.when(e == "click", F.concat(F.lit("SELECT my_read_csv_col, loader"), tail))
            .when(e == "view", F.concat(F.lit("SELECT * FROM Read_CSV \t('"), "props", F.lit("')"), tail))
            .when(e == "error", F.concat(F.lit("COPY x"), tail))
            .when(e == "signup", F.concat(F.lit("SELECT 1 FROM t"), "props"))
            .otherwise(F.concat(F.lit("SELECT glob(x), 'a'"), tail, F.lit("; ATTACH y"))))
    return t.events.select("event_id", "event_type", body.alias("sql"))


@query("pf16_file_policy", sql="""
SELECT event_id, CASE event_type WHEN 'click' THEN NULL WHEN 'view' THEN 'forbidden file-access function: read_csv'
 WHEN 'error' THEN 'forbidden keyword: COPY' WHEN 'signup' THEN 'SQL is missing the {{file}} placeholder'
 ELSE 'forbidden file-access function: glob' END AS reason FROM events""")
def _pf16(t):
    return _statement(t).select("event_id", guard.file_sql_reason(F.col("sql")).alias("reason"))


@query("pf16_db_policy", sql="""
SELECT doc_id, CASE """ + " ".join(
    f"WHEN regexp_matches(lower(text), '(^|[^a-z0-9_]){k}([^a-z0-9_]|$)') THEN 'only SELECT may reach a database, found {k}'"
    for k in guard.DB_KEYWORDS) + " END AS reason FROM (SELECT doc_id, text || CASE lang WHEN 'de' THEN ' Drop' WHEN 'fr' THEN ';exec(' WHEN 'es' THEN ' updates _call' ELSE '' END AS text FROM documents)")
def _pf16d(t):
    extra = (F.when(F.col("lang") == "de", " Drop").when(F.col("lang") == "fr", ";exec(")
             .when(F.col("lang") == "es", " updates _call").otherwise(""))
    return t.documents.select("doc_id", guard.db_sql_reason(F.concat("text", extra)).alias("reason"))


@query("pf17_row_cap", sql="SELECT least(count(*), 10000) AS row_count, count(*) > 10000 AS truncated FROM lineitem")
def _pf17(t):
    return guard.result_meta(t.lineitem, 10_000)


shape("q1_project_filter_limit", "orders",
      "SELECT o_orderkey, o_totalprice FROM {{file}} WHERE o_totalprice > 400000 ORDER BY o_orderkey LIMIT 100")
shape("q2_count", "lineitem", "SELECT COUNT(*) AS n FROM {{file}}")
shape("q3_group_order_limit", "lineitem",
      "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS qty, "
      "round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {{file}} "
      "WHERE l_shipdate <= TIMESTAMP '2001-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY revenue DESC LIMIT 10")
shape("q4_union_all", "customer",
      "SELECT c_mktsegment, count(*) AS n FROM (SELECT * FROM {{file}} UNION ALL SELECT * FROM {{file}}) u GROUP BY c_mktsegment")
shape("so4_union_all_self", "nation", "SELECT n_name FROM {{file}} UNION ALL SELECT n_name FROM {{file}} WHERE n_regionkey > 1")
shape("q5_cte_self_join", "orders",
      "WITH big AS (SELECT o_custkey, max(o_totalprice) AS top FROM {{file}} GROUP BY o_custkey) "
      "SELECT o.o_orderkey, o.o_custkey, big.top FROM {{file}} o JOIN big ON o.o_custkey = big.o_custkey AND o.o_totalprice = big.top")
shape("q5_semi_anti_join", "customer",
      "SELECT c_custkey FROM {{file}} a WHERE EXISTS (SELECT 1 FROM {{file}} b WHERE b.c_nationkey = a.c_nationkey AND b.c_acctbal > 9900) "
      "AND NOT EXISTS (SELECT 1 FROM {{file}} b WHERE b.c_nationkey = a.c_nationkey AND b.c_acctbal < -990)")
shape("q6_window_rank", "part",
      "SELECT p_partkey, p_type, rk FROM (SELECT *, CAST(rank() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC) AS BIGINT) AS rk FROM {{file}}) r WHERE rk <= 10")
shape("q6_window_frame", "orders",
      "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS BIGINT)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey "
      "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS run FROM (SELECT o_orderkey, o_custkey, o_orderdate, floor(o_totalprice) AS o_totalprice FROM {{file}}) s")
shape("q6_distinct", "lineitem", "SELECT DISTINCT l_suppkey, l_returnflag FROM {{file}}")
shape("q6_grouping_sets", "orders",
      "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {{file}} GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())")
shape("q6_rollup", "customer", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM {{file}} GROUP BY ROLLUP (c_mktsegment, c_nationkey)")
shape("q6_cube", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {{file}} GROUP BY CUBE (l_returnflag, l_linestatus)")
shape("q6_intersect", "lineitem",
      "SELECT l_partkey FROM {{file}} WHERE l_returnflag = 'A' INTERSECT SELECT l_partkey FROM {{file}} WHERE l_returnflag = 'N'")
shape("q6_except", "lineitem",
      "SELECT l_partkey FROM {{file}} WHERE l_quantity < 10 EXCEPT SELECT l_partkey FROM {{file}} WHERE l_quantity > 45")
shape("q6_scalar_functions", "customer",
      "SELECT c_custkey, upper(substring(c_name, 1, 4)) AS s, length(c_mktsegment) AS n, abs(c_nationkey - 10) AS d, "
      "round(c_acctbal, 1) AS r, coalesce(nullif(c_mktsegment, 'BUILDING'), '-') AS seg FROM {{file}}")
shape("q6_json_functions", "events",
      "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, date_format(ts, 'yyyy-MM') AS m FROM {{file}}",
      "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m') AS m FROM {{file}}")


@query("q7_bound_address", sql="SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def _q7(t):
    """A reader call on an address becomes the placeholder and is bound to that table."""
    address = t.path("lineitem")
    sql = guard.bind_address(f"SELECT l_returnflag, count(*) AS n FROM read_parquet('{address}', x=1) GROUP BY 1", address)
    return guard.guarded_sql(t.spark, sql, t.spark.read.parquet(address))


@query("q7_local_address", sql="SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def _q7l(t):
    """The same table by a ``local://`` address below the second of two roots."""
    address = "local://me/lineitem.parquet#1"
    return routes.run(t.spark, f"SELECT l_returnflag, count(*) AS n FROM read_parquet('{address}') GROUP BY 1", address,
                      roots=[new_dir(t.spark, "other-root"), t.root], agent="me")


@query("q7_text_address", sql="SELECT c_mktsegment, count(*) AS n, CAST(sum(c_nationkey) AS BIGINT) AS nations FROM customer GROUP BY 1")
def _q7t(t):
    """A CSV folder by a ``local://`` address with an encoded name, read by its Parquet copy."""
    root = new_dir(t.spark, "text-root")
    t.customer.write.option("header", "true").csv(f"{root}/my customers.csv")
    address = "local://me/my%20customers.csv"
    return routes.run(t.spark, "SELECT c_mktsegment, count(*) AS n, CAST(sum(c_nationkey) AS BIGINT) AS nations FROM {{file}} GROUP BY 1",
                      address, roots=[root], agent="me", cache=new_dir(t.spark, "text-copies"))


@query("pf16_spark_policy", sql="""
SELECT event_id, CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN 'not a SELECT' WHEN 2 THEN 'file address' WHEN 3 THEN 'forbidden function'
 WHEN 4 THEN 'runs a script' WHEN 5 THEN 'names a table other than {{file}}' WHEN 6 THEN 'names a table other than {{file}}'
 ELSE NULL END AS reason FROM events""")
def _pf16s(t):
    """What Spark could do from inside a statement: one shape of statement per row, with the row's own values in it."""
    k, kind = F.col("value").cast("decimal(12,2)").cast("string"), F.col("event_id") % 8
    tail = F.concat(F.lit(" WHERE k > "), k)
    shapes = ["SELECT trim(both 'x' from event_type) FROM {{file}}", "INSERT OVERWRITE DIRECTORY '/tmp/x' USING parquet SELECT * FROM {{file}}",
              "SELECT k FROM {{file}} UNION ALL SELECT k FROM `parquet`.`/tmp/x`", "SELECT `java_method`('a', 'b') FROM {{file}}",
              "SELECT TRANSFORM(a) USING 'cat' FROM {{file}}", "SELECT * FROM {{file}} f JOIN other o USING (k)",
              "WITH c AS (SELECT k FROM {{file}}) SELECT * FROM c, other", "WITH c AS (SELECT k FROM {{file}}) SELECT * FROM c"]
    body = F.element_at(F.array(*[F.lit(s) for s in shapes]), (kind + 1).cast("int"))
    return t.events.select("event_id", guard.file_sql_reason(F.concat(body, tail)).alias("reason"))


@query("pf17_whole_result", sql="SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 0")
def _pf17w(t):
    """A guarded result of any size comes back whole."""
    return guard.guarded_sql(t.spark, "SELECT l_orderkey, l_linenumber FROM {{file}} WHERE l_quantity > 0", t.lineitem)
