"""Profiles, counts, schemas, previews and samples (A1-A4, T4, T5, PF6, PF7, PF9)."""

from functools import reduce

from pyspark.sql import functions as F

from cairnbook.functions.cells import type_name_col
from cairnbook.operators import preview as pv
from cairnbook.operators import copies, privacy, profile
from cairnbook.plans.registry import query
from cairnbook.session import new_dir
from cairnbook.sources import catalog

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def _txt(expr):
    return f"regexp_replace(CAST({expr} AS VARCHAR), '\\.0$', '')"


def _avg(expr):
    return _txt(f"CASE WHEN {expr} = floor({expr}) THEN {expr} ELSE round({expr}, 4) END")


def _profile_sql(table, cols, unique):
    """One SELECT per column; kinds: n number, i integer, s text, t timestamp."""
    out = []
    for name, kind in cols:
        shown = {"n": _txt, "i": lambda e: f"CAST({e} AS VARCHAR)", "s": lambda e: e,
                 "t": lambda e: f"strftime({e}, '%Y-%m-%d %H:%M:%S')"}[kind]
        number = kind in "ni"
        out.append(f"""SELECT '{name}' AS column_name,
 '{ {'n': 'DOUBLE', 'i': 'BIGINT', 's': 'VARCHAR', 't': 'TIMESTAMP'}[kind] }' AS column_type,
 count(*) AS count, CAST(round((count(*) - count({name})) * 100.0 / count(*), 2) AS DOUBLE) AS null_percentage,
 {f'count(DISTINCT {name}) AS approx_unique,' if unique else ''}
 {shown(f'min({name})')} AS min, {shown(f'max({name})')} AS max,
 {_avg(f'avg({name})') if number else 'CAST(NULL AS VARCHAR)'} AS avg,
 {_txt(f'round(stddev_samp({name}), 4)') if number else 'CAST(NULL AS VARCHAR)'} AS std FROM {table}""")
    return " UNION ALL ".join(out)


LINEITEM = [("l_orderkey", "i"), ("l_partkey", "i"), ("l_suppkey", "i"), ("l_linenumber", "i"),
            ("l_quantity", "n"), ("l_extendedprice", "n"), ("l_discount", "n"), ("l_tax", "n"),
            ("l_returnflag", "s"), ("l_linestatus", "s"), ("l_shipdate", "t")]
CUSTOMER = [("c_custkey", "i"), ("c_name", "s"), ("c_nationkey", "i"), ("c_acctbal", "n"),
            ("c_mktsegment", "s")]


@query("a1_full_profile", sql=_profile_sql("lineitem", LINEITEM, False))
def _a1(t):
    """One-pass profile of lineitem; the sketch-specific distinct count is left out here."""
    return profile.profile(t.lineitem).drop("approx_unique")


@query("a1_full_profile_exact", sql=_profile_sql("lineitem", LINEITEM, True))
def _a1x(t):
    return profile.profile(t.lineitem, exact=True)


@query("a1_profile_by_path", sql=_profile_sql("customer", CUSTOMER, True))
def _a1p(t):
    """A CSV folder profiled by its path, twice: the second time by the Parquet copy that the first one made."""
    path, cache = new_dir(t.spark, "customer-csv"), new_dir(t.spark, "copies")
    t.customer.write.option("header", "true").csv(path)
    copies.profile_path(t.spark, path, cache, "csv").count()
    return copies.profile_path(t.spark, path, cache, "csv", exact=True)


def _mask_sql():
    masked = "(SELECT c_custkey, '<redacted>' AS c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer)"
    return ("SELECT 'customer' AS table_name, * FROM (" + _profile_sql(masked, CUSTOMER, False)
            + ") UNION ALL SELECT 'lineitem', * FROM (" + _profile_sql("lineitem", LINEITEM, False) + ")")


@query("a1_masked_profile", sql=_mask_sql())
def _a1m(t):
    customer, _ = privacy.mask_personal(t.customer, extra=("c_name",))
    parts = [profile.profile(df).drop("approx_unique").select(F.lit(name).alias("table_name"), "*")
             for name, df in (("customer", customer), ("lineitem", t.lineitem))]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _a2_sql():
    top = "(SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100)"
    out = []
    for name, kind in CUSTOMER:
        v = _txt(name) if kind == "n" else f"CAST({name} AS VARCHAR)"
        num = f"avg(TRY_CAST({name} AS DOUBLE))"
        out.append(f"""SELECT '{name}' AS column_name, count(*) AS count, CAST(0 AS DOUBLE) AS null_percentage,
 count(DISTINCT {v}) AS approx_unique, min({v}) AS min, max({v}) AS max, {_avg(num)} AS avg FROM {top}""")
    return " UNION ALL ".join(out)


@query("a2_sample_profile", sql=_a2_sql())
def _a2(t):
    return profile.sample_profile(t.customer, [F.desc("c_acctbal"), F.asc("c_custkey")])


@query("a3_row_count", sql=" UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in TABLES))
def _a3(t):
    parts = [profile.row_count(getattr(t, n)).select(F.lit(n).alias("table_name"), "row_count") for n in TABLES]
    return reduce(lambda a, b: a.unionByName(b), parts)


_TYPE_CASE = """CASE WHEN column_type IN ('TINYINT','SMALLINT','INTEGER','BIGINT') THEN 'BIGINT'
 WHEN column_type IN ('FLOAT','DOUBLE') THEN 'DOUBLE'
 WHEN column_type IN ('TIMESTAMP','DATE','BOOLEAN') THEN column_type ELSE 'VARCHAR' END"""
_DESCRIBE = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, column_name, {_TYPE_CASE} AS column_type FROM (DESCRIBE {n})" for n in TABLES)


def _columns(t):
    records = catalog.scan_catalog(t.spark, t.root)
    records = records.withColumn("table_name", F.regexp_extract("relative_path", r"^([^/.]+)\.", 1))
    return catalog.schema_columns(records, ["table_name"], stored=True)


@query("a4_describe_schema", sql=_DESCRIBE)
def _a4(t):
    """Columns of all tables, from the footers that the catalog scan reads in its tasks."""
    return _columns(t).select("table_name", F.col("name").alias("column_name"), F.col("type").alias("column_type")).distinct()


@query("f20_type_names", sql=_DESCRIBE)
def _f20(t):
    """Column form of the type vocabulary, over the stored type of every column."""
    return _columns(t).select("table_name", F.col("name").alias("column_name"),
                              type_name_col(F.col("stored")).alias("column_type")).distinct()


@query("t4_preview", sql=f"""
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
 {_txt('o_totalprice')} AS o_totalprice, CAST(epoch_us(o_orderdate) AS VARCHAR) AS o_orderdate, o_orderpriority
FROM orders ORDER BY orders.o_totalprice DESC, orders.o_orderkey LIMIT 100""")
def _t4(t):
    return pv.preview(t.orders, [F.desc("o_totalprice"), F.asc("o_orderkey")])


@query("t4_preview_meta", sql="""
SELECT count(*) AS total_rows, least(count(*), 100) AS shown_rows, count(*) > 100 AS truncated FROM orders""")
def _t4m(t):
    return pv.preview_meta(t.orders)


@query("t5_sample_rows", sql="""
SELECT o_orderstatus, sample_no, '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey ||
  ',"o_orderpriority":"' || o_orderpriority || '","card_no":"<redacted>"}' AS sample
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate, o_orderkey) AS INTEGER)
        AS sample_no FROM orders) WHERE sample_no <= 5""")
def _t5(t):
    df = t.orders.withColumn("card_no", F.col("o_custkey"))
    order = [F.asc("o_orderdate"), F.asc("o_orderkey")]
    ranked = df.select("o_orderstatus", "o_orderkey", "o_custkey", "o_orderpriority", "card_no", "o_orderdate")
    return pv.sample_rows(ranked, ["o_orderstatus"], order).withColumn(
        "sample", F.regexp_replace("sample", ',"o_orderdate":"[^"]*"', ""))


@query("pf6_personal_columns", sql="""
SELECT c_custkey, col, regexp_matches(lower(col),
  'email|ssn|credit|card|cvv|phone|tel|password|passwd|token|secret|api_key|apikey|auth') AS personal
FROM (SELECT c_custkey, c_mktsegment || CASE WHEN c_nationkey < 5 THEN '_Email'
        WHEN c_nationkey < 10 THEN '_API_KEY' WHEN c_nationkey < 15 THEN '_amount' ELSE '_Hotel' END AS col
      FROM customer)""")
def _pf6(t):
    k = F.col("c_nationkey")
    name = F.concat("c_mktsegment", F.when(k < 5, "_Email").when(k < 10, "_API_KEY")
                    .when(k < 15, "_amount").otherwise("_Hotel"))
    return t.customer.select("c_custkey", name.alias("col"),
                             privacy.is_personal_col(name).alias("personal"))


@query("pf7_redaction", sql="""
SELECT c_custkey, '<redacted>' AS c_phone, c_mktsegment, '<redacted>' AS "Auth", true AS redacted FROM customer""")
def _pf7(t):
    df = t.customer.select("c_custkey", F.col("c_name").alias("c_phone"), "c_mktsegment",
                           F.col("c_acctbal").alias("Auth"))
    masked, flag = privacy.mask_personal(df)
    return masked.withColumn("redacted", F.lit(flag))


@query("pf9_any_cell_contains", sql="""
SELECT * FROM part WHERE contains(CAST(p_partkey AS VARCHAR), '77') OR contains(lower(p_name), '77')
 OR contains(lower(p_brand), '77') OR contains(lower(p_type), '77') OR contains(CAST(p_size AS VARCHAR), '77')
 OR contains(CAST(p_retailprice AS VARCHAR), '77')""")
def _pf9(t):
    return pv.any_cell_contains(t.part, "77")
