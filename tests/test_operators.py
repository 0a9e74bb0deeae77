"""Operators on small cases and against plain-Python models."""

import os
import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cairnbook.operators import (dbcatalog, drift, guard, incremental, logs, numbering, paths, preview, privacy,
                                 profile, relations, search, sessions, sinks)
from cairnbook.operators import routes
from cairnbook.session import new_dir
from cairnbook.sources import readers

COL = "array<struct<name:string,type:string>>"


def cols(spark, rows):
    return spark.createDataFrame(rows, "ds string, name string, type string")


def changes(spark, old, new):
    out = drift.in_display_order(drift.schema_diff(
        cols(spark, [("d", *c) for c in old]), cols(spark, [("d", *c) for c in new]), ["ds"]), ["ds"])
    return [(r.kind, r.name, r.old_type, r.new_type) for r in out.collect()]


def test_schema_diff_cases(spark):
    assert changes(spark, [("a", "INTEGER")], [("a", "INTEGER")]) == []
    assert changes(spark, [("a", "INTEGER"), ("b", "VARCHAR")], [("b", "VARCHAR"), ("a", "INTEGER")]) == []
    assert changes(spark, [], [("b", "X"), ("a", "X")]) == [("Added", "a", None, "X"), ("Added", "b", None, "X")]
    assert changes(spark, [("id", "INTEGER"), ("old", "X")], [("id", "BIGINT"), ("new", "X")]) == [
        ("Added", "new", None, "X"), ("Removed", "old", "X", None), ("TypeChanged", "id", "INTEGER", "BIGINT")]
    assert changes(spark, [("Name", "X")], [("name", "X")]) == [("Added", "name", None, "X"), ("Removed", "Name", "X", None)]


def test_schema_diff_random(spark):
    rng = random.Random(7)
    old, new, expected = [], [], set()
    for d in range(60):
        names = [f"c{i}" for i in range(8)] + ["C1", "c 1", "`q`"]
        o = {n: rng.choice("XYZ") for n in names if rng.random() < 0.6}
        n = {n: rng.choice("XYZ") for n in names if rng.random() < 0.6}
        old += [(str(d), k, v) for k, v in o.items()]
        new += [(str(d), k, v) for k, v in n.items()]
        expected |= {(str(d), "Added", k, None, v) for k, v in n.items() if k not in o}
        expected |= {(str(d), "Removed", k, v, None) for k, v in o.items() if k not in n}
        expected |= {(str(d), "TypeChanged", k, o[k], n[k]) for k in o if k in n and o[k] != n[k]}
    got = drift.schema_diff(cols(spark, old), cols(spark, new), ["ds"])
    assert {tuple(r) for r in got.collect()} == expected
    counts = {r.ds: (r.added, r.removed, r.type_changed) for r in drift.change_counts(got, ["ds"]).collect()}
    for d in {e[0] for e in expected}:
        assert counts[d] == tuple(sum(e[0] == d and e[1] == k for e in expected) for k in ("Added", "Removed", "TypeChanged"))


def test_schema_json_inputs(spark):
    df = spark.createDataFrame([
        ("a", '[{"name":"x","type":"INTEGER","nullable":true}]'), ("b", None), ("c", ""), ("d", "null"), ("e", "not json"),
        ("f", '[{"name":"x"}]'), ("g", "[]")], "ds string, schema_json string")
    assert [tuple(r) for r in drift.parse_schema(df, ["ds"]).collect()] == [("a", "x", "INTEGER")]


def test_catalog_drift_ignores_first_sight(spark):
    def rec(ds, *names):
        return (ds, "[" + ",".join(f'{{"name":"{n}","type":"T"}}' for n in names) + "]")

    catalog = spark.createDataFrame([rec("a", "x"), rec("gone", "x")], "ds string, schema_json string")
    scanned = spark.createDataFrame([rec("a", "x", "y"), rec("fresh", "q")], "ds string, schema_json string")
    assert [(r.ds, r.kind, r.name) for r in drift.catalog_drift(catalog, scanned, ["ds"]).collect()] == [("a", "Added", "y")]


def test_drift_messages(spark):
    df = spark.createDataFrame([
        ('{"workspace_id":"w","dataset_path":"/d/x.csv","drift":{"added":["a",null],"changed":["c"]}}',),
        ('{"dataset_path":"p","dataset_name":"N","origin_agent_name":"laptop","drift":{"removed":["r"]}}',),
        ('{"dataset_path":"p"}',)], "message string")
    rows = {(r.dataset_name, r.kind, r.name, r.old_type, r.new_type) for r in drift.drift_messages(df).collect()}
    assert rows == {("x.csv (from another machine)", "Added", "a", None, "unknown"),
                    ("x.csv (from another machine)", "TypeChanged", "c", "unknown", "unknown"),
                    ("N (from laptop)", "Removed", "r", "unknown", None)}


def test_manifest_diff(spark):
    def man(rows):
        return spark.createDataFrame(rows, "key string, size_bytes long, mtime_marker string")

    old = man([("same", 1, "1"), ("size", 1, "1"), ("mark", 1, "01"), ("gone", 1, "1"), ("nul", None, None)])
    new = man([("same", 1, "1"), ("size", 2, "1"), ("mark", 1, "1"), ("fresh", 1, "1"), ("nul", None, None)])
    assert {tuple(r) for r in incremental.manifest_diff(old, new).collect()} == {
        ("same", "unchanged"), ("size", "changed"), ("mark", "changed"), ("gone", "removed"), ("fresh", "new"), ("nul", "unchanged")}
    assert incremental.manifest_diff(old, old).where("change <> 'unchanged'").count() == 0
    kept, dropped = incremental.drop_missing(old, new)
    assert kept.count() == 4 and [r.key for r in dropped.collect()] == ["gone"]


def test_freshness(spark):
    listing = spark.createDataFrame([("a", 1, 1, False), ("b", 2, 1, False), ("c", 1, 1, False), ("d", 1, 1, True), ("e", 1, 1, True)],
                                    "key string, mtime long, size_bytes long, doc boolean")
    cache = spark.createDataFrame([("a", 1, 1, False), ("b", 1, 1, False), ("d", 1, 1, False), ("e", 1, 1, True)],
                                  "key string, mtime long, size_bytes long, has_text boolean")
    out = incremental.freshness(listing, cache, ["key"], F.col("doc"), "has_text")
    assert {r.key: r.state for r in out.collect()} == {"a": "hit", "b": "stale", "c": "miss", "d": "miss", "e": "hit"}


def test_relations(spark):
    ds = spark.createDataFrame([("1", "users.csv"), ("2", "Order.parquet"), ("3", "items.xlsx"), ("4", "status")], "id string, name string")
    cs = spark.createDataFrame([("1", "ID"), ("2", "id"), ("2", "user_id"), ("3", "order_id"), ("3", "orders_id"), ("3", "_id"),
                                ("3", "status_id"), ("4", "code")], "id string, name string")
    found = {(r.source_id, r.source_column, r.target_id, r.confidence) for r in relations.name_relations(ds, cs).collect()}
    assert found == {("2", "user_id", "1", 60), ("3", "order_id", "2", 60), ("3", "orders_id", "2", 60)}


def test_join_patterns(spark, one):
    def pats(sql, strict=True):
        return [tuple(j) for j in one(lambda x: relations.join_patterns(x, strict), [sql])[0]]

    assert pats("SELECT * FROM users") == []
    assert pats("select * from orders o JOIN users AS u ON o.user_id = u.id") == [("o", "users", "user_id", "id")]
    assert pats("select * from a join b x on a.i=x.i join c y on y.k = x.k") == [("a", "b", "i", "i"), ("c", "x", "k", "k")]
    assert pats("select * from a join b on a.i = b.i") == []
    assert pats("select * from a join b on a.i = b.i", strict=False) == [("a", "b", "i", "i")]


def test_edge_merge(spark):
    def merged(*edges):
        df = spark.createDataFrame([("s", "t", "a", "b", c, m, i) for i, (c, m) in enumerate(edges)],
                                   "source_id string, target_id string, source_column string, target_column string, confidence int, method string, seq int")
        return [(r.confidence, r.method) for r in relations.merge_edges(df).collect()]

    name, hist = (60, "schema_fk_pattern"), (80, "query_history_join")
    assert merged(name) == [name]
    assert merged(name, hist) == [(80, "query_history_join+schema")]
    assert merged(hist, name) == [(100, "query_history_join")]
    assert merged(hist, hist, hist) == [(100, "query_history_join+schema")]


def test_history_relations_end_to_end(spark):
    ds = spark.createDataFrame([("1", "users"), ("2", "orders")], "id string, name string")
    cs = spark.createDataFrame([("1", "id"), ("2", "user_id")], "id string, name string")
    sql = "select * from orders join users u on orders.user_id = u.id"
    hist = spark.createDataFrame([(sql, "success")] * 5 + [(sql, "error")], "sql string, status string")
    assert [tuple(r) for r in relations.detect(ds, cs, hist).collect()] == [
        ("2", "1", "user_id", "id", 100, "query_history_join+schema")]


def test_search_scores(spark):
    rows = [("r", "sales.csv", [("amount", "D")], None), ("r", "2024/sales_q1.csv", None, None), ("r", "my_sales.csv", None, None),
            ("r", "sales/x.csv", None, None), ("r", "c.csv", [("id", "I"), ("sales_total", "D"), ("sales", "D")], None),
            ("r", "doc.txt", None, "All about SALES\nhere"), ("r", "none.csv", [("x", "I")], "nothing")]
    df = spark.createDataFrame(rows, f"folder_path string, relative_path string, schema {COL}, text string")
    got = {r.relative_path: (r.score, r.match_column, r.snippet) for r in search.search(df, " Sales ").collect()}
    assert got == {"sales.csv": (95, None, None), "2024/sales_q1.csv": (95, None, None), "my_sales.csv": (75, None, None),
                   "sales/x.csv": (40, None, None), "c.csv": (95, "sales", None), "doc.txt": (50, None, "All about SALES here")}
    assert search.search(df, "sales.csv").first().score == 120
    assert search.search(df, "  ").count() == 0
    skipped = spark.createDataFrame([("Sales.MP4", None, "too_large"), ("x.mp4", 1, "native")], "name string, size_bytes long, reason string")
    top = search.search_everything(df, skipped, "sales").collect()
    assert [(r.relative_path, r.score) for r in top if r.folder_path == ""] == [("Sales.MP4", 75)]


def test_catalog_search_is_literal(spark):
    df = spark.createDataFrame([("1", "w", "100% done", "p", None, None), ("2", "w", "1000 done", "p", "x", ["t_1"])],
                               "id string, workspace_id string, name string, path string, description string, tags array<string>")
    assert [r.id for r in search.search_catalog(df, "100%", 10, "w").collect()] == ["1"]
    assert [(r.id, r.score) for r in search.search_catalog(df, "T_", 10, "w").collect()] == [("2", 40)]


ALLOWED = ["SELECT * FROM {{file}}", "select my_read_csv, loaded, copyright from {{file}}", "SELECT count(*) FROM {{file}} a JOIN {{file}} b USING (x)",
           "select glob from {{file}}", "select importance, exporter from {{file}}"]
REFUSED = {"SELECT 1": "placeholder", "SELECT * FROM {{file}}, read_parquet('x')": "read_parquet", "SELECT * FROM {{file}}, READ_CSV_AUTO ('x')": "read_csv_auto",
           "ATTACH 'x'; SELECT * FROM {{file}}": "ATTACH", "copy {{file}} to 'x'": "COPY", "INSTALL httpfs; {{file}}": "INSTALL", "PRAGMA x; {{file}}": "PRAGMA",
           "select glob\n('*') from {{file}}": "glob", "load x {{file}}": "LOAD"}


def test_guard(spark, one):
    for sql in ALLOWED:
        assert guard.check_file_sql(sql) is None
    for sql, word in REFUSED.items():
        assert word in guard.check_file_sql(sql)
    assert one(guard.file_sql_reason, ALLOWED) == [None] * len(ALLOWED)
    assert one(guard.file_sql_reason, list(REFUSED)) == [guard.check_file_sql(s) for s in REFUSED]
    assert guard.check_db_sql("select updated_at, dropped from t") is None
    assert "drop" in guard.check_db_sql("DROP table t")
    assert guard.check_file_sql("select * from {{file}} join csv.`/etc/x`") and guard.check_file_sql("select java_method('a') from {{file}}")


def test_guarded_sql(spark):
    df = spark.range(10)
    assert guard.guarded_sql(spark, "SELECT id, '{x}' AS s FROM {{file}} WHERE id > 4 ORDER BY id;", df, 3).collect() == [
        (5, "{x}"), (6, "{x}"), (7, "{x}")]
    with pytest.raises(ValueError):
        guard.guarded_sql(spark, "SELECT 1", df)
    assert guard.bind_address("select * from read_csv_auto('local://a/b.csv', header=true) x", "local://a/b.csv") == "select * from {{file}} x"
    assert guard.with_timeout(spark, df.count, 60) == 10
    meta = guard.result_meta(df, 4).first()
    assert (meta.row_count, meta.truncated) == (4, True)


WRITES = ["INSERT OVERWRITE DIRECTORY '%s' USING parquet SELECT * FROM {{file}}", "SELECT id FROM {{file}} UNION ALL SELECT id FROM `parquet`.`%s`",
          "SELECT `java_method`('java.lang.System', 'gc') FROM {{file}}", "SELECT TRANSFORM(id) USING 'touch %s/t' AS (a) FROM {{file}}",
          "SELECT * FROM {{file}} a JOIN other o ON a.id = o.id", "CREATE TABLE z AS SELECT * FROM {{file}}", "DROP VIEW other -- {{file}}",
          "SELECT * FROM {{file}}, other", "SELECT * FROM {{file}} JOIN parquet/**/.`%s`", "SELECT (SELECT max(id) FROM other) FROM {{file}}",
          "WITH a AS (SELECT * FROM other) SELECT * FROM {{file}}, a", "FROM {{file}} INSERT INTO t SELECT *", "SELECT * FROM range(5), {{file}}",
          "SELECT 1 FROM {{file}}; DROP VIEW other", "TABLE other UNION ALL SELECT * FROM {{file}}"]
READS = ["SELECT trim(both ' ' from 'x') AS a FROM {{file}}", "SELECT extract(year from current_date()) AS a FROM {{file}}",
         "WITH a AS (SELECT * FROM {{file}}), b(x) AS (SELECT id FROM a) SELECT b.x FROM b JOIN a ON b.x = a.id",
         "SELECT t.id FROM (SELECT id FROM {{file}}) t, {{file}} u", "SELECT 'from other' AS s FROM {{file}} -- join other",
         "SELECT c FROM {{file}} LATERAL VIEW explode(array(1)) t AS c"]


def test_guard_refuses_what_is_no_select_of_the_bound_table(spark, one, tmp_path):
    kept = tmp_path / "kept"
    kept.mkdir()
    (kept / "a.txt").write_text("mine")
    spark.range(3).createOrReplaceTempView("other")
    df, bad = spark.range(10), [s.replace("%s", str(kept)) for s in WRITES]
    for sql in bad:
        with pytest.raises(ValueError):
            guard.guarded_sql(spark, sql, df)
    assert all(one(guard.file_sql_reason, bad)) and (kept / "a.txt").read_text() == "mine" and len(list(kept.iterdir())) == 1
    assert one(guard.file_sql_reason, READS) == [None] * len(READS) == [guard.check_file_sql(s) for s in READS]
    for sql in READS:
        assert guard.guarded_sql(spark, sql, df).count() >= 10
    # The plan alone refuses them, too, whatever the words look like.
    named = [s.replace("{{file}}", "bound_table") for s in bad if ";" not in s]
    assert all(guard.plan_reason(spark, s) for s in named)


BRACKETS = ["SELECT * FROM {{file}} f JOIN (bound_table) b ON f.id = b.id", "SELECT (SELECT max(id) FROM(bound_table)) FROM {{file}}",
            "SELECT * FROM {{file}} f JOIN ( (other) ) o ON f.id = o.id", "SELECT * FROM (other JOIN {{file}} USING (id))", "SELECT * FROM (\nother) x, {{file}}",
            "SELECT * FROM {{file}}, (other) o", "SELECT * FROM bound_table, {{file}}"]
BRACKET_READS = ["SELECT id FROM ({{file}})", "SELECT a.id FROM ({{file}} a JOIN ({{file}}) b ON a.id = b.id)", "SELECT * FROM ((SELECT id FROM {{file}}))",
                 "SELECT * FROM (VALUES (1)) v CROSS JOIN {{file}}"]


def test_no_name_in_brackets_reaches_another_table(spark, one):
    spark.range(3).createOrReplaceTempView("other")
    spark.range(100, 103).createOrReplaceTempView("bound_table")
    df = spark.range(10)
    try:
        for sql in BRACKETS:
            with pytest.raises(ValueError):
                guard.guarded_sql(spark, sql, df)
        # Words alone find all but a bracket behind a comma, which is also how arguments look.
        assert [w is None for w in one(guard.file_sql_reason, BRACKETS)] == [guard.check_file_sql(s) is None for s in BRACKETS] == [False] * 5 + [True, False]
        for sql in BRACKET_READS:
            assert guard.check_file_sql(sql) is None and guard.guarded_sql(spark, sql, df).count() == 10, sql
        assert one(guard.file_sql_reason, BRACKET_READS) == [None] * len(BRACKET_READS)
    finally:
        spark.catalog.dropTempView("bound_table")


def test_texts_and_comments_keep_the_placeholder(spark):
    df = spark.range(2)
    sql = """SELECT id, '{{file}} {x}' AS a, "it''s {{file}}" AS b /* {{file}} */ FROM {{file}} AS `t{}` -- '{{file}}"""
    assert [tuple(r) for r in guard.guarded_sql(spark, sql, df).orderBy("id").collect()] == [(i, "{{file}} {x}", "it''s {{file}}") for i in (0, 1)]
    with pytest.raises(ValueError):
        guard.guarded_sql(spark, "SELECT * FROM `{{file}}`", df)


def test_routes(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    two.mkdir()
    (two / "a b.csv").write_text("id,v\n1,x\n2,y\n")
    (tmp_path / "secret.csv").write_text("id\n1\n")
    said = dict(roots=[str(one), f"{two}/"], agent="me", cache=str(tmp_path / "cache"))
    assert routes.route("local://me/a/b") == ("local", "me/a/b") and routes.route("db://x") == ("db", "x") and routes.route("/a") == ("path", "/a")
    for sql in ("SELECT count(*) AS n FROM read_csv_auto('local://me/a%20b.csv#S')", "SELECT count(*) AS n FROM {{file}}"):
        address = "local://me/a%20b.csv#S" if "read_" in sql else "local://me/a%20b.csv"
        assert routes.run(spark, sql, address, **said).first().n == 2
    assert routes.run(spark, "SELECT v FROM {{file}} WHERE id = 2", f"local://me{two}/a b.csv", **said).first().v == "y"
    assert routes.shown(spark, "SELECT id FROM {{file}} ORDER BY id", "local://me/a b.csv", rows=1, **said) == ([(1,)], True)
    for address, why in (("local://me", "bad-format"), ("local://me/", "bad-format"), ("local://you/a b.csv", "mismatch"), ("local://me/gone.csv", "not-found"),
                         ("local://me/../secret.csv", "not-found"), (f"local://me{tmp_path}/secret.csv", "not-found"), ("db://none", "no-database")):
        with pytest.raises(routes.AddressError) as told:
            routes.run(spark, "SELECT * FROM {{file}}", address, **said)
        assert told.value.why == why
    with pytest.raises(routes.AddressError) as told:
        routes.run(spark, "SELECT * FROM {{file}}", "local://me/gone.csv", **said)
    assert told.value.places == ["/gone.csv", f"{one}/gone.csv", f"{two}/gone.csv"]
    with pytest.raises(ValueError, match="only SELECT"):
        routes.run(spark, "DROP TABLE x", "db://d", databases={"d": readers.JdbcSource("sqlite", "jdbc:sqlite::memory:")})
    with pytest.raises(ValueError, match="COPY"):
        routes.run(spark, "COPY {{file}} TO 'x'", "local://me/gone.csv", **said)  # refused before anything is opened
    began = time.monotonic()
    with pytest.raises(TimeoutError):  # the limit holds for all jobs of a run, also for those that start later
        routes.shown(spark, "SELECT id FROM {{file}}", "local://me/a b.csv", seconds=0.3,
                     act=lambda df: [spark.range(1 << 44).agg(F.max(F.sqrt("id"))).collect() for _ in range(2)], **said)
    assert time.monotonic() - began < 30


def test_shown_rows_say_whether_there_are_more(spark):
    rows, more = guard.shown(spark.range(10), 4)
    assert len(rows) == 4 and more and guard.shown(spark.range(4), 4)[1] is False


def test_owning_root_against_brute_force(spark):
    rng = random.Random(3)
    names = ["/".join(rng.choice(["", "a", "ab", "b", "data"]) for _ in range(rng.randint(1, 5))) for _ in range(300)]
    roots = sorted({n[:rng.randint(1, len(n))] for n in names if n and rng.random() < 0.2})
    rng.shuffle(roots)
    p = spark.createDataFrame([(n,) for n in names], "path string")
    r = spark.createDataFrame(list(zip(roots, range(len(roots)))), "root string, order int")
    got = {x.path: x.root for x in paths.owning_root(p, r).collect()}
    assert got == {n: next((q for q in roots if n.startswith(q)), None) for n in set(names)}

    def inside(n, q):
        q = q.rstrip("/")
        return n == q or n.startswith(q + "/")

    absolute = [("/" + n.strip("/").replace("//", "/")) for n in names]
    top = ["/a", "/data/", "/ab/b"]
    p2 = spark.createDataFrame([(n,) for n in absolute], "path string")
    r2 = spark.createDataFrame(list(zip(top, range(3))), "root string, order int")
    got = {x.path for x in paths.allowed(p2, r2).collect()}
    assert got == {n for n in absolute if any(inside(n, q) for q in top)}
    by_part = {x.path: x.root for x in paths.owning_root(p2, r2, components=True).collect()}
    assert {n for n, q in by_part.items() if q} == got


def test_roots_of_paths_over_many_partitions(spark):
    """A root that owns everything, nested and equal roots, roots beyond all paths, odd characters; every partition looks back."""
    rng = random.Random(12)
    parts = ["a", "ab", "b", "é", "日本", "a b", "", "z", "\U0001f600"]
    names = list({"/".join(rng.choices(parts, k=rng.randint(0, 5))) for _ in range(900)}) + [None, "/", "//", "/a/"]
    tops = [("", 90), ("a", 5), ("a", 3), ("ab/", 2), ("é/日", 1), ("/", 50), ("/a", 60), ("zz", 0), (None, -1), ("b/a b/z", 0), ("/a/", 61), ("\U0001f600", 4)]
    p, r = spark.createDataFrame([(n,) for n in names], "path string"), spark.createDataFrame(tops, "root string, order int")
    plain = {n: min(((o, q) for q, o in tops if q is not None and n is not None and n.startswith(q)), default=(0, None))[1] for n in names}
    held = spark.conf.get("spark.sql.shuffle.partitions")
    for many in (held, "37"):
        spark.conf.set("spark.sql.shuffle.partitions", many)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = paths.owning_root(p, r)
        assert {x.path: x.root for x in got.collect()} == plain and got.count() == len(set(names))
        assert {x.path: x.root for x in paths.owning_root(p, r.where("root = 'nothing'")).collect()} == dict.fromkeys(names)
    spark.conf.set("spark.sql.shuffle.partitions", held)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert paths.owning_root(p.limit(0), r).count() == 0

    def inside(n, q):
        n, q = n.rstrip("/"), q.rstrip("/")
        return (n == "" or n[:1] == "/") if q == "" else n == q or n.startswith(q + "/")

    want = {n: min(((o, q) for q, o in tops if q is not None and n is not None and inside(n, q)), default=(0, None))[1] for n in names}
    got = {x.path: x.root for x in paths.owning_root(p, r, components=True).collect()}
    assert got == want and {x.path for x in paths.allowed(p, r).collect()} == {n for n, q in want.items() if q is not None}


def test_resolve_addresses(spark):
    roots = spark.createDataFrame([("/w/one", 0), ("/w/two/", 1)], "root string, order int")
    files = spark.createDataFrame([("/w/one/a b.csv",), ("/w/two/a b.csv",), ("/abs/x.csv",), ("/w/two/s/y.xlsx",)], "file string")
    asked = ["local://me/a%20b.csv", "local://me/abs/x.csv", "local://me/s/y.xlsx#Sheet1", "local://you/a", "local://me", "/plain", "local://me/gone.csv"]
    df = spark.createDataFrame([(a,) for a in asked], "address string")
    got = {r.address: (r.file, r.error, r.tried) for r in paths.resolve_addresses(df, roots, files, "me").collect()}
    assert got == {asked[0]: ("/w/one/a b.csv", None, None), asked[1]: ("/abs/x.csv", None, None), asked[2]: ("/w/two/s/y.xlsx", None, None),
                   asked[3]: (None, "mismatch", None), asked[4]: (None, "bad-format", None), asked[5]: (None, "bad-format", None),
                   asked[6]: (None, "not-found", 2)}
    assert {r.error for r in paths.resolve_addresses(df, roots, files, None).collect()} == {"no-agent", "bad-format"}


def test_upsert_against_sequential_model(spark):
    rng = random.Random(11)
    base = [(f"i{i}", "w", f"p{i}", i) for i in range(40)]
    ups = [(k, f"i{rng.randint(0, 60)}", "w", f"p{rng.randint(0, 60)}", 1000 + k) for k in range(150)]
    rows = list(base)
    for _, i, w, p, v in ups:
        rows = [r for r in rows if r[0] != i and (r[1], r[2]) != (w, p)] + [(i, w, p, v)]
    got = sinks.upsert_catalog(
        spark.createDataFrame(base, "id string, workspace_id string, path string, v int"),
        spark.createDataFrame(ups, "seq int, id string, workspace_id string, path string, v int"), "seq")
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    again = sinks.upsert_catalog(got, spark.createDataFrame(ups, "seq int, id string, workspace_id string, path string, v int"), "seq")
    assert sorted(map(tuple, again.collect())) == sorted(rows)


def test_cache_get(spark):
    schema = "key string, mtime long, size_bytes long"
    wanted = spark.createDataFrame([("a", 1, 1), ("b", 2, 1), ("c", 1, 1), ("d", 1, 1)], schema)
    cache = spark.createDataFrame([("a", 1, 1, '{"n": 1}'), ("b", 1, 1, '{"n": 2}'), ("c", 1, 1, "{broken")], schema + ", payload_json string")
    got = {r.key: (r.hit, r.payload.n if r.payload else None) for r in sinks.cache_get(wanted, cache, ["key"], "n int").collect()}
    assert got == {"a": (True, 1), "b": (False, None), "c": (False, None), "d": (False, None)}


def test_delete_and_publish(spark):
    df = spark.createDataFrame([("/a",), ("/a/x",), ("/ab",), ("/b",)], "path string")
    assert {r.path for r in sinks.delete_under(df, "/a").collect()} == {"/ab", "/b"}
    assert {r.path for r in sinks.delete_under(df, "/a", sibling_safe=False).collect()} == {"/b"}
    rec = spark.createDataFrame([("k/a.csv", "t"), ("s3://o/b.csv", None)], "relative_path string, document_text string")
    assert [tuple(r) for r in sinks.publish_view(rec, "s3://b/p/").collect()] == [("s3://b/p/k/a.csv", None), ("s3://o/b.csv", None)]
    assert sinks.publish_view(rec, "/Users/x/", include_text=True).first() == ("Users/x/k/a.csv", "t")


def test_register_sources_is_idempotent(spark):
    old = spark.createDataFrame([("a", "/x", 0), ("b", "/y", 4)], "id string, address string, sort_order long")
    offer = spark.createDataFrame([("c", "/x", 0), ("d", "/z", 1), ("e", "/z", 2), ("f", None, 3), ("g", None, 4)], "id string, address string, seq long")
    once = sinks.register_sources(old, offer)
    assert sorted((r.id, r.sort_order) for r in once.collect()) == [("a", 0), ("b", 4), ("d", 5), ("f", 6), ("g", 7)]
    addressed = offer.where("address IS NOT NULL")
    assert sinks.register_sources(once, addressed).count() == once.count()
    first = sinks.register_sources(old.limit(0), addressed)
    assert sorted(r.sort_order for r in first.collect()) == [0, 1]


def test_snapshots(spark):
    base = new_dir(spark, "snap")
    assert sinks.read_snapshot(spark, base) is None
    for n in (1, 2, 3):
        sinks.commit_snapshot(spark.range(n), base)
        assert sinks.read_snapshot(spark, base).count() == n


def test_two_writers_lose_nothing(spark, tmp_path):
    base = str(tmp_path / "both")
    sinks.commit_snapshot(spark.range(1), base)
    other = []

    def make(stored):
        if not other:  # meanwhile another writer commits
            other.append(sinks.update_snapshot(spark, base, lambda now: now.unionByName(spark.range(10, 11))))
        return stored.unionByName(spark.range(20, 21))

    sinks.update_snapshot(spark, base, make, "mine")
    assert sorted(r.id for r in sinks.read_snapshot(spark, base).collect()) == [0, 10, 20]
    with pytest.raises(sinks.SnapshotConflict):
        sinks.commit_snapshot(spark.range(5), base, based_on=1)
    assert len([p for p in os.listdir(base) if p.startswith("snapshot-")]) == 3
    assert sinks.has_tag(spark, base, "mine") and not sinks.has_tag(spark, base, "other")
    sinks.commit_snapshot(spark.range(2), base, max_age_seconds=0)
    assert len([p for p in os.listdir(base) if p.startswith("snapshot-")]) == 2


def test_a_replayed_batch_commits_nothing(spark, tmp_path):
    from cairnbook.streaming import jobs
    inbox, base = str(tmp_path / "in"), str(tmp_path / "table")
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string").coalesce(1).write.parquet(inbox)

    def stream():
        return spark.readStream.schema("k long, v string").parquet(inbox)

    jobs.upsert_stream(stream(), base, ["k"], str(tmp_path / "ck"), "append")
    first = sorted(map(tuple, sinks.read_snapshot(spark, base).collect()))
    assert first == [(1, "b"), (2, "c")] and len([p for p in os.listdir(base) if p.startswith("snapshot-")]) == 1
    for name in ("0", ".0.crc"):  # as if the run had died after its commit to the table
        os.remove(str(tmp_path / "ck" / "commits" / name))
    jobs.upsert_stream(stream(), base, ["k"], str(tmp_path / "ck"), "append")
    assert len([p for p in os.listdir(base) if p.startswith("snapshot-")]) == 1


def test_import(spark):
    cur = spark.createDataFrame([("/a", 1), ("/b", 1)], "path string, v int")
    imp = spark.createDataFrame([("/b", 2), ("/c", 2)], "path string, v int")
    merged, n = sinks.import_folders(cur, imp, "merge")
    assert sorted(map(tuple, merged.collect())) == [("/a", 1), ("/b", 1), ("/c", 2)] and tuple(n.first()) == (1, 1, 0)
    over, n = sinks.import_folders(cur, imp, "overwrite")
    assert sorted(map(tuple, over.collect())) == [("/b", 2), ("/c", 2)] and tuple(n.first()) == (2, 0, 2)
    bundle = sinks.export_bundle(cur, imp, cur.withColumn("timestamp", F.lit(1)), "w1")
    assert [r.warning for r in sinks.import_warnings(bundle, "w1").collect()] == []
    assert "workspace" in sinks.import_warnings(bundle, "w2").first().warning


def test_number_rows_and_renumber(spark):
    df = spark.range(1000).withColumn("k", F.hash("id"))
    got = numbering.number_rows(df, [F.asc("k"), F.asc("id")]).orderBy("row_no").collect()
    assert [r.row_no for r in got] == list(range(1000)) and [r.k for r in got] == sorted(r.k for r in got)
    items = spark.createDataFrame([("a", 3), ("b", 1), ("c", 2), ("d", 0)], "id string, sort_order int")
    listed = spark.createDataFrame([("c", 0), ("a", 1)], "id string, position int")
    assert {r.id: r.sort_order for r in numbering.renumber(items, listed).collect()} == {"c": 0, "a": 1, "d": 2, "b": 3}
    with pytest.raises(ValueError):
        numbering.renumber(items, spark.createDataFrame([("zz", 0)], "id string, position int"))


@pytest.mark.parametrize("gap,bucket", [(60, 3600), (60, 30), (7, 1000), (4000, 900)])
def test_sessions_against_brute_force(spark, gap, bucket):
    rng = random.Random(gap + bucket)
    # One key holds most of the events.
    events = [("hot" if rng.random() < 0.7 else f"k{rng.randint(0, 3)}", rng.randint(0, 40_000) * 1_000_000 + rng.choice([0, 1])) for _ in range(1500)]
    expected = []
    for key in {k for k, _ in events}:
        run = []
        for ts in sorted(t for k, t in events if k == key):
            if run and ts - run[-1] > gap * 1_000_000:
                expected.append((key, run[0], run[-1], len(run)))
                run = []
            run.append(ts)
        expected.append((key, run[0], run[-1], len(run)))
    df = spark.createDataFrame(events, "key string, us long")
    got = sessions.gap_sessions(df, ["key"], "us", gap, bucket)
    assert sorted((r.key, r.session_start, r.session_end, r.events) for r in got.collect()) == sorted(expected)


def test_a_hot_key_in_one_hour_is_a_few_rows(spark):
    """Nine tenths of all events: one key, one hour; no window sees more than its cells."""
    rng = random.Random(4)
    hot = [("hot", 7_200_000_000 + rng.randint(0, 3_599_999_999)) for _ in range(9000)] + [("hot", None)] * 10
    cold = [(f"k{i % 50}", -5_000_000_000 + rng.randint(0, 10_000_000_000)) for i in range(1000)]
    df = spark.createDataFrame(hot + cold, "key string, us long").repartition(6)
    for gap in (60, 1, 0):
        cells = sessions.event_cells(df.where("key = 'hot'"), ["key"], "us", gap * 1_000_000)
        assert cells.agg(F.sum("_n")).first()[0] == 9000 and (not gap or cells.count() <= 3600 // gap)
        w = Window.partitionBy("key").orderBy("us")
        opens = F.coalesce((F.col("us") - F.lag("us").over(w) > gap * 1_000_000).cast("int"), F.lit(0))
        plain = (df.where("us IS NOT NULL").withColumn("o", opens).withColumn("no", F.sum("o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
                 .groupBy("key", "no").agg(F.min("us").alias("a"), F.max("us").alias("b"), F.count("*").alias("n")).drop("no"))
        got = sessions.gap_sessions(df, ["key"], "us", gap)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect()))


def test_counters_and_notifications(spark):
    h = spark.createDataFrame([("success", 10, 5, "2024-01-01 23:59:59"), ("error", None, 7, "2024-01-02 00:00:00"), ("success", None, 0, "2024-01-02 10:00:00")],
                              "status string, row_count long, duration_ms long, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    c = logs.running_counters(h, F.lit("2024-01-02").cast("date")).first()
    assert (c.total_queries, c.queries_today, c.successful_queries, c.failed_queries, c.total_bytes_read) == (3, 2, 2, 1, 1000)
    s = logs.query_stats(h).first()
    assert (s.total, s.success, s.error, s.avg_ms, s.avg_success_ms, s.total_rows, s.success_percent) == (3, 2, 1, 4, 5, 10, 67)
    empty = logs.query_stats(h.limit(0)).first()
    assert (empty.total, empty.avg_ms, empty.success_percent) == (0, 0, None)
    n = spark.createDataFrame([("a", False), ("b", True), ("c", False)], "id string, read boolean")
    assert logs.unread(n).first().unread == 2
    assert logs.unread(logs.mark_read(n, spark.createDataFrame([("a",), ("zz",)], "id string"))).first().unread == 1
    assert logs.unread(logs.mark_read(n)).first().unread == 0
    assert logs.retain(spark.range(99), ["id"], 100).count() == 99
    assert logs.retain(spark.range(105), ["id"], 100).agg(F.min("id")).first()[0] == 5


def test_profile_invariants(spark):
    df = spark.createDataFrame([(1, None, "b", [1]), (3, 0.5, "a", None), (None, 2.0, None, [2])],
                               "i int, `odd ' name` double, s string, a array<int>")
    rows = {r.column_name: r for r in profile.profile(df).collect()}
    assert (rows["i"]["count"], rows["i"].null_percentage, rows["i"].min, rows["i"].max, rows["i"].avg) == (3, 33.33, "1", "3", "2")
    odd = rows["odd ' name"]
    assert (odd.column_type, odd.min, odd.max, odd.avg, odd.approx_unique) == ("DOUBLE", "0.5", "2", "1.25", 2)
    assert (rows["s"].min, rows["s"].avg, rows["a"].min, rows["a"].approx_unique) == ("a", None, None, None)
    exact = {r.column_name: r.approx_unique for r in profile.profile(df, exact=True).collect()}
    assert exact == {"i": 2, "odd ' name": 2, "s": 2, "a": 0}
    assert profile.profile(df.limit(0)).first()["null_percentage"] == 0.0
    big = spark.range(20000).select((F.col("id") % 5000).alias("v"))
    assert abs(profile.profile(big).first().approx_unique - 5000) < 500


def test_profile_scans_once_per_group_and_once_more_for_exact_counts(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    for exact, scans in ((False, 2), (True, 3)):
        plan = profile.profile(df, exact=exact)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan parquet") == scans and "Join" not in plan


def test_exact_distinct_counts(spark, monkeypatch):
    nan = float("nan")
    rows = [(0.0, 0.0, "a", True, b"\xff", None), (-0.0, nan, "A", None, b"\xfe", None), (None, nan, "a ", False, b"\xff", None), (float("inf"), 1.0, "", True, None, None)]
    df = spark.createDataFrame(rows, "d double, f float, s string, b boolean, raw binary, none string")
    df = df.withColumn("t", F.timestamp_micros(F.monotonically_increasing_id() % 2)).withColumn("m", F.lit("1.50").cast("decimal(9,2)"))
    got = {r.column_name: r.n_distinct for r in profile.exact_distinct(df).collect()}
    assert got == {c: df.agg(F.count_distinct(c)).first()[0] for c in df.columns} == {
        "d": 2, "f": 3, "s": 4, "b": 2, "raw": 2, "none": 0, "t": got["t"], "m": 1}
    assert profile.exact_distinct(df.select(F.array("d").alias("a"))).count() == 0
    many = spark.range(0, 30_000, 1, 3).select((F.col("id") % 7000).alias("a"), F.lit("hot").alias("b"), (F.col("id") / 3).alias("c"))
    for held in (10, 5000, 10 ** 6):
        monkeypatch.setattr(profile, "HELD_VALUES", held)
        assert {r.column_name: r.n_distinct for r in profile.exact_distinct(many).collect()} == {"a": 7000, "b": 1, "c": 30_000}


def test_privacy_and_preview(spark):
    yes = ["email", "UserEmail", "ssn", "credit_score", "card_no", "CVV2", "phone", "tel_no", "password_hash", "api_key", "auth_token"]
    no = ["name", "age", "city", "amount", "created_at", "id"]
    assert all(map(privacy.is_personal, yes)) and not any(map(privacy.is_personal, no))
    df = spark.createDataFrame([(1, "x@y", 2.0)], "id int, Email string, v double")
    masked, hit = privacy.mask_personal(df)
    assert hit and tuple(masked.first()) == (1, "<redacted>", 2.0)
    assert tuple(preview.preview(df, [F.asc("id")]).first()) == ("1", "x@y", "2")


def test_document_types(spark, one):
    got = one(dbcatalog.document_type, ['"s"', "1", "3000000000", "1.5", "true", "null", "[1]", '{"a":1}', '{"$oid":"x"}', '"2024-01-02T03:04:05Z"', "-7", "1e9"])
    assert got == ["String", "Int32", "Int64", "Double", "Boolean", "Null", "Array", "Document", "ObjectId", "DateTime", "Int32", "Double"]


def test_sample_rows_are_limited_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("g"), "id")
    plan = preview.sample_rows(df, ["g"], [F.asc("id")])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_database_lists_are_shuffled_once(spark):
    """Repeated rows are dropped while the lists are made, not by a shuffle of their own."""
    from cairnbook.operators import dbcatalog

    rows = spark.createDataFrame([("t", "i", 2, "b", "x", "p"), ("t", "i", 1, "a", "x", "q"), ("t", "i", 1, "a", "x", "q"), ("t", None, None, None, None, None)],
                                 "table_name string, name string, ordinal int, column_name string, target_table string, target_column string")
    made = dbcatalog.index_groups(rows, ["table_name", "name"])
    keys = dbcatalog.foreign_key_groups(rows, ["table_name", "name"])
    assert [df._jdf.queryExecution().sparkPlan().toString().count("ObjectHashAggregate") for df in (made, keys)] == [2, 2]
    assert [df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for df in (made, keys)] == [1, 1]
    assert {r.name: r.columns for r in made.collect()} == {"i": ["a", "b"], None: [None]}
    assert {r.name: (r.target_table, r.columns, r.target_columns) for r in keys.collect()} == {"i": ("x", ["a", "b"], ["q", "p"]), None: (None, [None], [None])}
