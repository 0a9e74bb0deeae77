"""Listings, readers, catalog scans, workbooks, trees, streams on files made here."""

import csv
import fnmatch
import io
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from cairnbook.operators import guard, sinks
from cairnbook.plans.sources import _book
from cairnbook.sources import catalog, keyvalue, listing, readers, tree, workbook
from cairnbook.streaming import jobs


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="") as f:
        f.write(text)


def test_glob_to_regex_like_fnmatch():
    import re

    names = ["a.csv", ".DS_Store", "node_modules", "~$x.docx", ".~lock.a#", "ab", "a/b/c", "x[1]", "a-b", "A.csv", "", "a\nb"]
    for glob in ("*.csv", ".DS_Store", "~$*", ".~lock*", "a?", "[ab]*", "[!a]*", "*", "x[[]1]", "a*c", "[a-b].csv"):
        regex = re.compile(r"(?s)\A(?:" + listing.glob_to_regex(glob) + r")\Z")
        for n in names:
            assert bool(regex.match(n)) == fnmatch.fnmatchcase(n, glob), (glob, n)
    assert [listing.glob_to_regex(g) for g in ("a**b", "[abc", "***", "a**")] == [None] * 4
    assert re.fullmatch(listing.glob_to_regex("**/x"), "a/b/x") and re.fullmatch(listing.glob_to_regex("**/x"), "x")


def test_excludes_and_classes(one):
    assert one(lambda x: listing.excluded(x), ["a/node_modules/b.csv", "a/.git", "targets/x", "a/~$b.docx", "a/b.csv", "venv/x"]) == [
        True, True, False, True, False, True]
    assert one(lambda x: listing.excluded(x, ("[bad", "*.log")), ["a/x.log", "a/x.csv"]) == [True, False]
    assert one(listing.always_skipped, ["a.EXE", "a.so", "a.csv", "noext"]) == [True, True, False, False]
    assert one(listing.format_class, ["PDF", "py", "csv", "zip", "xml"]) == ["document", "text", "tabular", "other", "text"]
    tiers = {"docx": "SHALLOW", "csv": "nonsense", "zip": "full"}
    assert one(lambda x: listing.scan_tier(x, tiers), ["docx", "csv", "zip", "pdf", "ipynb", "weird"]) == [
        "shallow", "full", "full", "content", "shallow", "shallow"]
    assert one(lambda x: listing.reader_for(x, F.lit("text/csv")), ["parquet", "tsv", "xlsx", "", "bin"]) == [
        "parquet", "csv", None, "csv", "csv"]


def test_list_files_like_os_walk(spark, tmp_path):
    root = str(tmp_path / "data")
    for rel in ("a.csv", "b/c.tsv", "b/d.txt", "b/e/f.csv", "g.json"):
        _write(f"{root}/{rel}", "x,y\n1,2\n")
    got = {r.relative_path: r.size_bytes for r in listing.list_files(spark, root).collect()}
    assert got == {"a.csv": 8, "b/c.tsv": 8, "b/e/f.csv": 8}
    assert listing.list_files(spark, root, "*").count() == 5
    assert listing.list_files(spark, root, "*.csv", limit=1).first().relative_path == "a.csv"


def test_fingerprint(spark):
    def prints(rows):
        df = spark.createDataFrame(rows, "folder string, relative_path string, size_bytes long, mtime long")
        return {r.folder: r.fingerprint for r in listing.folder_fingerprint(df, ["folder"]).collect()}

    rows = [("f", f"d/{i}.csv", i, i) for i in range(50)] + [("g", "x.pdf", 1, 1)]
    one = prints(rows)
    assert prints(rows[::-1]) == one and one["f"] != one["g"]
    assert prints(rows + [("f", "ignored.txt", 1, 1), ("f", "node_modules/x.csv", 1, 1)]) == one
    for change in (("f", "d/0.csv", 1, 0), ("f", "d/0.csv", 0, 1), ("f", "d/zero.csv", 0, 0)):
        assert prints([change, *rows[1:]])["f"] != one["f"]
    assert prints(rows[1:])["f"] != one["f"]


def test_csv_ladder(spark, tmp_path):
    _write(f"{tmp_path}/clean.csv", "id,name,amount\n1,alice,10.5\n2,bob,20.0\n")
    df, rung = readers.read_csv_ladder(spark, f"{tmp_path}/clean.csv")
    assert rung == 1 and dict(df.dtypes) == {"id": "int", "name": "string", "amount": "double"} and df.count() == 2
    _write(f"{tmp_path}/ragged.csv", "id,name,amount\n1,alice,10.5\n2,bob\n3,carol,30.0\n4,d,1.0,extra\n")
    df, rung = readers.read_csv_ladder(spark, f"{tmp_path}/ragged.csv")
    assert rung == 2 and sorted(map(tuple, df.collect())) == [(1, "alice", 10.5), (2, "bob", None), (3, "carol", 30.0)]
    with pytest.raises(ValueError, match="4 attempts"):
        readers.read_csv_ladder(spark, f"{tmp_path}/missing.csv")


def test_csv_records_with_quoted_line_ends(spark, tmp_path):
    _write(f"{tmp_path}/q.csv", 'a,b,c\n1,"x\ny",k\n2,z,k\n')
    df, rung = readers.read_csv_ladder(spark, f"{tmp_path}/q.csv")
    assert rung == 1 and sorted(map(tuple, df.collect())) == [(1, "x\ny", "k"), (2, "z", "k")] and df.dtypes[0] == ("a", "int")
    _write(f"{tmp_path}/r.csv", 'a,b,c\r\n1,"x\r\n""y""",2024-01-02\r\n2,z\r\n3,u,2024-01-03,more\r\n4,,2024-01-04\r\n')
    df, rung = readers.read_csv_ladder(spark, f"{tmp_path}/r.csv")
    assert rung == 2 and sorted((r.a, r.b, str(r.c)) for r in df.collect()) == [(1, 'x\r\n"y"', "2024-01-02"), (2, "z", "None"), (4, None, "2024-01-04")]
    rng = random.Random(6)
    rows = [[rng.choice(["x", 'quo"te', "line\nbreak", "a,b", "é", '5" pipe', ""]) for _ in range(3)] for _ in range(150)]
    with open(f"{tmp_path}/many.csv", "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows(rows)
    files = readers.csv_files(spark, f"{tmp_path}/many.csv")
    for chunk in (1 << 20, 100, 9):
        got = [r.fields for r in catalog.split_records(files, chunk).orderBy("start", "no").collect()]
        assert got == [r for r in rows if r], chunk
    assert catalog.count_lines(files, 9).first().lines == len(rows)


def test_json_layouts(spark, tmp_path):
    docs = {"lines": '{"a":1,"b":{"c":"x"}}\n{"a":2}\n', "array": '[{"a":1,"b":{"c":"x"}},{"a":2}]',
            "pretty": '[\n  {\n    "a": 1,\n    "b": {"c": "x"}\n  },\n  {\n    "a": 2\n  }\n]\n',
            "broken": '{"a":1,"b":{"c":"x"}}\n{"a":2}\noops\n'}
    for name, text in docs.items():
        _write(f"{tmp_path}/{name}.json", text)
        df = readers.read_table(spark, f"{tmp_path}/{name}.json", "json")
        assert sorted((r.a, r.c) for r in df.select("a", "b.c").collect()) == [(1, "x"), (2, None)], name
        assert df.count() == 2


def test_json_of_any_layout_is_read_whole(spark, tmp_path, monkeypatch):
    import json

    from cairnbook.sources import jsonranges
    rng = random.Random(7)
    docs = [{"a": i, "t": "".join(rng.choices('x{[",\\\n é]}', k=8)), "l": [{"b": i}]} for i in range(60)]
    layouts = {"list.json": json.dumps(docs), "loose.json": "[" + ",\n".join(map(json.dumps, docs)) + "]", "pretty.json": json.dumps(docs, indent=3),
               "documents.json": "\n".join(json.dumps(d, indent=1) for d in docs), "lines.jsonl": "\n".join(map(json.dumps, docs)),
               "lists.json": "\n".join(json.dumps([d]) for d in docs), "dense.json": "".join(map(json.dumps, docs))}
    for first in (1 << 20, 5):  # also with a first line that is longer than what is looked at
        monkeypatch.setattr(jsonranges, "FIRST_LINE_BYTES", first)
        for name, text in layouts.items():
            _write(f"{tmp_path}/{name}", text)
            got = readers.read_table(spark, f"{tmp_path}/{name}", "json").select("a", "t", "l.b").collect()
            assert sorted((r.a, r.t, r.b[0]) for r in got) == [(d["a"], d["t"], d["a"]) for d in docs], name
    assert readers.read_json(spark, str(tmp_path)).count() == 60 * len(layouts)


def test_convert_never_overwrites(spark, tmp_path):
    _write(f"{tmp_path}/t.csv", "a,b\n1,2\n")
    targets = [sinks.convert(spark, f"{tmp_path}/t.csv", str(tmp_path)) for _ in range(3)]
    assert [os.path.basename(t["target"]) for t in targets] == ["t.parquet", "t-converted-1.parquet", "t-converted-2.parquet"]
    assert all(t["source_bytes"] == 8 and t["target_bytes"] > 0 for t in targets)
    assert [(t["rows"], t["dropped_rows"]) for t in targets] == [(1, 0)] * 3
    _write(f"{tmp_path}/ragged.csv", "id,name\n1,a\n2\n3,c,more\n4,d,more,more\n")
    assert [sinks.convert(spark, f"{tmp_path}/ragged.csv", str(tmp_path))[k] for k in ("rows", "dropped_rows")] == [2, 2]
    with pytest.raises(ValueError):
        sinks.convert(spark, targets[0]["target"], str(tmp_path))


def test_convert_says_what_it_leaves_out(spark, tmp_path):
    _write(f"{tmp_path}/a.tsv", "id\tn\n1\tx\n2\ty\n")
    _write(f"{tmp_path}/b.json", '{"a": 1}\n{"a": oops}\n{"a": 3}\n')
    _write(f"{tmp_path}/c.ndjson", '{"a": 1}\n\n{"a": 2}\n')
    _write(f"{tmp_path}/d.json", '[{"a": 1},\n {"a": 2}]')
    got = {n: sinks.convert(spark, f"{tmp_path}/{n}", str(tmp_path)) for n in ("a.tsv", "b.json", "c.ndjson", "d.json")}
    assert {n: (g["rows"], g["dropped_rows"]) for n, g in got.items()} == {"a.tsv": (2, 0), "b.json": (2, 1), "c.ndjson": (2, 0), "d.json": (2, 0)}


def test_line_counts_across_ranges(spark, tmp_path):
    rng = random.Random(5)
    expected = {}
    for i in range(6):
        path = f"{tmp_path}/f{i}.csv"
        rows = [[rng.choice(["x", 'quo"te', "line\nbreak", "a,b", "é"]) for _ in range(3)] for _ in range(rng.randint(1, 200))]
        with open(path, "w", newline="") as f:
            csv.writer(f, lineterminator=rng.choice(["\n", "\r\n"])).writerows(rows)
            f.write(rng.choice(["", "\n\n"]))
        expected[os.path.basename(path)] = len(rows)
    files = listing.list_files(spark, str(tmp_path))
    for chunk in (7, 64, 1 << 20):
        got = {os.path.basename(r.path): r.lines for r in catalog.count_lines(files, chunk).collect()}
        assert got == expected


def test_scan_catalog(spark, tmp_path):
    root = str(tmp_path / "lake")
    _write(f"{root}/a.csv", "id,email\n1,x@y\n2,z@y\n3,\n")
    _write(f"{root}/head.csv", "a,b\n")
    _write(f"{root}/bad.parquet", "not parquet")
    _write(f"{root}/node_modules/skip.csv", "a\n1\n")
    pd.DataFrame({"k": range(7), "phone": ["1"] * 7}).to_parquet(f"{root}/p.parquet")
    rows = {r.relative_path: r for r in catalog.scan_catalog(spark, root).collect()}
    assert set(rows) == {"a.csv", "head.csv", "bad.parquet", "p.parquet"}
    assert (rows["a.csv"].row_count, rows["p.parquet"].row_count, rows["head.csv"].row_count) == (3, 7, 0)
    assert "<redacted>" in rows["a.csv"].sample_rows and "x@y" not in rows["a.csv"].sample_rows and rows["a.csv"].samples_redacted
    assert rows["p.parquet"].sample_rows.count('"k"') == 5 and rows["bad.parquet"].error and rows["bad.parquet"].row_count is None
    cols = {(r.relative_path, r.name, r.type) for r in catalog.schema_columns(catalog.scan_catalog(spark, root), ["relative_path"]).collect()}
    assert {("p.parquet", "k", "BIGINT"), ("p.parquet", "phone", "VARCHAR"), ("a.csv", "id", "BIGINT")} <= cols


def test_scan_keeps_a_record_of_every_file(spark, tmp_path):
    root = str(tmp_path / "lake")
    book = _book(pd.DataFrame({"c_custkey": [1, 2], "c_mktsegment": ["a", "b"], "c_acctbal": [1.0, 2.0], "c_nationkey": [1, 2]}))
    texts = {"lines.json": '{"a": 1, "b": "x"}\n{"a": 2.5}\n', "array.json": '[\n {"a": 1},\n {"a": 2}\n]', "bad.json": "{", "r.md": "# t",
             "p.html": "<html><title>T</title><body><h1>x</h1></body></html>", "empty.csv": "", "_h.csv": "a\n1\n", ".d.tsv": "a\tb\n1\t2\n",
             "t.csv": "i,f,d,b,s,e\n1,1.5,2024-01-02,true,x,\n2,3,2024-01-03,false,1_0,\n"}
    for name, text in texts.items():
        _write(f"{root}/sub/{name}", text)
    with open(f"{root}/w.xlsx", "wb") as f:
        f.write(book)
    rows = {r.relative_path.split("/")[-1]: r for r in catalog.scan_catalog(spark, root, "*").collect()}
    assert set(rows) == {*texts, "w.xlsx"} and rows["bad.json"].error
    counts = {n: rows[n].row_count for n in ("lines.json", "array.json", "p.html", "empty.csv", "_h.csv", ".d.tsv", "t.csv", "w.xlsx", "r.md")}
    assert counts == {"lines.json": 2, "array.json": 2, "p.html": 1, "empty.csv": 0, "_h.csv": 1, ".d.tsv": 1, "t.csv": 2, "w.xlsx": 1, "r.md": None}
    import json
    types = {c["name"]: c["type"] for c in json.loads(rows["t.csv"].schema_json)}
    assert types == {"i": "BIGINT", "f": "DOUBLE", "d": "DATE", "b": "BOOLEAN", "s": "VARCHAR", "e": "VARCHAR"}
    assert rows["r.md"].tier == "shallow" and {c["name"]: c["type"] for c in json.loads(rows["lines.json"].schema_json)} == {"a": "DOUBLE", "b": "VARCHAR"}
    small = {r.relative_path: r.error for r in catalog.scan_catalog(spark, root, "*", max_mb=0).collect()}
    assert len(small) == len(rows) and "not read" in small["w.xlsx"]


def test_parquet_samples_read_little(tmp_path, monkeypatch):
    import numpy as np
    path = str(tmp_path / "big.parquet")
    pd.DataFrame({f"c{i}": np.random.default_rng(i).random(1_000_000) for i in range(2)}).to_parquet(path, row_group_size=1_000_000, use_dictionary=False)
    read = []

    class Counted(io.FileIO):
        def read(self, n=-1):
            got = super().read(n)
            read.append(len(got))
            return got

    monkeypatch.setattr(catalog, "_open", lambda p: Counted(p))
    facts = catalog._inspect(path, "parquet", "full")
    assert facts["row_count"] == 1_000_000 and facts["sample_rows"].count("c1") == 5 and sum(read) < os.path.getsize(path) / 3


def test_stray_quotes_are_text(spark, tmp_path):
    """As Python's csv reader sees them, however the ranges are cut."""
    rng, expected = random.Random(8), {}
    for i in range(30):
        text = "".join(rng.choice(['"', "a", ",", "\n", '5"', '""', ',"', '",', "x\r\n"]) for _ in range(rng.randint(1, 60))) + '"'
        text = text.replace('"', '"') + "\n1,2\n"
        with open(f"{tmp_path}/q{i}.csv", "w", newline="") as f:
            f.write(text)
        state, records, blank = 0, 0, True
        j = 0
        prev = "\n"
        while j < len(text):  # a plain machine: outside, inside
            c = text[j]
            if c == '"':
                k = j
                while k < len(text) and text[k] == '"':
                    k += 1
                if (k - j) % 2:
                    state = (1 - state) if (state or prev in ",\n\r") else 0
                prev, j, blank = '"', k, False
                continue
            if c == "\n" and not state:
                records += not blank
                blank = True
            elif c != "\r":
                blank = False
            if c == "\n" and state:
                blank = True
            prev, j = c, j + 1
        expected[f"q{i}.csv"] = records
    _write(f"{tmp_path}/pipe.csv", 'id,size\n1,5" pipe\n2,6\n3,"a\nb"\n')
    expected["pipe.csv"] = 4
    files = listing.list_files(spark, str(tmp_path))
    for chunk in (1, 5, 1 << 20):
        got = {os.path.basename(r.path): r.lines for r in catalog.count_lines(files, chunk).collect()}
        assert got["pipe.csv"] == 4
        assert {n: got.get(n, 0) for n in expected} == expected


def test_workbooks(spark):
    pdf = pd.DataFrame({"c_custkey": [1, 2], "c_mktsegment": ["a&b", "c"], "c_acctbal": [10.0, 2.5], "c_nationkey": [1, 20]})
    df = spark.createDataFrame([("x.xlsx", bytearray(_book(pdf))), ("old.xls", bytearray(b"")), ("bad.xlsx", bytearray(b"zz"))],
                               "path string, content binary")
    out = workbook.read_workbooks(df)
    rows = {(r.path, r.row_no): (r.cells, r.error) for r in out.collect()}
    assert rows[("x.xlsx", 0)][0] == ["1", 'a&b,"x"', "", "10", "false", "#ERR:#DIV/0!"]
    assert rows[("x.xlsx", 1)][0][3:5] == ["2.5", "true"]
    assert "not supported" in rows[("old.xls", -1)][1] and rows[("bad.xlsx", -1)][1]
    lines = out.where("path = 'x.xlsx' AND row_no = 0").select(workbook.csv_line(F.col("cells")).alias("l")).first().l
    assert next(csv.reader([lines])) == rows[("x.xlsx", 0)][0]


def test_walk_tree_with_cycles_and_shared_folders(spark):
    d = tree.FOLDER_TYPE
    edges = [("root", "a", "A", d), ("root", "b", "B", d), ("a", "b", "B", d), ("b", "a", "A", d), ("b", "root", "loop", d),
             ("a", "f1", "x.csv", "text/csv"), ("b", "f1", "x.csv", "text/csv"), ("b", "f2", "v.mp4", "video/mp4"),
             ("b", "s", "Sheet", tree.EXPORTABLE[0]), ("b", "q", "Form", tree.NATIVE_PREFIX + "form"), ("zz", "lost", "l.csv", "")]
    df = spark.createDataFrame(edges, "parent string, id string, name string, mime string")
    walked = tree.walk_tree(df, "root")
    assert {r.id: (r["class"], r.depth) for r in walked.collect()} == {
        "a": ("folder", 1), "b": ("folder", 1), "f1": ("file", 2), "f2": ("unsupported", 2), "s": ("export", 2), "q": ("native", 2)}
    assert tuple(tree.walk_totals(walked).first()) == (3, 2, 1, 1)
    assert tree.walk_tree(df, "nowhere").count() == 0


def test_a_level_reads_the_partitions_of_its_frontier(spark, monkeypatch):
    d = tree.FOLDER_TYPE
    edges = [(f"f{i}", f"f{i}-{j}", f"{j}.csv", "text/csv") for i in range(200) for j in range(3)] + [("root", f"f{i}", f"F{i}", d) for i in range(200)]
    df = spark.createDataFrame(edges, "parent string, id string, name string, mime string").withColumn("class", F.lit("x"))
    stored = tree.stored_edges(df, 5)
    frontier = spark.createDataFrame([("f3",), ("f77",), ("f3",), ("none",)], "id string")
    for small in (50_000, 1):
        monkeypatch.setattr(tree, "_SMALL_FRONTIER", small)
        found = tree.children(spark, stored, frontier)
        assert {r.id for r in found.collect()} == {f"f{i}-{j}" for i in (3, 77) for j in range(3)}
        read = {f.split("_bucket=")[1].split("/")[0] for f in found.inputFiles() if "_bucket=" in f}
        assert 1 <= len(read) <= 3 and len(stored.there) > 50
    walked = tree.walk_tree(df.drop("class"), "root")
    assert walked.count() == 800 and walked.agg(F.max("depth")).first()[0] == 2


def test_key_values(spark):
    df = spark.createDataFrame([
        ("s", "string", 5, "v", None, None), ("l", "list", None, None, [str(i) for i in range(12)], None), ("z", "zset", None, None, ["a"], None),
        ("e", "set", None, None, [str(i) for i in range(12)], None), ("h", "hash", None, None, None, {"k": "v"}), ("u", "stream", None, None, None, None)],
        "key string, value_type string, ttl int, text string, items array<string>, fields map<string,string>")
    got = {r.key: (r.value, r.ttl) for r in keyvalue.render_kv(df).collect()}
    assert got == {"s": ("v", 5), "l": ("[" + ", ".join(map(str, range(10))) + "]", -1), "z": ("[a]", -1),
                   "e": ("{" + ", ".join(map(str, range(12))) + "}", -1), "h": ("{k=v}", -1), "u": ("", -1)}


def test_jdbc_and_cloud_options():
    src = readers.JdbcSource("postgresql", "jdbc:postgresql://h/db", "u", "p", schema="s")
    opts = readers.jdbc_options(src, query="select 1 as x", partition=("x", 0, 100, 8))
    assert opts["dbtable"] == "(select 1 as x) AS part_source" and opts["numPartitions"] == "8" and opts["queryTimeout"] == "60"
    assert opts["sessionInitStatement"] == 'SET search_path TO "s"' and opts["driver"] == "org.postgresql.Driver"
    assert readers.jdbc_options(src, table="t")["dbtable"] == "t" and "query" in readers.jdbc_options(src, query="select 1")
    with pytest.raises(ValueError):
        readers.jdbc_options(src)
    with pytest.raises(ValueError, match="only SELECT"):
        readers.read_jdbc(None, src, query="drop table x")
    assert guard.check_db_sql("select 1") is None
    assert readers.cloud_location("s3", "b", "/p/") == "s3a://b/p/"
    assert readers.cloud_location("azure", "c", "p", "acc") == "abfss://c@acc.dfs.core.windows.net/p"
    assert readers.cloud_options("s3", "b", "k", "s", region="r") == {
        "fs.s3a.bucket.b.access.key": "k", "fs.s3a.bucket.b.secret.key": "s", "fs.s3a.bucket.b.endpoint.region": "r"}


def test_rescan_reads_only_changes(spark, tmp_path):
    root, state = str(tmp_path / "lake"), str(tmp_path / "state")
    for name in ("a.csv", "b.csv", "c.csv"):
        _write(f"{root}/{name}", "x\n1\n")
    assert jobs.rescan(spark, root, state) == 3
    assert jobs.rescan(spark, root, state) == 0
    _write(f"{root}/b.csv", "x\n1\n2\n3\n")
    _write(f"{root}/d.csv", "x\n1\n")
    os.remove(f"{root}/c.csv")
    assert jobs.rescan(spark, root, state) == 2
    rows = {r.relative_path: r.row_count for r in sinks.read_snapshot(spark, f"{jobs.rescan_state(state, root)}/catalog").collect()}
    assert rows == {"a.csv": 1, "b.csv": 3, "d.csv": 1}
    assert jobs.rescan(spark, root, state) == 0


def test_a_folder_that_cannot_be_read_does_not_end_the_listing(spark, tmp_path, monkeypatch):
    root, state = str(tmp_path / "lake"), str(tmp_path / "state")
    for name in ("a.csv", "shut/b.csv", "shut/deep/c.csv", "open/d.csv"):
        _write(f"{root}/{name}", "x\n1\n")
    assert jobs.rescan(spark, root, state) == 4
    _write(f"{root}/e.csv", "x\n")
    real = listing.walk_folders

    def walk(spark_, root_):  # as root may read everything, the folder is shut by hand
        found = real(spark_, root_)
        shut = F.col("path").contains("/shut")
        return found.where(~shut).unionByName(spark_.createDataFrame([(f"file:{root_}/shut", None, None, "PermissionError: no")], found.schema))

    monkeypatch.setattr(listing, "walk_folders", walk)
    monkeypatch.setattr(catalog, "walk_folders", walk)
    found = {r.path.split("/lake/")[1]: r.error for r in catalog.scan_catalog(spark, root).collect()}
    assert found == {"a.csv": None, "open/d.csv": None, "e.csv": None, "shut": "PermissionError: no"}
    assert jobs.rescan(spark, root, state) == 1
    kept = sinks.read_snapshot(spark, f"{jobs.rescan_state(state, root)}/catalog")
    assert {r.relative_path for r in kept.collect()} == {"a.csv", "shut/b.csv", "shut/deep/c.csv", "open/d.csv", "e.csv"}
    monkeypatch.undo()
    with pytest.raises(FileNotFoundError):
        listing.list_files(spark, str(tmp_path / "none"))
    lost = spark.createDataFrame([("file:/x/gone",)], "path string").mapInPandas(listing._listed, "path string, is_folder boolean, size_bytes long, modified_us long, error string")
    assert "gone" in lost.first().error


def test_names_with_any_signs(spark, tmp_path):
    names = ["a b.csv", "50%.csv", "x%20y.csv", "q?.csv", "h#1.csv", "é 日本.json", "s p/a+b.tsv", "c:d.csv"]
    for name in names:
        _write(f"{tmp_path}/{name}", '{"a": 1}' if name.endswith("json") else "x\n1\n")
    found = {r.relative_path: (r.row_count, r.error) for r in catalog.scan_catalog(spark, str(tmp_path)).collect()}
    assert found == dict.fromkeys(names, (1, None))


def test_fingerprint_parts_do_not_run_together(spark):
    rows = [("a", "x|1", 2, None), ("b", "x", 1, 2), ("c", "x|1", None, 2), ("d", "x\\|1", 2, None), ("e", None, 1, 2), ("f", "", 1, 2)]
    df = spark.createDataFrame([(f, p and p + ".csv", s, m) for f, p, s, m in rows], "folder string, relative_path string, size_bytes long, mtime long")
    prints = [r.fingerprint for r in listing.folder_fingerprint(df, ["folder"], every=True).collect()]
    assert len(set(prints)) == len(rows)


def test_alert_states_over_many_batches(spark, tmp_path):
    """The stateful and the window form see the same bursts, however the events are cut."""
    rng = random.Random(9)
    events = sorted((rng.randint(0, 4000), rng.choice("ab")) for _ in range(300))
    expected = set()
    for key in "ab":
        run = []
        for s in [s for s, k in events if k == key] + [10**9]:
            if run and s - run[-1] > 60:
                expected.add((key, run[0], run[-1], len(run)))
                run = []
            run.append(s)
    inbox = str(tmp_path / "inbox")
    for i in range(0, 300, 60):
        part = spark.createDataFrame([(k, s) for s, k in events[i:i + 60]], "key string, s long")
        part.select("key", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", "1").parquet(inbox)
    out = str(tmp_path / "out")
    jobs.run_batches(jobs.alert_states(stream, ["key"], "ts"), lambda df, n: jobs.write_batch(df, out, n), str(tmp_path / "ck"), "update")
    rows = jobs.current_alerts(spark.read.parquet(out), ["key"])
    got = {(r.key, r.a, r.b, r.n) for r in rows.select("key", F.unix_seconds("first_seen").alias("a"), F.unix_seconds("last_seen").alias("b"), F.col("repeats").alias("n")).collect()}
    assert got == expected


def test_late_alerts_keep_their_own_burst_and_ids(spark, tmp_path):
    """Late events join what is near on either side, close gaps, and leave ids as they were."""
    inbox, out = str(tmp_path / "inbox"), str(tmp_path / "out")
    batches = [[1000], [700], [1050, 640], [850], [800, 900, 950]]
    for batch in batches:
        part = spark.createDataFrame([("a", s) for s in batch], "key string, s long")
        part.select("key", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(inbox)
    stream = spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", "1").parquet(inbox)
    jobs.run_batches(jobs.alert_states(stream, ["key"], "ts"), lambda df, n: jobs.write_batch(df, out, n), str(tmp_path / "ck"), "update")
    states = spark.read.parquet(out)
    seen = {(r.batch_id, r.alert_id, r.repeats) for r in states.collect()}
    assert (0, "a-1000000000", 1) in seen and (1, "a-700000000", 1) in seen
    read = spark.createDataFrame([("a-1000000000",)], "alert_id string")
    now = {r.alert_id: (r.first_seen.timestamp(), r.last_seen.timestamp(), r.repeats, r.read) for r in jobs.current_alerts(states, ["key"], read=read).collect()}
    spans = sorted((v[0] % 100_000, v[1] % 100_000, v[2]) for v in now.values())
    events = sorted(s for b in batches for s in b)
    want, run = [], [events[0]]
    for s in [*events[1:], 10**9]:
        if s - run[-1] > 60:
            want.append((run[0], run[-1], len(run)))
            run = []
        run.append(s)
    assert spans == [(float(a), float(b), n) for a, b, n in want]
    assert now["a-1000000000"][3] is True and sum(v[3] for v in now.values()) == 1


def test_rescan_sees_every_listed_format_and_keeps_roots_apart(spark, tmp_path):
    one_root, two, state = str(tmp_path / "one"), str(tmp_path / "two"), str(tmp_path / "state")
    _write(f"{one_root}/a.tsv", "x\ty\n1\t2\n")
    _write(f"{two}/b.csv", "x\n1\n")
    assert [jobs.rescan(spark, r, state) for r in (one_root, two, one_root, two)] == [1, 1, 0, 0]
    _write(f"{one_root}/a.tsv", "x\ty\n1\t2\n3\t4\n")
    _write(f"{one_root}/c.tsv", "x\n")
    assert [jobs.rescan(spark, r, state) for r in (one_root, two)] == [2, 0]


def test_records_of_a_large_file_are_held_in_parts(tmp_path):
    """A task reads range after range; what it holds as Python objects is that of one range, however large the file is."""
    import tracemalloc

    import pandas as pd

    path = tmp_path / "big.csv"
    path.write_bytes(b"".join(b'"%d","%s\r\n%s"\n' % (i, b"a" * 200, b"b " * 100) for i in range(60_000)))
    size = path.stat().st_size
    ranges = pd.DataFrame([(f"file:{path}", at, size, 0, "csv") for at in range(0, size, catalog.CHUNK_BYTES)], columns=list(catalog._RANGE))
    tracemalloc.start()
    counted = pd.concat(catalog._line_counter(catalog.CHUNK_BYTES)(iter([ranges])))
    states = [0]
    for outside_to, inside_to in zip(counted["outside_to"], counted["inside_to"]):
        states.append(inside_to if states[-1] else outside_to)
    ranges["state"] = states[:-1]
    assert sum(len(rows) for rows in catalog._splitter(catalog.CHUNK_BYTES)(iter([ranges]))) == 60_000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * size
