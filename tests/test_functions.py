"""Column functions on hand-picked values."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnbook.functions import cells, html, sqltext, text, urls


def test_url_predicates(one):
    addresses = ["http://a/b", "HTTPS://a", " s3://b/k", "/home/x", "ftp://a", "s3://b", "s3://b/", "s3://b/p/*.csv", ""]
    assert one(urls.is_remote, addresses) == [True, True, True, False, False, True, True, True, False]
    assert one(urls.is_bucket, addresses) == [False, False, True, False, False, True, True, True, False]
    assert one(urls.is_bucket_listing, addresses) == [False] * 6 + [True, True, False]


def test_join_and_relative(one):
    def joined(listing, rel):
        return one(lambda x: urls.join_url(F.lit(listing), x), [rel])[0]

    assert joined("s3://b/p/", "2024/a.csv") == "s3://b/p/2024/a.csv"
    assert joined("s3://b/p", "/a.csv") == "s3://b/p/a.csv"
    assert joined("s3://b/p/*.parquet", "a.parquet") == "s3://b/p/a.parquet"
    assert joined("https://h/x.csv", "") == "https://h/x.csv"
    assert joined("s3://b/", "https://h/x.csv") == "https://h/x.csv"

    def relative(listing, address):
        return one(lambda x: urls.relative_key(x, F.lit(listing)), [address])[0]

    assert relative("s3://b/p/", "s3://b/p/q/a.csv") == "q/a.csv"
    assert relative("s3://b/p/*.csv", "s3://b/p/a.csv") == "a.csv"
    assert relative("s3://b/p", "s3://b/other/a.csv") is None


def test_expand_listing(one):
    assert one(urls.expand_listing, ["s3://b/", "s3://b/p", "s3://b/**/*.csv"]) == [
        "s3://b/**/*", "s3://b/p/**/*", "s3://b/**/*.csv"]


def test_validate_url(one):
    rows = one(urls.validate_url, [
        " HTTPS://Host/Path?Q=1 ", "http://localhost:8000/a", "S3://Bucket", "s3://b/k.csv", "", "ftp://x", "https://",
        "https:///p", "s3://", "https://docs.google.com/spreadsheets/d/AbC-1_x/edit?usp=s#gid=7"])
    assert [r.normalised for r in rows] == [
        "https://Host/Path?Q=1", "http://localhost:8000/a", "s3://Bucket/", "s3://b/k.csv", None, None, None, None, None,
        "https://docs.google.com/spreadsheets/d/AbC-1_x/export?format=csv&gid=7"]
    assert [r.insecure for r in rows][:3] == [False, True, False]
    assert [r.reason for r in rows][4:9] == [
        "no address", "scheme is none of https, http, s3", "no host named",
        "no host named", "no bucket named"]


def test_sheet_links(one):
    base = "https://docs.google.com/spreadsheets/d/"
    assert one(urls.sheet_export_url, [
        base + "ID/edit", base + "ID", base + "ID/edit#a=b&GID=42", base + "e/2PACX/pubhtml", "https://example.com/d/x",
        base + "/edit"]) == [
        base + "ID/export?format=csv", base + "ID/export?format=csv", base + "ID/export?format=csv&gid=42", None, None, None]


def test_file_names_and_extensions(one):
    assert one(urls.url_file_name, [
        "https://h/a/b.csv?x=1#f", "https://h/", "https://h", "https://h/a%20b.csv", "https://h/a/", "https://h/100%.csv",
        "s3://b/%E6%97%A5.parquet", "https://h/%FF.csv", "https://h/a+b.csv"]) == [
        "b.csv", "remote", "remote", "a b.csv", "a", "100%.csv", "日.parquet", "%FF.csv", "a+b.csv"]
    assert one(urls.url_extension, [
        "https://h/a.CSV", "https://h/a", "https://h/export?format=Csv", "https://h/a.tar.gz", "https://h/a.?FORMAT=tsv",
        "https://h/x?format="]) == ["csv", "", "csv", "gz", "tsv", ""]


def test_http_dates(one):
    assert one(cells.http_date_epoch, [
        "Wed, 21 Oct 2015 07:28:00 GMT", "Wednesday, 21-Oct-15 07:28:00 GMT", "Wed Oct 21 07:28:00 2015",
        "Sun Nov  6 08:49:37 1994", "Sunday, 06-Nov-94 08:49:37 GMT", "not a date", ""]) == [
        1445412480, 1445412480, 1445412480, 784111777, 784111777, None, None]


def test_cell_text(one):
    assert one(lambda x: cells.cell_text(x, T.DoubleType()), [1.0, 2.5, None, 1e7, 1.25e-7, -0.0, 123456789.125], "double") == [
        "1", "2.5", "NULL", "10000000", "0.000000125", "0", "123456789.125"]
    assert one(lambda x: cells.cell_text(x, T.BinaryType()), [bytearray(b"abc"), None], "binary") == ["<3 bytes>", "NULL"]
    assert one(lambda x: cells.cell_text(x, T.BooleanType()), [True, False], "boolean") == ["true", "false"]
    assert one(lambda x: cells.cell_text(x, T.ArrayType(T.IntegerType())), [[1, 2]], "array<int>") == ["[1,2]"]


def test_json_safe_numbers(one):
    limit = 9007199254740991
    assert one(lambda x: cells.json_safe(x, T.LongType()), [1, limit, limit + 1, -limit - 1, None], "long") == [
        "1", str(limit), f'"{limit + 1}"', f'"{-limit - 1}"', "null"]
    assert one(lambda x: cells.json_safe(x, T.DoubleType()), [1.5, float("nan"), float("inf")], "double") == ["1.5", "null", "null"]


def test_binary_text(one):
    values = [bytearray(b"abc\x00\x00"), bytearray(b"\xff\xfe"), bytearray(b""), bytearray(b"a\x01b"), bytearray(b"a\tb\n")]
    assert one(cells.binary_preview, values, "binary") == ["abc", "(BLOB) 2 bytes", "", "(BLOB) 3 bytes", "a\tb\n"]
    assert one(cells.hex_text, values[:2], "binary") == ["0x6162630000", "0xfffe"]
    assert one(lambda x: cells.bit_text(x, 10), [bytearray(b"\x02\x05")], "binary") == ["1000000101"]
    assert one(lambda x: cells.bit_text(x, 1), [bytearray(b"\x01")], "binary") == ["1"]


def test_average_text(one):
    assert one(cells.average_text, [3.0, 2.5, 1 / 3, None], "double") == ["3", "2.5", "0.3333", None]


def test_snippet_counts_characters(one):
    long = "é" * 100 + "NEEDLE" + "ü" * 100
    assert one(lambda x: text.snippet(x, "needle"), [long, "no", "a\nneedle\nb", None]) == [
        "é" * 40 + "NEEDLE" + "ü" * 40, None, "a needle b", None]


def test_truncate_pages(one):
    paged = "one\x0c \x0cthree\x0cfour"
    out = one(lambda x: text.truncate_pages(x, 2), [paged, "short", "a" * 3000 + "\n\n" + "b" * 3000, "c" * 6000])
    assert out[0].startswith("## Page 1\n\none\n\n## Page 2\n\n*(no text — may be a scanned image)*\n\n---\n*Showing first 2 of 4")
    assert out[1] == "short"
    assert out[2].startswith("a" * 3000 + "\n\n---\n*Showing first ~2 pages.")
    assert out[3].startswith("c" * 5000 + "\n\n---")


def test_names(one):
    assert one(text.extension, ["a/b.CSV", "a/.hidden", "noext", "x.tar.gz", "a.b/c"]) == ["csv", "", "", "gz", ""]
    assert one(text.dataset_name, ["/d/a.b.csv", "plain", "/d/.hidden"]) == ["a.b", "plain", ".hidden"]
    assert one(text.relation_name, ["Users.csv", "orders.parquet.parquet", "x.xlsx.csv", "a.json"]) == [
        "users", "orders", "x", "a.json"]
    assert one(lambda x: text.ensure_extension(x, "xlsx"), ["Report.XLSX", "Report"]) == ["Report.XLSX", "Report.xlsx"]
    assert one(text.safe_file_name, ["a b/ç.csv"]) == ["a_b___csv"]


def test_sql_text(one):
    assert one(sqltext.index_columns, [
        'CREATE INDEX i ON t USING btree (a, "b c")', "CREATE INDEX i ON t (lower(x), y)", "none", "f()", "(a, b"]) == [
        ["a", "b c"], ["x)", "y"], [], [], ["a", "b"]]
    assert one(sqltext.collection_names, ["select * from a join b on 1 FROM a"]) == [["a", "b"]]
    assert one(sqltext.collection_names, ["select 'from x' from /* from y */ `my t`\n-- join z\nJoin b1.c ON a.from = 1 join (select 1 from _d)", "from 1", None]) == [
        ["my t", "b1", "_d"], [], None]
    assert one(lambda x: sqltext.starts_with_keyword(x, ["SELECT", "WITH"]), [
        "/* c */ select 1", "-- x\nWITH RECURSIVE t AS (SELECT 1) SELECT 1", "SELECTED", "show tables", "  Select(1)"]) == [
        True, True, False, False, True]
    assert one(text.cap_sql, ["x" * 2001, "y"]) == ["x" * 2000 + "…", "y"]


def test_html_to_markdown(spark):
    page = ("<html><head><title>A &amp; B</title><style>p{}</style><script>var t='</p>';</script></head><body><nav>n</nav>"
            "<h2>Head</h2><p>one <b>two</b>\n three <a href='/x'>link</a></p><ul><li>i1</li><li>i2</li></ul>caf&eacute;<br>z</body></html>")
    assert html.to_markdown(page) == ("A & B", "n\n\n## Head\n\none **two** three [link](/x)\n\n- i1\n- i2\n\ncafé\nz")
    assert html.to_markdown(None) == ("", "")
    df = spark.createDataFrame([(1, page), (2, "<p>x"), (3, None)], "page_id long, html string")
    rows = {r.page_id: r for r in html.html_to_markdown(df).collect()}
    assert rows[1].title == "A & B" and rows[2].markdown == "x" and rows[3].markdown == ""


def test_html_corpus_against_brute_force(spark):
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r.page_id: r.html for r in pages.select("page_id", "html").collect()}
    made = html.html_to_markdown(pages).collect()
    assert {r.page_id for r in made} == set(source)
    for r in made:
        raw = re.sub(r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->", "", source[r.page_id])
        assert len(re.findall(r"(?m)^#{1,6} ", r.markdown)) >= len(re.findall(r"<h[1-6][ >]", raw)) - raw.count("<h1></h1>")
        assert not re.search(r"</?(p|div|script|article|nav|ul|li)\b[^<]*>", r.markdown)


def test_type_names(one):
    assert one(cells.type_name_col, ["int", "decimal(10,2)", "timestamp_ntz", "array<int>", "boolean", "date"]) == [
        "BIGINT", "DOUBLE", "TIMESTAMP", "VARCHAR", "BOOLEAN", "DATE"]
