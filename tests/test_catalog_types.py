"""Types, names and counts folded over whole files, however they are cut into ranges."""

import csv
import io
import json
import random
import zipfile

import numpy as np
import pytest

from cairnbook.operators import drift
from cairnbook.sources import catalog, fieldtypes, jsonranges, listing
from pyspark.sql import functions as F


class Held(io.BytesIO):
    """Bytes with the positional reads of an Arrow file."""

    def read_at(self, size, at):
        return self.getvalue()[at:at + size]


def random_value(rnd, depth=0):
    kind = rnd.randint(0, 8 if depth < 3 else 5)
    if kind >= 7:
        return {rnd.choice(["a", "b", 'q"', "é", "x{", ""]): random_value(rnd, depth + 1) for _ in range(rnd.randint(0, 3))}
    if kind == 6:
        return [random_value(rnd, depth + 1) for _ in range(rnd.randint(0, 3))]
    return [None, True, rnd.randint(-5, 10 ** 6), rnd.random(), "".join(rnd.choices(['"', "\\", "{", "]", "\n", "é", "a", ",", " ", "\\\\"], k=rnd.randint(0, 9))), -0.5][kind]


def layout(rnd, values):
    """A file of the values, and the records it has."""
    style = rnd.choice(["lines", "array", "pretty", "dense", "lists"])
    ascii_only = rnd.random() < 0.5
    say = lambda v, **k: json.dumps(v, ensure_ascii=ascii_only, **k)
    if style == "array":
        return rnd.choice(["", " ", "\n", "﻿"]) + say(values) + rnd.choice(["", "\n"]), values
    if style == "pretty":
        return say(values, indent=rnd.choice([0, 1, 7])), values
    if style == "lists":
        values = [v if isinstance(v, list) else [v, v] for v in values]
        return rnd.choice(["\n", " ", ""]).join(map(say, values)), [x for v in values for x in v]
    values = [v if isinstance(v, dict) or style == "lines" else {"v": v} for v in values]
    values = [{"l": v} if isinstance(v, list) else v for v in values]
    return rnd.choice(["\n", "\r\n", " \n\n"] if style == "lines" else ["", "\n", " "]).join(map(say, values)), values


def carried(facts):
    inside = depth = opener = 0
    for swaps, both in facts:
        yield inside, depth, opener
        delta, low, opened = both[inside]
        opener = opened if depth + low <= 0 else opener
        inside, depth = (inside + swaps) % 2, depth + delta


@pytest.mark.parametrize("seed", range(6))
def test_json_records_of_ranges(seed):
    rnd = random.Random(seed)
    for _ in range(40):
        text, records = layout(rnd, [random_value(rnd) for _ in range(rnd.randint(0, 6))])
        raw = text.encode()
        handle = Held(raw)
        for chunk in (1, 2, 3, 7, 50, 1 << 20):
            starts = range(0, len(raw), chunk)
            facts = []
            for start in starts:
                lead = jsonranges._lead(handle, start)
                facts.append(jsonranges.range_facts(np.frombuffer(lead + raw[start:start + chunk], np.uint8), len(lead)))
            got = []
            for start, state in zip(starts, carried(facts)):
                got += [(at, json.loads(v)) for at, v in jsonranges.values_in(handle, start, min(start + chunk, len(raw)), len(raw), *state)]
            assert got == sorted(got, key=lambda g: g[0])
            assert [v for _, v in got] == records, (chunk, text)


TEXTS = ["1", "-7", "+3", "007", "9223372036854775807", "9223372036854775808", "1.5", "1e3", ".5", "inf", "NaN", "1_0", " 1", "true", "FALSE",
         "2024-02-29", "2023-02-29", "2024-01-02", "2024-01-02 03:04:05", "2024-01-02T03:04:05.25+01:00", "2024-01-02T25:00:00", "20240102", "x", "٣"]
ALONE = ["BIGINT", "BIGINT", "BIGINT", "BIGINT", "BIGINT", "DOUBLE", "DOUBLE", "DOUBLE", "DOUBLE", "DOUBLE", "DOUBLE", "VARCHAR", "VARCHAR", "BOOLEAN", "BOOLEAN",
         "DATE", "VARCHAR", "DATE", "TIMESTAMP", "TIMESTAMP", "VARCHAR", "BIGINT", "VARCHAR", "VARCHAR"]


def test_text_types_fold_in_any_order():
    assert [fieldtypes.type_of(fieldtypes.fold_texts([v])) for v in TEXTS] == ALONE
    rnd = random.Random(1)
    for _ in range(200):
        values = rnd.choices([*TEXTS, "", None], k=rnd.randint(0, 6))
        whole = fieldtypes.fold_texts(values)
        apart = fieldtypes.UNSEEN
        for v in values:
            apart &= fieldtypes.fold_texts([v])
        cut = rnd.randint(0, len(values))
        assert whole == apart == fieldtypes.fold_texts(values[cut:], fieldtypes.fold_texts(values[:cut]))
    assert fieldtypes.type_of(fieldtypes.fold_texts(["2024-01-02", "2024-01-02 10:00:00"])) == "TIMESTAMP"
    assert fieldtypes.type_of(fieldtypes.fold_texts(["1", "2.5", ""])) == "DOUBLE" and fieldtypes.type_of(fieldtypes.UNSEEN) == "VARCHAR"


def write(path, text):
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(text)


def workbook_of(rows):
    """A sheet whose texts are shared strings."""
    main, office = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006/relationships"
    texts = list(dict.fromkeys(v for row in rows for v in row))
    place = {v: i for i, v in enumerate(texts)}
    cells = "".join("<row>" + "".join(f'<c t="s"><v>{place[v]}</v></c>' for v in row) + "</row>" for row in rows)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="a" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><t>{v}</t></si>" for v in texts) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>')
    return out.getvalue()


def types_of(record):
    return {c["name"]: c["type"] for c in json.loads(record.schema_json)}


def test_a_type_or_field_first_met_in_the_last_record(spark, tmp_path):
    """Beyond any sample, in every format, with one range for the file and with many."""
    root = tmp_path / "late"
    root.mkdir()
    many = 3000
    rows = [(str(i), str(i / 2), "", "true") for i in range(many)] + [("x", "7", "2024-01-02", "true")]
    for name, sep in (("t.csv", ","), ("t.tsv", "\t")):
        with open(root / name, "w", newline="") as f:
            csv.writer(f, delimiter=sep).writerows([("a", "f", "late", "b"), *rows])
    documents = [{"a": i, "b": True} for i in range(many)] + [{"a": "x", "late": 1.5}]
    write(root / "lines.json", "\n".join(map(json.dumps, documents)))
    write(root / "array.json", json.dumps(documents, indent=1))
    write(root / "more.ndjson", "\n".join(map(json.dumps, documents)) + "\n")
    with open(root / "w.xlsx", "wb") as f:
        f.write(workbook_of([("a", "f", "late", "b"), *rows]))
    text = {"a": "VARCHAR", "f": "DOUBLE", "late": "DATE", "b": "BOOLEAN"}
    said = {"a": "VARCHAR", "b": "BOOLEAN", "late": "DOUBLE"}
    for chunk in (None, 997):
        files = listing.scannable(listing.list_files(spark, str(root), "*"))
        found = {r.relative_path: r for r in catalog.scan_files(spark, files, chunk=chunk).collect()}
        assert {n: types_of(r) for n, r in found.items()} == {
            "t.csv": text, "t.tsv": text, "w.xlsx": text, "lines.json": said, "array.json": said, "more.ndjson": said}
        assert {r.row_count for r in found.values()} == {many + 1} and not any(r.error for r in found.values())
        assert all(len(json.loads(r.sample_rows)) == 5 for r in found.values())
        assert [c["name"] for c in json.loads(found["array.json"].schema_json)] == ["a", "b", "late"]


def test_one_record_over_many_ranges(spark, tmp_path):
    long = "long \\\"{[ \n" * 50
    write(tmp_path / "q.csv", 'a,b\n1,"' + "x,\n" * 100 + '"\n2,3\nz,4\n')
    write(tmp_path / "head.csv", '"a' + "\n" * 90 + '",b\n1,2\n')
    write(tmp_path / "big.json", json.dumps([{"a": 1, "t": long}, {"a": 2.5, "t": long}, {"z": None}]))
    write(tmp_path / "one.json", json.dumps({"deep": {"list": [long, {"a": [1, 2]}]}, "n": 1}, indent=2))
    for chunk in (5, 64):
        found = {r.relative_path: r for r in catalog.scan_files(spark, listing.list_files(spark, str(tmp_path), "*"), chunk=chunk).collect()}
        assert (found["q.csv"].row_count, types_of(found["q.csv"])) == (3, {"a": "VARCHAR", "b": "VARCHAR"})
        assert (found["head.csv"].row_count, types_of(found["head.csv"])) == (1, {"a" + "\n" * 90: "BIGINT", "b": "BIGINT"})
        assert (found["big.json"].row_count, types_of(found["big.json"])) == (3, {"a": "DOUBLE", "t": "VARCHAR", "z": "VARCHAR"})
        assert (found["one.json"].row_count, types_of(found["one.json"])) == (1, {"deep": "VARCHAR", "n": "BIGINT"})
        assert not any(r.error for r in found.values())


def test_json_that_does_not_close_or_parse(spark, tmp_path):
    for name, text in {"open.json": '{"a": 1}\n{"a": ', "extra.json": '{"a": 1}}', "word.json": '{"a": 1}\noops\n{"a": 2}\n', "empty.json": "", "blank.json": " \n",
                       "scalars.json": "1\n2.5\nnull\n", "tail.json": '{"a": 1}\n3'}.items():
        write(tmp_path / name, text)
    for chunk in (2, 1 << 20):
        found = {r.relative_path[:-5]: r for r in catalog.scan_files(spark, listing.list_files(spark, str(tmp_path), "*"), chunk=chunk).collect()}
        assert {n: r.row_count for n, r in found.items()} == {"open": 1, "extra": 1, "word": 2, "empty": 0, "blank": 0, "scalars": 3, "tail": 2}
        assert {n for n, r in found.items() if r.error} == {"open", "extra", "word"}
        assert types_of(found["scalars"]) == {"value": "DOUBLE"} and types_of(found["empty"]) == {}
        assert types_of(found["tail"]) == {"a": "BIGINT", "value": "BIGINT"}


def test_drift_of_a_late_type(spark, tmp_path):
    def described(n, rows):
        (tmp_path / n).mkdir()
        write(tmp_path / n / "t.csv", "id,v\n" + "\n".join(f"{i},{i}" for i in range(2000)) + rows)
        return catalog.scan_catalog(spark, f"{tmp_path}/{n}").select("relative_path", "schema_json")

    changes = drift.catalog_drift(described("old", "\n1,2\n"), described("new", "\n1,two\n"), ["relative_path"])
    assert [tuple(r) for r in changes.select("kind", "name", "old_type", "new_type").collect()] == [("TypeChanged", "v", "BIGINT", "VARCHAR")]


def test_schema_of_a_dataset_of_several_files(spark, tmp_path):
    for name, text in {"a.csv": "i,f,d,e\n1,1,2024-01-02,\n", "b.csv": "i,f,d,e\n2,2.5,2024-01-02 10:00:00,\n", "c.csv": "f,g\n,x\n", "d.csv": "i,f\n"}.items():
        write(tmp_path / name, text)
    columns = catalog.schema_columns(catalog.scan_catalog(spark, str(tmp_path)).withColumn("dataset", F.lit("t")), ["dataset"], stored=True)
    assert {r.name: r.type for r in catalog.dataset_schema(columns, ["dataset"]).collect()} == {
        "i": "BIGINT", "f": "DOUBLE", "d": "TIMESTAMP", "e": "VARCHAR", "g": "VARCHAR"}
