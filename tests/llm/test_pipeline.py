"""The corpus pipeline stage by stage, the queries with SQL twins, and what stays when the operators are gone."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__)), os.path.join(ROOT, "tools")]

import brute  # noqa: E402
import check_oracle  # noqa: E402
import corpus_pipeline  # noqa: E402

from cairnbook.llm import langid, queries, secret_scan, simhash  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "benchmark_free", "secrets", "packed"]
    now = stages["language"](spark, docs, SF)
    assert now.schema == docs.schema and now.count() >= 0.98 * docs.count()
    before = [(r.doc_id, r.text) for r in now.collect()]
    now = stages["near_duplicates"](spark, now, SF)
    want = sorted({component for _, _, component in brute.simhash(before)})
    assert now.schema == docs.schema and sorted(r.doc_id for r in now.collect()) == want
    before = [(r.doc_id, r.text) for r in now.collect()]
    now = stages["benchmark_free"](spark, now, SF)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(r.doc_id for r in now.collect()) == sorted(d for d, *_, hit in brute.decontamination(before, items) if not hit)
    before = {r.doc_id: r for r in now.collect()}
    now = stages["secrets"](spark, now, SF)
    for r in now.collect():
        assert not brute.secrets(r.text)
        assert r.text != before[r.doc_id].text or r == before[r.doc_id]
    got = stages["packed"](spark, now, SF).collect()
    assert {r.doc_id for r in got} == set(before)
    assert len(got) == corpus_pipeline.run(spark, SF).count()


def test_every_stage_takes_nulls_repeats_and_empty_tables(spark):
    prose, shout = "the and of the and with that the of", "the and " * 50_000
    rows = [(None, None, None, None, None, "r"), (1, prose, None, None, 5, "p"), (1, prose, None, None, 5, "q"), (2, None, "en", None, None, None),
            (3, "", "en", "s", 0, "z"), (4, shout, "en", "s", 0, "z"), (None, "password = hunter2hunter2", None, None, 25, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, row string")
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in stages.items():
        got = stage(spark, docs.limit(0), SF)
        assert got.count() == 0 and (name == "packed" or got.columns == docs.columns)
    left = {name: sorted(map(tuple, stages[name](spark, docs, SF).collect()), key=repr) for name in stages}
    ids = {name: [r[0] for r in rows] for name, rows in left.items()}
    assert {1, 4} <= set(ids["language"]) and 2 not in ids["language"] and 3 not in ids["language"]
    # Null and empty texts are one group, and so are both rows of document 1.
    assert sorted(map(repr, ids["near_duplicates"])) == sorted(["2", "1", "4", "None"])
    assert left["benchmark_free"] == sorted(rows, key=repr)
    assert left["secrets"] == sorted([*rows[:-1], (None, "[secret]", None, None, 8, "s")], key=repr)
    lengths = {}
    for doc, _, length, *_ in left["packed"]:
        lengths[doc] = lengths.get(doc, 0) + length
    assert set(lengths) == {None, 1, 2, 3, 4} and lengths[2] == lengths[3] == 1 and lengths[4] == 100_002  # words, the last blank, id 0


def test_language_stage_keeps_a_table_without_labels(spark):
    docs = spark.createDataFrame([(i, f"words of {i}", None) for i in range(20)], "doc_id long, text string, lang string")
    assert corpus_pipeline.language(spark, docs, SF).count() == 20
    assert langid.accepted(docs, None, without_model="drop").count() == 0


def test_samples_never_exceed_their_bound(spark, monkeypatch):
    """Neither rows without id, nor copies, nor many rows of one id."""
    rows = [(None, f"text without id {i}", "en") for i in range(3000)] + [(7, "a copy", "de")] * 3000 + [(9, f"of one id {i}", "de") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taught = []
    monkeypatch.setattr(secret_scan, "train", lambda texts, **_: taught.append(texts))
    secret_scan.field_of(docs, sample_rows=100)
    assert 60 < len(taught[0]) == len(set(taught[0])) <= 100
    assert 10 < sum("without" in t for t in taught[0]) < 90  # all kinds of rows, by their share of different ones
    sample = langid.labelled_sample(docs, per_language=50)
    assert len(sample) == len(set(sample)) <= 100 and all("without" not in text for _, text in sample)


def test_one_document_of_each_by_id_and_text(spark):
    far = ["".join(chr(97 + (i * j) % 26) + " " * (j % 3 == 0) for j in range(1, 400)) for i in (1, 3, 5)]
    rows = [(None, far[0]), (None, far[0]), (None, far[1]), (5, far[2]), (5, far[2]), (6, far[2])]
    got = simhash.one_of_each(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _id int"))
    assert got.columns == ["doc_id", "text", "_id"]
    assert sorted((r.doc_id or 0, r.text) for r in got.collect()) == sorted([(0, far[0]), (0, far[1]), (5, far[2])])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_twins(spark, name):
    assert check_oracle.compare(queries.QUERIES[name](spark, SF), check_oracle.connect(SF), queries.ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_queries_return_a_row_per_document_or_more(spark, name):
    got = queries.QUERIES[name](spark, SF)
    assert got.select("doc_id").distinct().count() == 200


def test_entry_without_the_operators(tmp_path):
    shutil.copytree(os.path.join(ROOT, "cairnbook"), tmp_path / "cairnbook", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert 'pipeline' not in e.queries() and not any(q.startswith('op1_') for q in e.queries()); print(len(e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120,
                          env={**os.environ, "PYTHONPATH": str(tmp_path)})
    assert said.returncode == 0, said.stderr
