"""Tables in hash partitions against plain dictionaries; what a change rewrites; writers side by side; batches run again."""

import os
import random
import threading

import pytest

from cairnbook.operators import keyed, sinks
from pyspark.sql import functions as F


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def files_below(base):
    return {os.path.join(d, f) for d, _, names in os.walk(base) for f in names if f.endswith(".parquet")}


def test_a_change_rewrites_the_partitions_of_its_keys(spark, tmp_path):
    base = str(tmp_path / "t")
    keyed.upsert(spark.range(1000).select("id", F.lit("old").alias("v")), base, ["id"], buckets=64)
    before, held = files_below(base), keyed.version(spark, base)
    made = keyed.upsert(spark.createDataFrame([(i * 100, "new") for i in range(10)], "id long, v string"), base, ["id"])
    rewritten = [k for k in range(64) if made.places[k] != held.places[k]]
    fresh = files_below(base) - before
    assert 1 <= len(rewritten) <= 10 and {p.split("_bucket=")[1].split("/")[0] for p in fresh} == {str(k) for k in rewritten}
    assert before <= files_below(base)  # readers of the older version can finish
    assert rows_of(keyed.read(spark, base)) == rows_of(spark.range(1000).select("id", F.when(F.col("id") % 100 == 0, "new").otherwise("old")))
    assert rows_of(keyed.lookup(spark, base, spark.createDataFrame([(100,), (5000,), (1,)], "id long"))) == [(1, "old"), (100, "new")]
    assert rows_of(keyed.read(spark, base, held.number)) == [(i, "old") for i in sorted(range(1000), key=lambda i: repr((i, "old")))]


def test_updates_deletes_and_compaction_against_a_dictionary(spark, tmp_path):
    base, rnd, plain = str(tmp_path / "t"), random.Random(3), {}
    for step in range(6):
        updates = [(rnd.choice([None, "a", "b"]), rnd.randint(0, 40), rnd.randint(0, 3), rnd.choice([None, "x", "y"])) for _ in range(30)]
        for k, n, seq, v in sorted(updates, key=lambda u: (u[2], u[3] is not None, u[3] or "")):
            plain[k, n] = (seq, v)
        # Null keys are rows of their own and never met by a join; they are left out here.
        updates = [u for u in updates if u[0] is not None]
        keyed.upsert(spark.createDataFrame(updates, "k string, n int, seq int, v string"), base, ["k", "n"], "seq", buckets=8)
        plain = {key: v for key, v in plain.items() if key[0] is not None}
        gone = rnd.sample(sorted(plain), 3)
        keyed.delete(spark.createDataFrame(gone, "k string, n int"), base, ["k", "n"])
        plain = {key: v for key, v in plain.items() if key not in gone}
        if step == 3:
            made = keyed.compact(spark, base, buckets=32)
            assert made.buckets == 32 and len({p.split("/")[0] for p in made.places if p}) == 1
        assert rows_of(keyed.read(spark, base)) == sorted(((*key, *v) for key, v in plain.items()), key=repr)


def test_equal_sequence_numbers_leave_one_row(spark, tmp_path):
    base = str(tmp_path / "t")
    keyed.upsert(spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 4, "z")], "k int, seq int, v string"), base, ["k"], "seq")
    assert rows_of(keyed.read(spark, base)) == [(1, 5, "b")]


def test_two_writers_and_a_batch_run_again(spark, tmp_path):
    base = str(tmp_path / "t")
    keyed.upsert(spark.createDataFrame([(0, "w")], "k int, v string"), base, ["k"], buckets=4)
    failed = []

    def writer(name):
        try:
            for i in range(3):
                keyed.upsert(spark.createDataFrame([(i, name), (100 + hash(name) % 50, str(i))], "k int, v string"), base, ["k"], attempts=20)
        except Exception as exc:  # noqa: BLE001
            failed.append(exc)

    threads = [threading.Thread(target=writer, args=(n,)) for n in ("one", "two")]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and keyed.version(spark, base).number == 7
    got = dict(rows_of(keyed.read(spark, base)))
    assert {got[100 + hash(n) % 50] for n in ("one", "two")} == {"2"} and {got[i] for i in range(3)} <= {"one", "two"}
    more = spark.createDataFrame([(7, "batch")], "k int, v string")
    first = keyed.upsert(more, base, ["k"], batch=("s", 4))
    assert keyed.upsert(more.withColumn("v", F.lit("again")), base, ["k"], batch=("s", 4)).number == first.number
    assert keyed.upsert(more, base, ["k"], batch=("s", 5)).number == first.number + 1 and keyed.upsert(more, base, ["k"], batch=("t", 0)).batches == {"s": 5, "t": 0}
    with pytest.raises(ValueError, match="keyed by"):
        keyed.delete(more, base, ["v"])


def test_a_conflict_leaves_no_files(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "t")
    keyed.upsert(spark.createDataFrame([(0, "w")], "k int, v string"), base, ["k"], buckets=4)
    before, commit, calls = files_below(base), keyed._commit, []

    def taken(spark_, base_, made):
        calls.append(made.number)
        if len(calls) == 1:
            raise sinks.SnapshotConflict("taken")
        commit(spark_, base_, made)

    monkeypatch.setattr(keyed, "_commit", taken)
    keyed.upsert(spark.createDataFrame([(0, "x")], "k int, v string"), base, ["k"])
    assert calls == [2, 2] and len(files_below(base) - before) == 1


def test_old_versions_go_when_they_are_neither_new_nor_young(spark, tmp_path):
    base = str(tmp_path / "t")
    for i in range(5):
        keyed.upsert(spark.createDataFrame([(k, str(i)) for k in range(20)], "k int, v string"), base, ["k"], buckets=4, max_age_seconds=-1)
    folders = {p.split("/t/")[1].split("/")[0] for p in files_below(base)}
    assert len(folders) == 2 and keyed._numbers(spark, base) == [4, 5]


def test_catalog_updates_by_either_key(spark, tmp_path):
    """As the form that reads the whole table, whatever order ids and paths move in."""
    base, rnd = str(tmp_path / "t"), random.Random(5)
    schema = "id string, workspace_id string, path string, v int"
    whole = spark.createDataFrame([], schema)
    seq = 0
    for _ in range(5):
        updates = []
        for _ in range(12):
            seq += 1
            updates.append((f"i{rnd.randint(0, 9)}", rnd.choice("vw"), f"/p{rnd.randint(0, 5)}", seq, seq))
        rows = spark.createDataFrame(updates, f"{schema}, seq int")
        made = keyed.upsert_catalog(rows, base, "seq", buckets=8)
        whole = spark.createDataFrame(sinks.upsert_catalog(whole, rows.select(*rows.columns), "seq").collect(), schema)
        assert rows_of(keyed.read(spark, base)) == rows_of(whole)
    assert made.key == ["workspace_id", "path"]
