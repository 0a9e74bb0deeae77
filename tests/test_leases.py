"""Leases, fencing at commit, and Parquet copies that one of several jobs makes."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from cairnbook.operators import copies, keyed, leases
from cairnbook.streaming import jobs


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_one_holder_at_a_time(spark, tmp_path):
    folder = str(tmp_path / "l")
    first = leases.acquire(spark, folder, 60)
    with pytest.raises(leases.LeaseTaken):
        leases.acquire(spark, folder, 60)
    first.release()
    with leases.held(spark, folder, 60) as second:
        assert second.number == first.number + 1
        second.check()
        with pytest.raises(leases.LeaseLost):
            first.renew()
    assert leases.acquire(spark, folder, 60).number == 3


def test_a_dead_holder_loses_its_lease(spark, tmp_path):
    folder = str(tmp_path / "l")
    dead = leases.acquire(spark, folder, 1)
    began = time.monotonic()
    alive = leases.acquire(spark, folder, 60, wait=30, pause=0.1)
    assert 0.5 < time.monotonic() - began < 20 and alive.number == 2
    with pytest.raises(leases.LeaseLost):
        dead.check()
    dead.release()  # does not end the lease of its follower
    alive.check()
    with pytest.raises(leases.LeaseTaken):
        leases.acquire(spark, folder, 60)


def test_a_holder_that_goes_on_renews(spark, tmp_path):
    folder = str(tmp_path / "l")
    with leases.held(spark, folder, 1.5):
        time.sleep(4)
        with pytest.raises(leases.LeaseTaken):
            leases.acquire(spark, folder, 1.5)


def test_many_jobs_one_lease(spark, tmp_path):
    folder, got, inside, worst = str(tmp_path / "l"), [], [0], [0]

    def work():
        with leases.held(spark, folder, 60, wait=60) as lease:
            inside[0] += 1
            worst[0] = max(worst[0], inside[0])
            time.sleep(0.05)
            inside[0] -= 1
            got.append(lease.number)

    threads = [threading.Thread(target=work) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got) == [1, 2, 3, 4] and worst[0] == 1


def test_what_a_late_holder_commits_is_refused(spark, tmp_path):
    base, folder = str(tmp_path / "t"), str(tmp_path / "l")
    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    old = leases.acquire(spark, folder, 0)
    new = leases.acquire(spark, folder, 60)
    keyed.upsert(rows, base, ["k"], lease=old)  # nobody has written since: still in order
    keyed.upsert(rows.withColumn("v", F.lit("new")), base, ["k"], lease=new)
    with pytest.raises(leases.LeaseLost):
        keyed.upsert(rows, base, ["k"], lease=old)
    assert keyed.read(spark, base).first().v == "new" and keyed.compact(spark, base).fence == new.number


def test_one_sync_per_folder(spark, tmp_path):
    root, base, state = (str(tmp_path / n) for n in ("lake", "catalog", "state"))
    write(f"{root}/a.csv", "x\n1\n")
    other = leases.acquire(spark, f"{state}/lease", 60)
    with pytest.raises(leases.LeaseTaken):
        jobs.catalog_of_changes(spark, root, base, state)
    assert keyed.version(spark, base) is None
    other.release()
    jobs.catalog_of_changes(spark, root, base, state)
    write(f"{root}/b.json", '{"x": 1}\n{"y": "late"}')
    os.remove(f"{root}/a.csv")
    jobs.catalog_of_changes(spark, root, base, state)
    rows = keyed.read(spark, base).collect()
    assert [(r.relative_path, r.row_count) for r in rows] == [("b.json", 2)] and "late" in rows[0].sample_rows


def test_text_is_read_once_per_state(spark, tmp_path, monkeypatch):
    path, cache, read = str(tmp_path / "t.csv"), str(tmp_path / "cache"), []
    write(path, "id,name\n1,a\n2,b\n")
    ladder = copies.read_csv_ladder
    monkeypatch.setattr(copies, "read_csv_ladder", lambda *a: read.append(a[1]) or ladder(*a))
    for _ in range(2):
        rows = {r.column_name: (r["count"], r.max) for r in copies.profile_path(spark, path, cache).collect()}
        assert rows == {"id": (2, "2"), "name": (2, "b")}
    assert [tuple(r) for r in copies.preview_path(spark, path, cache, [F.asc("id")]).collect()] == [("1", "a"), ("2", "b")]
    assert len(read) == 1
    plan = copies.profile_path(spark, path, cache)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan and "FileScan csv" not in plan
    write(path, "id,name\n1,a\n2,b\n30,c\n")
    assert copies.table(spark, path, cache).count() == 3 and len(read) == 2
    jobs_made = []

    def convert():
        jobs_made.append(copies.parquet_copy(spark, path, str(tmp_path / "other")))

    threads = [threading.Thread(target=convert) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len({p for p, _ in jobs_made}) == 1 and sorted(made for _, made in jobs_made) == [False, False, True]
    with pytest.raises(FileNotFoundError):
        copies.table(spark, str(tmp_path / "none.csv"), cache)


def test_copies_of_other_formats(spark, tmp_path):
    cache = str(tmp_path / "cache")
    write(str(tmp_path / "a.json"), '{"a": 1}\n{"a": 2}\n')
    write(str(tmp_path / "a.tsv"), "a\tb\n1\t2\n")
    spark.range(3).write.parquet(str(tmp_path / "p.parquet"))
    assert copies.table(spark, str(tmp_path / "a.json"), cache).count() == 2
    assert copies.table(spark, str(tmp_path / "a.tsv"), cache).columns == ["a", "b"]
    assert copies.table(spark, str(tmp_path / "p.parquet"), cache).count() == 3 and len(os.listdir(cache)) == 2
