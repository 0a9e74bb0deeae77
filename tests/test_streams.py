"""Streams of folder changes, over several runs of the same checkpoint."""

import os

import pytest

from cairnbook.streaming import changes, jobs


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def run(spark, root, state, published=False):
    out = f"{state}/out"
    if published:
        changes.publish(spark, root, f"{state}/manifests")
    jobs.run_batches(changes.watch_changes(spark, root, f"{state}/manifests", published=published),
                     lambda df, n: jobs.write_batch(df, out, n), f"{state}/ck")
    rows = spark.read.parquet(out).select("batch_id", "change", "relative_path", "size_bytes").collect()
    return sorted((r.batch_id, r.change, r.relative_path, r.size_bytes) for r in rows)


@pytest.mark.parametrize("published", [False, True])
def test_every_change_is_told_once(spark, tmp_path, published):
    root, state = str(tmp_path / "lake"), str(tmp_path / "state")
    for name in ("a.csv", "sub/b.csv", "sub/deep/c.json", "node_modules/x.csv", "t.tmp"):
        write(f"{root}/{name}", "x\n1\n")
    first = [(0, "created", n, 4) for n in ("a.csv", "sub/b.csv", "sub/deep/c.json")]
    assert run(spark, root, state, published) == first
    assert run(spark, root, state, published) == first  # nothing new, also after a restart
    write(f"{root}/sub/b.csv", "x\n1\n2\n")
    write(f"{root}/d.csv", "")
    os.remove(f"{root}/a.csv")
    second = [(1, "changed", "sub/b.csv", 6), (1, "created", "d.csv", 0), (1, "removed", "a.csv", 4)]
    assert run(spark, root, state, published) == first + second
    os.remove(f"{root}/sub/deep/c.json")
    os.rmdir(f"{root}/sub/deep")
    write(f"{root}/a.csv", "new")
    third = [(2, "created", "a.csv", 3), (2, "removed", "sub/deep/c.json", 4)]
    assert run(spark, root, state, published) == first + second + third
    assert len(changes.manifests(f"{state}/manifests")) <= 2  # what has been told is not kept


def test_a_batch_that_did_not_finish_is_told_again(spark, tmp_path):
    root, state = str(tmp_path / "lake"), str(tmp_path / "state")
    write(f"{root}/a.csv", "1")
    run(spark, root, state)
    write(f"{root}/b.csv", "1")

    def fails(df, n):
        raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        jobs.run_batches(changes.watch_changes(spark, root, f"{state}/manifests"), fails, f"{state}/ck")
    os.remove(f"{root}/a.csv")
    told = [(0, "created", "a.csv", 1), (1, "created", "b.csv", 1)]
    assert run(spark, root, state) == told  # the same rows, though the folder has moved on
    assert run(spark, root, state) == [*told, (2, "removed", "a.csv", 1)]


def test_shards_of_unequal_manifests_line_up(tmp_path, monkeypatch):
    root, folder = str(tmp_path / "lake"), str(tmp_path / "m")
    for i in range(200):
        write(f"{root}/{i % 7}/f{i}.csv", "x")
    reader = changes.ChangesReader(root, folder, False)
    told = []
    for files in (100_000, 10, 3):  # finer shards each time
        monkeypatch.setattr(changes, "SHARD_FILES", files)
        write(f"{root}/f{files}.csv", "x")
        told.append(reader.latestOffset())
    assert len({changes._facts(folder, t["manifest"])["shards"] for t in told}) > 1
    for start, end in ((reader.initialOffset(), told[0]), (told[0], told[1]), (told[0], told[2]), (told[2], told[0])):
        rows = [r for p in reader.partitions(start, end) for b in reader.read(p) for r in b.to_pylist()]
        old, new = (set() if not o["manifest"] else {p for k in range(256) for p in changes._shard_rows(
            f"{reader.folder}/{o['manifest']}/shard={k}", 0, 1)} for o in (start, end))
        assert {r["path"] for r in rows if r["change"] == "created"} == new - old
        assert {r["path"] for r in rows if r["change"] == "removed"} == old - new
        assert len(rows) == len(new ^ old)
    assert reader.partitions(told[1], told[1]) == []


def test_many_alerts_of_one_key_are_joined_in_one_sweep():
    """As by comparing each row with all alerts in the order of arrival, which takes minutes for the last case."""
    import random
    import time

    rnd = random.Random(3)
    for _ in range(200):
        old, reach = [], 5
        for at in rnd.sample(range(0, 200, 20), rnd.randint(0, 4)):
            old.append([at, at, at + rnd.randint(0, 9), rnd.randint(1, 4)])
        rows = [(*a, i) for i, a in enumerate(old)]
        for i in range(rnd.randint(0, 12)):
            lo = rnd.randint(0, 200)
            rows.append((lo, lo, lo + rnd.randint(0, 12), 1, len(old) + i))
        known, changed, gone = [list(a) for a in old], set(), set()
        for born, lo, hi, n, _ in rows[len(old):]:
            near = [a for a in known if a[1] - reach <= hi and lo - reach <= a[2]]
            for other in near[1:]:
                known.remove(other)
                changed.discard(other[0])
                gone.add(other[0])
                near[0][1:] = [min(near[0][1], other[1]), max(near[0][2], other[2]), near[0][3] + other[3]]
            if not near:
                near = [[born, lo, hi, 0]]
                known.append(near[0])
            near[0][1:] = [min(near[0][1], lo), max(near[0][2], hi), near[0][3] + n]
            changed.add(near[0][0])
        got, touched = jobs._joined_alerts(rows, len(old), reach)
        assert got == known
        assert sorted(a for a in touched if a[3]) == sorted(a for a in known if a[0] in changed)
        assert {a[0] for a in touched if not a[3]} == gone & {a[0] for a in old}
    began = time.monotonic()
    many = [(20 * i, 20 * i, 20 * i + 1, 1, i) for i in range(100_000)]
    assert len(jobs._joined_alerts(many, 0, 5)[0]) == 100_000 and time.monotonic() - began < 20


def test_keys_share_states_and_keep_their_own_alerts(spark, tmp_path, monkeypatch):
    """Few states hold the alerts of many keys; the rows told and their ids are those of keys by themselves."""
    import random

    from pyspark.sql import functions as F

    rnd = random.Random(5)
    keys = [(user, kind) for user in (None, 2**53, 2**53 + 1, *range(40)) for kind in (None, "a", "b")]
    events, inbox = [], f"{tmp_path}/inbox"
    for batch in range(4):
        part = [(*k, 5000 + 400 * batch + rnd.randint(-500, 0)) for k in keys for _ in range(rnd.randint(0, 4))]
        spark.createDataFrame(part, "user long, kind string, s long").select("user", "kind", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode(
            "append").parquet(inbox)
        events += part
    told, left = {}, {}
    for groups in (3, 4096):
        monkeypatch.setattr(jobs, "ALERT_GROUPS", groups, raising=False)
        stream = spark.readStream.schema("user long, kind string, ts timestamp").option("maxFilesPerTrigger", "1").parquet(inbox)
        out, checkpoint = f"{tmp_path}/out{groups}", f"{tmp_path}/ck{groups}"
        jobs.run_batches(jobs.alert_states(stream, ["user", "kind"], "ts"), lambda df, n, out=out: jobs.write_batch(df, out, n), checkpoint, "update")
        states = spark.read.parquet(out)
        told[groups] = sorted(map(str, states.collect()))
        left[groups] = spark.read.format("statestore").load(checkpoint).count()
    assert told[3] == told[4096]
    assert left[3] <= 3 < left[4096] <= len(keys)
    want = []
    for key in keys:
        times = sorted(s for *k, s in events if tuple(k) == key)
        ends = [i for i, s in enumerate(times) if i + 1 == len(times) or times[i + 1] - s > 60]
        want += [(*key, times[a], times[b], b - a + 1) for a, b in zip([0, *(e + 1 for e in ends)], ends)]
    got = jobs.current_alerts(states, ["user", "kind"]).select("user", "kind", F.unix_seconds("first_seen"), F.unix_seconds("last_seen"), "repeats")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
