"""Exact duplicates against plain grouping; the filters against sets."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from cairnbook.llm import exact_dedup, fuse

SCHEMA = "doc_id long, n int, text string, batch int, top string, digest string"


def plain(rows):
    """Rows ``(doc_id, text)`` to the multiset of results."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = Counter()
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        order = sorted(ids, key=lambda i: (i is not None, i or 0), reverse=True)
        for at, i in enumerate(order):
            out[(i, best, len(ids), at == 0, hashlib.sha256(text.encode()).hexdigest())] += 1
    return out


def table_of(spark, rows):
    return spark.createDataFrame([(i, 1, t, 2, "x", "y") for i, t in rows], SCHEMA)


def result(df):
    return Counter(tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


@pytest.mark.parametrize("count", [0, 1, 2, 3, 10, 257, 5000, 200_000])
def test_filters_hold_their_keys_and_few_others(count):
    rnd = np.random.default_rng(count)
    keys = rnd.integers(0, 1 << 64, count, np.uint64)
    made = fuse.build(np.concatenate((keys, keys[: count // 2])))
    assert fuse.may_hold(made, keys).all()
    others = np.setdiff1d(rnd.integers(0, 1 << 64, 100_000, np.uint64), keys)
    assert fuse.may_hold(made, others).mean() < (0.006 if count else 1e-9)
    assert count < 200_000 or len(made) < 1.2 * count  # nine bits a key once there are many


def rows_of(seed, many=300):
    rnd = random.Random(seed)
    texts = ["", "a", "b", "A", "a ", "á", "á", "long " * 30_000, "long " * 30_000 + "x", *(f"t{i}" for i in range(60))]
    rows = [(rnd.choice([None, *range(400)]), rnd.choice([None, *texts])) for _ in range(many)]
    return rows + [(i, "a third of all rows") for i in range(1000, 1000 + many // 2)] + rows[:20]


@pytest.mark.parametrize("options", [{}, {"batches": 1}, {"batches": 3, "shard_digests": 10}, {"digest_bytes": 1}, {"digest_bytes": 0, "batches": 3}])
def test_equal_texts(spark, options):
    rows = rows_of(len(options))
    assert result(exact_dedup.exact_dedup(table_of(spark, rows), **options)) == plain(rows)


def test_empty_table_and_null_texts(spark):
    assert result(exact_dedup.exact_dedup(table_of(spark, []))) == Counter()
    assert result(exact_dedup.exact_dedup(table_of(spark, [(None, None)] * 3 + [(None, "")]))) == plain([(None, None)] * 4)


def test_filters_screen_what_a_snapshot_has_not(spark):
    old = exact_dedup.freeze(table_of(spark, [(i, f"text {i}") for i in range(3000)]), 0, shard_digests=300)
    new = exact_dedup.freeze(table_of(spark, [(i, f"text {i}") for i in range(2900, 9000)]), 1)
    past = {bytes(r.digest) for r in exact_dedup.screened(new.groups, old).collect()}
    shared = {hashlib.sha256(f"text {i}".encode()).digest() for i in range(2900, 3000)}
    assert shared <= past and len(past) < 100 + 6000 * 0.02
    assert {bytes(r.digest) for r in exact_dedup.matches(new.groups, old).collect()} == shared


def test_unique_keeps_one_of_each(spark):
    docs = table_of(spark, [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "b")])
    assert sorted((r.doc_id, r.text) for r in exact_dedup.unique(docs).collect()) == [(2, "a"), (4, ""), (5, "b")]


def test_unique_texts_stay_where_they_are(spark):
    """Only rows of groups are fetched for the byte check."""
    snapshots = [exact_dedup.freeze(table_of(spark, [(i, f"text {i % 40}") for i in range(lo, lo + 30)]), n) for n, lo in enumerate((0, 30))]
    rows = exact_dedup.deduplicate(snapshots)
    fetched = exact_dedup._texts_of(snapshots, rows.withColumn("digest", rows["sha"]).where("n > 1"), placed=True)
    assert fetched.count() == 40
