"""Suffix-array, SimHash and substring dedup against plain versions."""

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from cairnbook.llm import components, simhash, substring_dedup, suffix_dedup  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, block int, payload string, fp string"  # further columns with names the operators use


def same(got, want):
    key = lambda row: tuple(map(str, row))
    assert sorted(got, key=key) == sorted(want, key=key)


@pytest.fixture(scope="module")
def documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df, [(r.doc_id, r.text) for r in df.collect()]


def odd_rows(seed, pieces, many=120, longest=70):
    rnd = random.Random(seed)
    rows = []
    for _ in range(many):
        text = rnd.choice([None, "", " ", *["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, longest))) for _ in range(4)]])
        rows.append((rnd.choice([None, 1, 2, 3, 4, 5, 6]), text))
    rows += rows[:10]  # repeated rows
    rows.append((9, "".join(rnd.choice(pieces) for _ in range(40_000))))  # a very long text
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, None, "x") for d, t in rows], SCHEMA)


def suffix_rows(df, **options):
    return [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(df, **options).collect()]


def test_maximal_repeats_with_all_occurrences():
    rnd = random.Random(4)
    for _ in range(150):
        texts = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 14))) for _ in range(rnd.randint(1, 4))]
        least, seen = rnd.randint(1, 4), {}
        for t, x in enumerate(texts):
            for i in range(len(x)):
                for j in range(i + least, len(x) + 1):
                    seen.setdefault(x[i:j], []).append((t, i))
        want = set()
        for s, places in seen.items():
            left = {texts[t][i - 1] if i else (t, i) for t, i in places}
            right = {texts[t][i + len(s)] if i + len(s) < len(texts[t]) else (t, i) for t, i in places}
            if len(places) > 1 and len(left) > 1 and len(right) > 1:
                want.add((len(s), tuple(sorted(places))))
        found, _, ends = suffix_dedup.maximal_repeats(texts, least)
        begin = [0, *(int(e) + 1 for e in ends[:-1])]

        def place(p, begin=begin):
            t = max(i for i, b in enumerate(begin) if b <= p)
            return t, int(p) - begin[t]

        assert {(n, tuple(sorted(map(place, starts)))) for n, starts in found} == want


def test_suffix_dedup_on_documents(documents):
    df, rows = documents
    same(suffix_rows(df), brute.suffix(rows, 400))


@pytest.mark.parametrize("options", [{}, {"crowd": 1}, {"bucket_bytes": 1}])
def test_suffix_dedup_on_odd_rows(spark, options):
    """Nulls, empty and long texts, repeated rows, crowded anchors, split buckets."""
    rows = odd_rows(1, ["a", "b", "é"])
    same(suffix_rows(frame(spark, rows), length=9, **options), brute.suffix(rows, 9))


def test_suffix_dedup_cuts_parts_anywhere(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_PART", 16)
    rows = odd_rows(2, ["a", "b"], many=40)[:-1]
    same(suffix_rows(frame(spark, rows), length=6), brute.suffix(rows, 6))


def substring_rows(df, **options):
    return [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.substring_dedup(df, **options).collect()]


def test_substring_dedup_on_documents(documents):
    df, rows = documents
    same(substring_rows(df), brute.substring(rows, 13))


@pytest.mark.parametrize("window", [1, 2, 5, 13])
def test_substring_dedup_on_odd_rows(spark, window):
    rows = odd_rows(window, ["a ", "b\n", "é  ", "c\t", "d"])
    same(substring_rows(frame(spark, rows), window=window), brute.substring(rows, window))


def test_substring_text_is_what_is_kept(spark):
    words = [f"w{i}" for i in range(30)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, "x  y\n" + " ".join(words[5:25]) + " z")], "doc_id long, text string")
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(df).collect()}
    assert got[2].kept_text == "x y z" and got[2].n_removed == 20 and got[1].n_removed == 0


def simhash_rows(df, **options):
    return [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df, **options).collect()]


def test_simhash_on_documents(documents):
    df, rows = documents
    same(simhash_rows(df), brute.simhash(rows))


def test_simhash_on_odd_rows(spark):
    rows = odd_rows(7, ["A ", "b\n", "É  ", "c"], longest=9)
    same(simhash_rows(frame(spark, rows)), brute.simhash(rows))


@pytest.mark.parametrize("bits,crowd", [(4, 20_000), (4, 1), (3, 1), (2, 5)])
def test_links_connect_whatever_is_close(spark, bits, crowd):
    """Also for buckets too full to be brought together."""
    rnd = random.Random(3)
    values = set()
    for base in [rnd.getrandbits(64) for _ in range(4)]:
        for _ in range(40):
            x = base
            for _ in range(rnd.randint(0, 5)):
                x ^= 1 << rnd.randrange(64)
            values.add(x)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in values], "fp long")
    edges = simhash.links(df, max_bits=bits, crowd=crowd)
    got = {r.node % (1 << 64): r.root for r in components.components(edges).collect()}
    want = {}
    for x, root in brute.groups(values, bits).items():
        want.setdefault(root, set()).add(x)
    found = {}
    for x in values:
        found.setdefault(got.get(x, ("alone", x)), set()).add(x)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).selectExpr("id AS u", "id + 1 AS v").where("u <> 100")
    got = {r.node: r.root for r in components.components(edges).collect()}
    assert got == {i: 0 if i <= 100 else 101 for i in range(301)}


def test_no_join_of_keys_or_edges_goes_through_the_driver(spark, tmp_path, monkeypatch):
    """Files of few MB become many rows: neither the keys of fingerprints nor a large edge table may be broadcast."""
    plans = []

    def seen(df, label):
        plans.append((label, df._jdf.queryExecution().toString()))
        return written(df, label)

    written = simhash.written
    monkeypatch.setattr(simhash, "written", seen)
    monkeypatch.setattr(components, "written", seen)
    monkeypatch.setattr(components, "MERGED_EDGES", 2, raising=False)
    path = str(tmp_path / "prints")
    spark.range(300).selectExpr("id * 7 AS fp").write.parquet(path)
    for crowd in (20_000, 2):
        edges = simhash.links(spark.read.parquet(path), crowd=crowd)
        plans.append(("links", edges._jdf.queryExecution().toString()))
        found = components.components(edges)
        assert found.where("root = 0").count() == found.count() == 300
    assert {label for label, _ in plans} >= {"buckets", "links", "edges"}
    assert not [label for label, plan in plans if "BroadcastExchange" in plan]


def test_one_document_of_each_group_stays(spark):
    text = " ".join(f"w{i}" for i in range(50))
    df = spark.createDataFrame([(3, text, "c"), (1, text, "a"), (1, text, "b"), (2, "other", "d"), (None, text, "e")],
                               "doc_id long, text string, row_key string")
    got = simhash.one_of_each(df)
    assert got.columns == df.columns and sorted((r.doc_id, r.text) for r in got.collect()) == [(1, text), (2, "other")]


def test_empty_tables(spark):
    df = frame(spark, [(1, "x")]).limit(0)
    for result in (suffix_dedup.suffix_dedup(df), substring_dedup.substring_dedup(df), simhash.near_duplicates(df), simhash.one_of_each(df)):
        assert result.collect() == []
