"""Vector codes and importance resampling against plain versions in whole numbers."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cairnbook.llm import resample, vector_codes


def plain_codes(rows, scale=1024, parts=4, entries=256, rounds=4):
    """Rows ``(vec_id, vector, label)``; all vectors of one length that ``parts`` divides."""
    sound = [(i, v, b) for i, v, b in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    sound.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(scale * x) for x in v] for _, v, _ in sound]
    wide = len(whole[0]) // parts
    cut = [[w[p * wide:(p + 1) * wide] for w in whole] for p in range(parts)]
    books = [own[:entries] for own in cut]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = [[] for _ in books[p]]
            for part in cut[p]:
                of[nearest(part, books[p])[1]].append(part)
            books[p] = [[sum(c) // len(own) for c in zip(*own)] if own else entry for own, entry in zip(of, books[p])]
    said = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    found, per_label = [], Counter()
    for at, (i, _, label) in enumerate(sound):
        best = [nearest(cut[p][at], books[p]) for p in range(parts)]
        found.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
        per_label[label] += found[-1][2]
    return Counter((i, code, error, per_label[label], said) for i, code, error, label in found)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, b, "x", 1) for i, v, b in rows], "vec_id long, embedding array<double>, label int, vec string, error int")


def coded(df, **options):
    return Counter(tuple(r) for r in vector_codes.vector_codes(df, **options).select(
        "vec_id", "code", "error", "label_error", "codebooks_sha256").collect())


def random_rows(seed, many, dims=8, size=1.0):
    rnd = random.Random(seed)
    return [(rnd.choice([None, *range(200)]), [rnd.uniform(-size, size) for _ in range(dims)], rnd.choice([None, 1, 2])) for _ in range(many)]


@pytest.mark.parametrize("options", [{}, {"entries": 4, "rounds": 3}, {"entries": 4, "parts": 2, "block_rows": 7}, {"rounds": 0}])
def test_codes(spark, options):
    rows = random_rows(len(options), 300)
    rows += [rows[0]] * 150  # a third of all rows alike
    odd = [(1, None, 1), (2, [None] + [0.0] * 7, 1), (3, [float("nan")] * 8, 1), (4, [float("inf")] * 8, None), (5, [-0.0] * 8, None)]
    plain = {k: v for k, v in options.items() if k != "block_rows"}
    assert coded(vectors(spark, rows + odd).repartition(5), **options) == plain_codes(rows + odd, **plain)


def test_ties_take_the_first_entry_and_unused_entries_stay(spark):
    rows = [(0, [0.0] * 4, 1), (1, [0.0] * 4, 1), (2, [2.0] * 4, 1), (3, [1.0] * 4, 1)]
    got = coded(vectors(spark, rows), entries=3, rounds=1)
    assert got == plain_codes(rows, entries=3, rounds=1)
    # The row between two entries joins the first and moves it; the second copy, never used, stays and is now nearer.
    assert {code for i, code, *_ in got if i in (0, 1)} == {"01010101"}


def test_large_components_are_exact(spark):
    rows = [(i, [1e12 + i * 1e3, -3e9, 0.5, 1e-3 * i] * 2, i % 2) for i in range(20)]
    assert coded(vectors(spark, rows), entries=6) == plain_codes(rows, entries=6)


def test_short_empty_and_no_vectors(spark):
    rows = [(1, [], None), (2, [1.0], None), (3, [1.0, 2.0, 3.0, 4.0, 5.0], None)]
    filled = [(i, v + [0.0] * (8 - len(v)), b) for i, v, b in rows]
    assert coded(vectors(spark, rows)) == plain_codes(filled)
    assert coded(vectors(spark, [(1, [], 1)])) == plain_codes([(1, [0.0] * 4, 1)])
    assert coded(vectors(spark, [])) == coded(vectors(spark, [(1, None, 1)])) == Counter()


def test_distances_from_tables_are_the_distances():
    rnd = np.random.default_rng(1)
    for size, kind in ((900, np.int32), (1 << 23, np.int64), (1 << 40, object)):
        values, entries = rnd.integers(-size, size, (700, 6)), rnd.integers(-size, size, (9, 6))
        books, codes = zip(*(np.unique(values[:, d], return_inverse=True) for d in range(6)))
        if kind is object:
            books, entries = [b.astype(object) for b in books], entries.astype(object)
        tables = vector_codes.squared_tables(list(books), entries)
        assert {t.dtype for t in tables} == {np.dtype(kind)}
        nearest, distance = vector_codes.assign(list(books), list(codes), entries, len(values))
        exact = ((values.astype(object)[:, None, :] - entries.astype(object)[None]) ** 2).sum(2)
        assert nearest.tolist() == exact.argmin(1).tolist() and distance.tolist() == exact.min(1).tolist()


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_resample(docs, target, max_words=1, buckets=10_000, percent=10, min_words=20, seed=2024):
    def runs(text):
        words = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        return words, [zlib.crc32(" ".join(words[i:i + n]).encode()) % buckets for n in range(1, max_words + 1) for i in range(len(words) - n + 1)]

    own, goal = Counter(), Counter()
    for _, text in docs:
        own.update(runs(text)[1])
    for text in target:
        goal.update(runs(text)[1])
    total, wanted = own.total() + buckets, goal.total() + buckets
    gain = [math.floor(1000 * math.log((goal[b] + 1.0) * total / ((own[b] + 1.0) * wanted))) for b in range(buckets)]
    rows = []
    for doc_id, text in docs:
        words, said = runs(text)
        weight = sum(gain[b] for b in said) // len(said) if said else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(said), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), len(words) >= min_words))
    fit = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    many = percent * len(fit) // 100
    return Counter([(*r[:4], n + 1 if n < many else None) for n, r in enumerate(fit)] + [(*r[:4], None) for r in rows if not r[4]])


def resampled(spark, docs, target, **options):
    docs = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], "doc_id long, text string, rank int, bucket string, score int")
    target = spark.createDataFrame([(t, 7) for t in target], "text string, doc_id int")
    rows = resample.resample(docs.repartition(3), target, **options)
    return Counter(tuple(r) for r in rows.select("doc_id", "n_features", "weight", "score", "rank").collect())


def texts(seed, many):
    rnd = random.Random(seed)
    vocabulary = ["The", "a1", "é", "Ünder", "x_y", "can't", "日本", " ", "data", "DATA", "end.", "\x85", "0", "straße", "İ"]
    return [(rnd.choice([None, *range(300)]), rnd.choice([None, "", "..."]) if rnd.random() < 0.1 else
             rnd.choice([" ", "-", "\n", "  "]).join(rnd.choices(vocabulary, k=rnd.randint(1, 60)))) for _ in range(many)]


@pytest.mark.parametrize("options", [{}, {"max_words": 3, "buckets": 97}, {"percent": 100, "min_words": 1}, {"percent": 0}, {"seed": 5, "percent": 50}])
def test_resample(spark, options):
    docs = texts(len(options), 300)
    docs += [docs[0]] * 100 + [(999, "long words " * 40_000)] + [(7, "one text of twenty words or more " * 4)] * 150
    target = ["Data data the x", None, "", "日本 é end"]
    assert resampled(spark, docs, target, **options) == plain_resample(docs, target, **options)


def test_resample_of_nothing(spark):
    assert resampled(spark, [], ["a"]) == Counter()
    docs = [(1, "a b c"), (None, None)]
    assert resampled(spark, docs, []) == plain_resample(docs, [])


def test_ngram_hashes_are_carried_on():
    words = [b"ab", b"c", b"\xc3\xa9", b"ab"]
    single = resample._Buckets(1 << 32)
    said = list(resample.features(words, 3, single))
    assert said == [zlib.crc32(b" ".join(words[i:i + n])) for n in (1, 2, 3) for i in range(5 - n)]
    assert resample.words_of("Ab-C é\t9_z".encode()) == [b"ab", "c é".encode(), b"9", b"z"]
