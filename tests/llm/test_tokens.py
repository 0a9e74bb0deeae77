"""Token counts, packing and search against the libraries and plain versions."""

import os
import random
import sys
import zlib

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
import numpy as np  # noqa: E402
import public_tokenizers  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from cairnbook.llm import packing, token_counts, tokens, topk  # noqa: E402

SF = "/root/testdata/sf0.001"
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
PIECES = ["a", "B", "don't", "'s", " ", "  ", "\n", "\n\n", "\t", "é", "ñ", "1", "23", "$", "***", "日本", "´", "́", "'S", "I'M", ".", ",",
          "\r\n", "İ", "Σ", "²", "½", "_", "\x85", "\x1c", "　", "😀", "≮"]


def odd_texts(seed, many, longest=40):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, longest))) for _ in range(many)]


@pytest.mark.parametrize("name", FILES)
def test_remembered_pieces_give_the_ids_of_the_library(spark, name):
    texts = odd_texts(1, 4000) + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(50).collect()]
    texts += ["<|endoftext|> hi", "", "x" * 500]
    memory = tokens.TokenMemory(public_tokenizers.path(name), kept=3000)
    for lo in range(0, len(texts), 61):
        raw = [t.encode() for t in texts[lo:lo + 61]]
        starts = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
        ids, at = memory.encode(np.frombuffer(b"".join(raw), np.uint8), starts)
        for text, a, b in zip(texts[lo:lo + 61], at[:-1], at[1:]):
            assert ids[a:b].tolist() == memory.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_spliced_count_is_the_whole_count(name):
    tokenizer, rnd = Tokenizer.from_file(public_tokenizers.path(name)), random.Random(2)
    widened = 0
    for _ in range(300):
        few = rnd.sample(["a", "bc", "中", "é", " ", "  ", "\n", "'s", ".", "1", "。"], rnd.randint(2, 8))
        text = "".join(rnd.choice(few) for _ in range(rnd.randint(0, 300)))
        total, _, more = token_counts.spliced_count(tokenizer, text, rnd.choice([5, 16, 50]), rnd.choice([1, 4, 16]))
        assert total == len(tokenizer.encode(text, add_special_tokens=False).ids)
        widened += more
    assert widened  # some overlaps had no stable place


def test_token_counts(spark):
    file = public_tokenizers.path(FILES[1])
    tokenizer = Tokenizer.from_file(file)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(None, "a b"), (7, None), (7, None), (8, ""), (9, "the <|endoftext|> end"), (10, "word " * 30_000), (11, "中" * 3000)]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, n_tokens int")
    want = sorted(((d, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 2048)
                   for d, t in rows), key=str)
    for options in ({}, {"chunk_chars": 2000, "overlap_chars": 32}):
        got = token_counts.token_counts(df, file, **options).collect()
        assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got), key=str) == want
    assert max(r.n_chunks for r in got) > 10
    assert token_counts.token_counts(df.limit(0), file).collect() == []


def check_packing(rows, got, window, file, end=0):
    tokenizer = Tokenizer.from_file(file)
    sequences, pieces = {}, {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    assert sorted(sequences) == list(range(len(sequences)))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    want = {}
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, end], "<u4")
        for lo in range(0, len(ids), window):
            want.setdefault(doc, []).append((lo, len(ids[lo:lo + window]), zlib.crc32(ids[lo:lo + window].tobytes()), len(ids)))
    assert {d: sorted(p) for d, p in pieces.items()} == {d: sorted(p) for d, p in want.items()}
    total = sum(n for parts in sequences.values() for _, n in parts)
    return len(sequences), -(-total // window)


def test_packing_round_trip_with_little_padding(spark):
    file = public_tokenizers.path(FILES[0])
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, length int")
    used, least = check_packing(rows, packing.pack(df, file).collect(), 1024, file)
    assert used <= 1.02 * least


def test_packing_of_odd_rows(spark):
    file = public_tokenizers.path(FILES[0])
    rows = [(1, None), (2, ""), (None, "a b c"), (4, "word " * 9000), (5, "same"), (5, "same"), (6, "中文。" * 400)]
    rows += [(10 + i, t) for i, t in enumerate(odd_texts(3, 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for options in ({"window": 64}, {"window": 64, "part_bytes": 100}):
        check_packing(rows, packing.pack(df, file, **options).collect(), 64, file)
    assert packing.pack(df.limit(0), file).collect() == []


def test_closest_fill_is_optimal():
    rnd = random.Random(5)
    for _ in range(300):
        room = rnd.randint(1, 40)
        left = {rnd.randint(1, 20): rnd.randint(1, 4) for _ in range(rnd.randint(1, 4))}
        sums = {0}
        for length, n in left.items():
            sums = {s + length * k for s in sums for k in range(n + 1) if s + length * k <= room}
        got = packing.closest_fill(room, left)
        assert sum(k * n for k, n in got.items()) == max(sums) and all(n <= left[k] for k, n in got.items())


def test_top_k(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = brute.top_k([(r.vec_id, r.embedding) for r in df.collect()])
    assert sorted(map(tuple, topk.top_k(df).collect())) == want


def test_top_k_of_odd_rows(spark):
    """Ties, blocks and groups of a few rows, null and non-finite components, lengths that differ, few candidates."""
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4) / 64 * 3]) for i in range(400)]
    rows += [(1000, None), (1020, [1.0, None, 2.0, 3.0]), (1040, [float("nan")] * 4), (1060, [float("inf"), 1.0, 1.0, 1.0]),
             (2000, [1.0, 2.0]), (2001, [0.5, -1.0]), (3000, []), (None, [1.0] * 4)]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id long, embedding array<float>, score int, dims int")
    assert sorted(map(tuple, topk.top_k(df, block_rows=60, group_rows=7).collect())) == brute.top_k(rows)
    assert topk.top_k(df.limit(0)).collect() == []


def test_top_k_keeps_large_finite_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-200, 200, 4) / 64]) for i in range(150)]
    rows += [(200 + i, [float(x) for x in rng.integers(-(1 << 23), 1 << 23, 4) * 3]) for i in range(30)]
    rows += [(300, [16384.0, 0.0, 0.0, 1.0]), (301, [-(2.0 ** 21), 1.0, 0.5, 1.0]), (302, [1.0, 2.0 ** 22 + 1 / 64, 2.0 ** 22, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute.top_k(rows)
    assert sorted(map(tuple, topk.top_k(df, block_rows=60, group_rows=7).collect())) == want
    assert {200, 300} <= {q for q, *_ in want} and any(abs(s) > 1 << 53 for *_, s in want)


def test_rows_of_one_id_are_dealt_to_all_blocks(spark):
    df = spark.range(2000).selectExpr("id AS row", "7L AS vec_id", "array(1.0D) AS vec")
    sizes = [len(r.ids) // 8 for r in topk._blocks(df, 10).collect()]
    assert sum(sizes) == 2000 and len(sizes) == 10 and max(sizes) < 300


def test_top_k_of_repeated_ids_is_that_of_the_sql(spark):
    rng = np.random.default_rng(4)
    rows = [(i % 130, [float(x) for x in rng.integers(-9, 9, 4)]) for i in range(300)]
    want = {}
    for q, v in (r for r in rows if r[0] % 20 == 0):
        want.setdefault(q, []).extend((-64 * 64 * sum(a * b for a, b in zip(v, w)), j) for j, w in rows if j != q)
    want = sorted((q, r, j, int(-s)) for q, found in want.items() for r, (s, j) in enumerate(sorted(found)[:20], 1))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(df, block_rows=60, group_rows=7).collect())) == want
