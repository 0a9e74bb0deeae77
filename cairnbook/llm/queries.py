"""Queries of the text operators on the given tables, beside the SQL that some of them must agree with."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cairnbook.llm import decontaminate, exact_dedup, langid, packing, quality, resample, secret_scan, simhash, substring_dedup, suffix_dedup, token_counts, topk, vector_codes
from cairnbook.session import tune

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(tune(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    return run


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_suffix_dedup(spark, sf_dir):
    """Bytes of all documents that a string of 400 bytes covers which also starts elsewhere."""
    return suffix_dedup.suffix_dedup(read(spark, sf_dir, "documents")).drop("removed")


@query
def op2_simhash(spark, sf_dir):
    """Near-duplicate components of all documents."""
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op3_decontamination(spark, sf_dir):
    """Words of all documents that occur in windows of benchmark items."""
    found = decontaminate.decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.drop("hit_spans")


@query
def op4_substring_dedup(spark, sf_dir):
    """Words of all documents that a window of 13 shared with a smaller document covers."""
    return substring_dedup.substring_dedup(read(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


@query
def op5_language_id(spark, sf_dir):
    """Language of every whole document; learned from four fifths of the ids."""
    docs = read(spark, sf_dir, "documents")
    return langid.identify(docs, langid.language_model(docs))


@query
def op6_quality(spark, sf_dir):
    """Perplexity of every whole document under a model of documents labelled good and not toxic; a fifth of them judges."""
    trusted, held = quality.split_trusted(read(spark, sf_dir, "labels").where("quality = 1 AND toxic = 0"))
    return quality.quality(read(spark, sf_dir, "documents"), trusted, held=held, lowest=quality.LOWEST)


@query
def op7_secret_scan(spark, sf_dir):
    """Secrets in every whole document."""
    docs = read(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.field_of(docs))


@query
def op8_packing(spark, sf_dir):
    """All documents in windows of 1024 ids."""
    return packing.pack(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op9_token_counts(spark, sf_dir):
    """Tokens of every whole document."""
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op10_top_k(spark, sf_dir):
    """The 20 best of all vectors for every twentieth one."""
    return topk.top_k(read(spark, sf_dir, "embeddings"))


@query
def op11_vector_codes(spark, sf_dir):
    """Codes of all vectors: four parts, 256 entries, four rounds."""
    return vector_codes.vector_codes(read(spark, sf_dir, "embeddings"))


def _vector_round(k: int) -> str:
    """Nearest entries under the codebooks of round ``k``, distance and number in one value, and the next codebooks."""
    return f"""near{k} AS MATERIALIZED (
  SELECT r, p, min((list_inner_product(x.part, x.part) - 2 * list_inner_product(x.part, c.part) + list_inner_product(c.part, c.part))::BIGINT
    * 256 + e) AS best FROM x JOIN book{k} c USING (p) GROUP BY r, p
), mean{k} AS (
  SELECT p, e, list(floor(s::DOUBLE / n) ORDER BY i) AS part FROM (
    SELECT p, best % 256 AS e, i, sum(y) AS s, count(*) AS n
    FROM (SELECT r, p, unnest(part) AS y, unnest(range(len(part))) AS i FROM x) JOIN near{k} USING (r, p) GROUP BY p, best % 256, i)
  GROUP BY p, e
), book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.part, b.part) AS part FROM book{k} b LEFT JOIN mean{k} m USING (p, e)
)"""


ORACLES["op11_vector_codes"] = f"""
WITH v AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label,
    list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS vec
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), x AS MATERIALIZED (SELECT r, p, vec[p * (len(vec) // 4) + 1:(p + 1) * (len(vec) // 4)] AS part FROM v, range(4) t(p)
), book0 AS (SELECT p, r AS e, part FROM x WHERE r < 256
), {", ".join(_vector_round(k) for k in range(4))}, near4 AS (
  SELECT r, p, min((list_inner_product(x.part, x.part) - 2 * list_inner_product(x.part, c.part) + list_inner_product(c.part, c.part))::BIGINT
    * 256 + e) AS best FROM x JOIN book4 c USING (p) GROUP BY r, p
), coded AS (
  SELECT r, string_agg(format('{{:02x}}', best % 256), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error FROM near4 GROUP BY r
), said AS (
  SELECT sha256(string_agg(array_to_string(list_transform(part, lambda y: y::BIGINT::VARCHAR), ','), ',' ORDER BY p, e)) AS s FROM book4)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, s AS codebooks_sha256
FROM v JOIN coded USING (r), said
"""


@query
def op12_exact_dedup(spark, sf_dir):
    """Groups of equal texts of all documents; the largest id of a group stays."""
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


ORACLES["op12_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (same ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

@query
def op13_resample(spark, sf_dir):
    """A tenth of all documents of 20 words or more, drawn towards the words of the benchmark."""
    rows = resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_features", "weight", "score", "rank")


# CRC-32 of a word: its bytes, as numbers, shift through the table of the polynomial.
ORACLES["op13_resample"] = r"""
WITH crc AS (
  SELECT list(list_reduce([b] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS t
  FROM range(256) x(b)
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS s FROM benchmark
), dw AS (SELECT r, s, count(*) AS n FROM (SELECT r, unnest(w) AS s FROM d) GROUP BY r, s
), word AS (
  SELECT s, xor(list_reduce([4294967295] || list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
    lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1])), 4294967295) % 10000 AS k
  FROM (SELECT s, hex(encode(s)) AS h FROM (SELECT s FROM dw UNION SELECT s FROM b)), crc
), mine AS (SELECT k, sum(n) AS s FROM dw JOIN word USING (s) GROUP BY k
), goal AS (SELECT k, count(*) AS t FROM b JOIN word USING (s) GROUP BY k
), gain AS (
  SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM mine), 0) + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM goal), 0) + 10000)::DOUBLE)))::BIGINT AS g
  FROM (SELECT DISTINCT k FROM word) LEFT JOIN mine USING (k) LEFT JOIN goal USING (k)
), total AS (SELECT r, sum(g * n)::BIGINT AS g, sum(n)::BIGINT AS n FROM dw JOIN word USING (s) JOIN gain USING (k) GROUP BY r
), scored AS (
  SELECT doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features,
    coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256(concat('2024:', doc_id)), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS gumbel
  FROM d LEFT JOIN total USING (r)
), placed AS (
  SELECT *, weight + gumbel AS score, count(*) FILTER (words >= 20) OVER () AS many,
    row_number() OVER (PARTITION BY words >= 20 ORDER BY weight + gumbel DESC, doc_id NULLS LAST, n_features, weight) AS place FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN words >= 20 AND place <= 10 * many // 100 THEN place END AS rank FROM placed
"""

ORACLES["op10_top_k"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.vec, c.vec)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.vec) = len(c.vec) WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
WHERE rank <= 20
"""

ORACLES["op1_suffix_dedup"] = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents
), win AS (
  SELECT r, i, md5(substr(x, 2 * i + 1, 800)) AS k FROM (SELECT r, x, unnest(range(0, len(x) // 2 - 399)) AS i FROM d)
), hit AS (
  SELECT r, i FROM win WHERE k IN (SELECT k FROM win GROUP BY k HAVING count(*) > 1)
), span AS (
  SELECT r, min(i) AS a, max(i) + 400 AS b FROM (
    SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS n FROM (
      SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM hit))
  GROUP BY r, n
), piece AS (
  SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS lo, a AS hi FROM span
  UNION ALL SELECT d.r, coalesce(max(b), 0), any_value(len(x) // 2) FROM d LEFT JOIN span ON span.r = d.r GROUP BY d.r
), kept AS (
  SELECT r, string_agg(substr(x, 2 * lo + 1, 2 * (hi - lo)), '' ORDER BY lo) AS y FROM piece JOIN d USING (r) GROUP BY r
), n AS (SELECT r, count(*) AS spans, sum(b - a) AS gone FROM span GROUP BY r)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(unhex(y)) AS kept_sha256
FROM d JOIN kept USING (r) LEFT JOIN n USING (r)
"""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

ORACLES["op3_decontamination"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_ALNUM}) AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_ALNUM}) AS w FROM benchmark WHERE item_id IS NOT NULL
), item AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(len(w), 10) AS n FROM b WHERE len(w) > 0))
), win AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM item) WHERE len(w) >= n)
), hit AS (SELECT r, i, n, item_id FROM win JOIN item USING (n, k)
), word AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r
), found AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN word USING (r) LEFT JOIN found USING (r)
"""

ORACLES["op4_substring_dedup"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x09-\x0D\x20]+') AS w FROM documents
), win AS (
  SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM d)
), low AS (SELECT k, min(doc_id) AS first FROM win GROUP BY k
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM win JOIN low USING (k) WHERE first < doc_id
), word AS (SELECT r, unnest(w) AS s, unnest(range(1, len(w) + 1)) AS p FROM d
), kept AS (SELECT r, string_agg(s, ' ' ORDER BY p) AS y FROM word ANTI JOIN gone USING (r, p) GROUP BY r
), n AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(y, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN n USING (r)
"""
