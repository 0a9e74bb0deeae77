"""Exact top-k by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Candidate vectors are dealt into blocks; each block keeps, per dimension, the list of its candidates sorted by
that component.  A query walks down all lists of a block at once, from the end that suits the sign of its own
component.  At any depth no candidate still unseen can score more than the sum over the dimensions of the
query's component times the value at that depth; the walk ends as soon as this bound is below the k-th best
score found so far (equal scores are still looked at: ties go to the smaller id).  Queries are dealt into
groups and every group meets every block once, by an equi-join on the pair of their numbers; the k best of a
query in each block are then ranked together.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnbook.llm.common import BATCH_ROWS, table, written

K = 20
EVERY = 20
SCALE = 64
BLOCK_ROWS = 4096
GROUP_ROWS = 1024
_FIRST_DEPTH = 32
_SMALL = float(1 << 20)

_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _pack(batches):
    """One row per block, ids and components in binary; rows come sorted by block."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    now = None

    def row():
        ids, vecs = (np.concatenate(x) for x in zip(*held))
        return pa.RecordBatch.from_arrays([pa.array([now]), pa.array([ids.tobytes()], pa.binary()),
                                           pa.array([np.ascontiguousarray(vecs).tobytes()], pa.binary())],
                                          names=["block", "ids", "vecs"])

    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column("block").to_numpy(zero_copy_only=False)
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
        flat = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1), len(block)]
        for lo, hi in zip(edges[:-1], edges[1:]):
            if held and block[lo] != now:
                yield row()
                held = []
            now = int(block[lo])
            held.append((ids[lo:hi], np.floor(flat[lo:hi])))
    if held:
        yield row()


def _blocks(own: DataFrame, count: int) -> DataFrame:
    """Vectors dealt by a hash of their row numbers into ``count`` blocks: ``block, ids, vecs``."""
    dealt = own.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(count)))
    return dealt.repartition("block").sortWithinPartitions("block").mapInArrow(_pack, "block long, ids binary, vecs binary")


def walk_lists(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
    """The ``k`` best candidates of each query: ``(rows of queries, rows of candidates, scores)``.

    Components are whole numbers so small that all products and sums are exact in double precision,
    which :func:`_search` makes sure of.
    """
    many, dims = vectors.shape
    order = np.argsort(vectors, axis=0, kind="stable")  # the sorted lists, lowest first
    ranked = np.take_along_axis(vectors, order, axis=0)
    rows_q, rows_c, scores = [], [], []
    upward = queries >= 0
    values, probes = vectors.astype(np.float64), queries.astype(np.float64)
    seen = np.zeros((len(queries), many), bool)
    best = np.full((len(queries), 0), -np.inf)
    bound_at = np.full(len(queries), -np.inf)  # k-th best score so far
    active, depth, done = np.arange(len(queries)), min(_FIRST_DEPTH, many), 0
    while len(active):
        # Sorted access: what the lists show between the last depth and this one.
        top = order[many - depth:many - done]
        low = order[done:depth]
        fresh = np.zeros((len(active), many), bool)
        for d in range(dims):
            up = upward[active, d]
            fresh[np.ix_(up, top[:, d])] = True
            fresh[np.ix_(~up, low[:, d])] = True
        fresh &= ~seen[active]
        seen[active] |= fresh
        # Random access: the whole score of every candidate met, one product for the group.
        some = np.flatnonzero(fresh.any(0))
        score = probes[active] @ values[some].T
        for i, q in enumerate(active):
            col = np.flatnonzero(fresh[i, some])
            got = score[i, col]
            own = ids[some[col]] != query_ids[q]
            col, got = col[own], got[own]
            if bound_at[q] > -np.inf:
                keep = got >= bound_at[q]
                col, got = col[keep], got[keep]
            if len(got) > k:
                keep = got >= np.partition(got, len(got) - k)[len(got) - k]
                col, got = col[keep], got[keep]
            rows_q.append(np.full(len(col), q))
            rows_c.append(some[col])
            scores.append(got)
        top_scores = np.full((len(active), k), -np.inf)
        for i, got in enumerate(scores[-len(active):]):
            take = min(k, len(got))
            top_scores[i, :take] = np.sort(got)[::-1][:take]
        if best.shape[1] == 0:
            best = np.full((len(queries), k), -np.inf)
        best[active] = np.sort(np.concatenate((best[active], top_scores), 1), 1)[:, k:]
        bound_at[active] = best[active, 0]
        if depth == many:
            break
        done, depth = depth, min(many, depth * 2)
        limit = np.where(upward[active], probes[active] * ranked[many - 1 - done], probes[active] * ranked[done]).sum(1)
        active = active[limit >= bound_at[active]]
    if not rows_q:
        return (np.empty(0, np.int64),) * 3
    rows_q, rows_c, scores = (np.concatenate(x) for x in (rows_q, rows_c, scores))
    rank = np.lexsort((ids[rows_c], -scores, rows_q))
    rows_q, rows_c, scores = rows_q[rank], rows_c[rank], scores[rank]
    first = np.searchsorted(rows_q, rows_q)
    keep = np.arange(len(rows_q)) - first < k
    return rows_q[keep], rows_c[keep], scores[keep].astype(np.int64)


def score_all(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
    """Like :func:`walk_lists`, in whole numbers of any size and by looking at every candidate."""
    exact = np.vectorize(int, otypes=[object])
    rows_q, rows_c, scores = [], [], []
    values = exact(vectors).T if vectors.size else None
    for q in range(len(queries) if vectors.size else 0):
        said = exact(queries[q]) @ values
        best = sorted((-s, i, c) for c, (s, i) in enumerate(zip(said, ids.tolist())) if i != query_ids[q])[:k]
        rows_q += [q] * len(best)
        rows_c += [c for _, _, c in best]
        scores += [-s for s, _, _ in best]
    return np.array(rows_q, np.int64), np.array(rows_c, np.int64), scores


def _search(batches, k: int):
    for batch in batches:
        for row in batch.to_pylist():
            ids, queries = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
            if not len(ids) or not len(queries):
                continue
            vecs = np.frombuffer(row["vecs"], np.float64).reshape(len(ids), -1)
            probes = np.frombuffer(row["q_vecs"], np.float64).reshape(len(queries), -1)
            # Below this size all products and sums of a pair are exact in double precision.
            small = min(_SMALL, (2.0 ** 53 / vecs.shape[1]) ** 0.5)
            little, few = np.abs(vecs).max(1) < small, np.abs(probes).max(1) < small
            for search, by, of in ((walk_lists, few, little), (score_all, few, ~little), (score_all, ~few, np.ones(len(ids), bool))):
                if by.any() and of.any():
                    q, c, score = search(queries[by], probes[by], ids[of], vecs[of], k)
                    yield table({"query_id": queries[by][q], "vec_id": ids[of][c], "score": score}, _FOUND)


def top_k(vectors: DataFrame, *, k: int = K, every: int = EVERY, scale: int = SCALE, block_rows: int = BLOCK_ROWS,
          group_rows: int = GROUP_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best rows for each row whose id is divisible by ``every``.

    Components become ``floor(scale * x)``.  Null vectors, vectors with null or non-finite components and rows
    without id take no part.  Vectors too large for exact sums in double precision are scored in whole numbers of any
    size; a score that does not fit 64 bits ends the run with an error, as the cast of the SQL does.  Vectors only meet those of their own length.  Rows that
    share an id are not candidates for each other; fewer than ``k`` candidates are all returned; ties go to the
    smaller id; an empty table gives an empty one; other columns are not read.
    """
    spark = vectors.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    whole = F.transform(vectors[vector_col], lambda x: x.cast("double") * scale)
    sound = F.forall(vectors[vector_col], lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    clean = (vectors.where(vectors[id_col].isNotNull() & sound & (F.size(vectors[vector_col]) > 0))
             .select(vectors[id_col].cast("long").alias("vec_id"), whole.alias("vec")))
    clean = written(clean.withColumn("dims", F.size("vec")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    sizes = {r["dims"]: (r["n"], r["q"]) for r in clean.groupBy("dims").agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("vec_id") % every == 0).cast("long")).alias("q")).collect()}
    found = None
    for dims, (n, q) in sorted(sizes.items()):
        own = clean.where(F.col("dims") == dims).select("row", "vec_id", "vec")
        blocks_wanted, groups = max(1, -(-n // block_rows)), max(1, -(-q // group_rows))
        # Every pair of a block and a group is a task's worth of work of its own.
        all_of = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
        packed = _blocks(own, blocks_wanted).withColumn("group", all_of(groups))
        asked = _blocks(own.where(F.col("vec_id") % every == 0), groups).select(
            F.col("block").alias("group"), F.col("ids").alias("q_ids"), F.col("vecs").alias("q_vecs"), all_of(blocks_wanted).alias("block"))
        here = packed.join(asked, ["group", "block"]).mapInArrow(partial(_search, k=k), "query_id long, vec_id long, score long")
        found = here if found is None else found.unionByName(here)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
