"""Connected components of an edge table by alternating stars, each round written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnbook.llm.common import written

# Edges beyond which neither side of a join may go through the driver, however small their file is.
MERGED_EDGES = 200_000


def _print(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row["n"], row["s"]


def _lowest(pairs: DataFrame) -> DataFrame:
    """Each ``u`` with the least of itself and its neighbours."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))


def _with_lowest(pairs: DataFrame, low: DataFrame, many: int) -> DataFrame:
    return pairs.join(low.hint("merge") if many > MERGED_EDGES else low, "u")


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``node, root`` for every node of an edge: the root is the least node that can be reached.

    Large stars hang each greater neighbour on the least one, small stars each lesser one; both are an
    aggregate and a join with one row per node, so a hub of any degree is split like any skewed join.
    Rounds grow with the logarithm of the longest chain.
    """
    now = edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct()
    now = written(now, "edges")
    seen = _print(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_lowest(both, _lowest(both), seen[0]).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        large = written(large.where("u <> v").distinct(), "edges")
        low = _lowest(large)
        small = _with_lowest(large, low, seen[0])
        small = (small.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
                 .unionByName(low.where("u <> low").select("u", F.col("low").alias("v"))))
        now = written(small.distinct(), "edges")
        was, seen = seen, _print(now)
        if was == seen:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
