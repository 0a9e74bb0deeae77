"""Running numbers over a whole table without pulling it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnbook.session import cut_lineage


def number_rows(df: DataFrame, order_by: list[Column], name: str = "row_no", start: int = 0) -> DataFrame:
    """Add consecutive numbers in the given order, which should be total.

    Rows are range-partitioned by the order and numbered inside each partition; the
    partitions' sizes, one row each, give the offsets.  The ranged rows are written
    once, so both passes see the same partitions even when executors are lost.
    """
    ranged = (df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
              .withColumn("_part", F.spark_partition_id())
              .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    fixed = cut_lineage(ranged, "numbered")
    sizes = fixed.groupBy("_part").agg(F.count("*").alias("_n"))
    # One row per partition: the window below orders a few thousand rows at most.
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    return (fixed.join(F.broadcast(offsets), "_part")
            .withColumn(name, F.col("_before") + F.col("_at") + F.lit(start))
            .drop("_part", "_at", "_before"))


def renumber(items: DataFrame, listed: DataFrame, item: str = "id", order: str = "sort_order",
             position: str = "position") -> DataFrame:
    """New ``sort_order``: listed items first by position, the rest after in their old order.

    Raises ``ValueError`` when a listed id does not exist.
    """
    unknown = listed.join(items.select(item), item, "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"no item with id {unknown[0][item]!r}")
    marked = items.join(listed.select(item, F.col(position).alias("_pos")), item, "left")
    renamed = marked.withColumnRenamed(order, "_old")
    keys = [F.col("_pos").asc_nulls_last(), F.col("_old").asc(), F.col(item).asc()]
    return number_rows(renamed, keys, order).drop("_pos", "_old")
