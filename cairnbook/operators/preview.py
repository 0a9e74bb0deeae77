"""Previews, per-group samples and any-cell search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnbook.functions.cells import cell_text
from cairnbook.operators.privacy import mask_personal

PREVIEW_ROWS = 100
SAMPLE_ROWS = 5


def preview(df: DataFrame, order_by: list[Column], rows: int = PREVIEW_ROWS,
            temporal: str = "epoch") -> DataFrame:
    """First rows with every cell as text."""
    top = df.orderBy(*order_by).limit(rows)
    return top.select(*[
        cell_text(F.col(f"`{c}`"), df.schema[c].dataType, temporal).alias(c) for c in df.columns])


def preview_meta(df: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    """Total rows and whether a preview of ``rows`` rows leaves some out."""
    return df.agg(F.count(F.lit(1)).alias("total_rows")).select(
        "total_rows", F.least("total_rows", F.lit(rows)).cast("long").alias("shown_rows"),
        (F.col("total_rows") > rows).alias("truncated"))


def sample_rows(df: DataFrame, group: list[str], order_by: list[Column],
                rows: int = SAMPLE_ROWS) -> DataFrame:
    """Up to ``rows`` masked sample rows per group as JSON.

    The rank filter is pushed below the shuffle (window group limit), so a group that
    holds most of the data sends at most ``rows`` rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order_by))
    top = df.withColumn("sample_no", rank).where(F.col("sample_no") <= rows)
    masked, _ = mask_personal(top)
    body = [c for c in df.columns if c not in group]
    return masked.select(*group, "sample_no", F.to_json(F.struct(*body)).alias("sample"))


def any_cell_contains(df: DataFrame, needle: str) -> DataFrame:
    """Rows in which some cell's text contains ``needle``, ignoring case."""
    low = needle.lower()
    hit = F.lit(False)
    for field in df.schema.fields:
        cell = cell_text(F.col(f"`{field.name}`"), field.dataType)
        hit = hit | F.lower(cell).contains(low)
    return df.where(hit)
