"""Relationships between datasets: from column names and from joins in past queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnbook.functions.text import relation_name

# Confidence of each method, gain per repeated finding, and the join pattern.
NAME_CONFIDENCE = 60
JOIN_CONFIDENCE = 80
REPEAT_GAIN = 20
JOIN_PATTERN = r"(?i)join\s+(\w+)\s+(?:as\s+)?(\w+)?\s+on\s+(\w+)\.(\w+)\s*=\s*(\w+)\.(\w+)"
LENIENT_JOIN_PATTERN = (
    r"(?i)join\s+(\w+)(?:\s+(?:as\s+)?((?!on\b)\w+))?\s+on\s+(\w+)\.(\w+)\s*=\s*(\w+)\.(\w+)")

EDGE = ["source_id", "target_id", "source_column", "target_column", "confidence", "method"]


def _by_table(datasets: DataFrame) -> DataFrame:
    """Dataset chosen for every table name; among equal names the last one stands."""
    return datasets.groupBy(relation_name(F.col("name")).alias("table_name")).agg(
        F.max("id").alias("target_id"))


def name_relations(datasets: DataFrame, columns: DataFrame) -> DataFrame:
    """Foreign keys guessed from names.

    ``datasets(id, name)``, ``columns(id, name)``.  Column ``x_id`` points to dataset
    ``x``, ``xs`` or ``x`` without trailing ``s``, whichever exists first and owns ``id``.
    """
    owners = columns.where(F.lower("name") == "id").select(F.col("id").alias("target_id")).distinct()
    targets = _by_table(datasets).join(owners, "target_id", "left_semi")
    low = F.lower("name")
    stem = F.expr("substring(low, 1, length(low) - 3)")
    wanted = (
        columns.withColumn("low", low).where(F.col("low").endswith("_id") & (F.length("low") > 3))
        .select("id", "name", F.posexplode(F.array(
            stem, F.concat(stem, F.lit("s")), F.regexp_replace(stem, "s+$", ""))).alias("rank", "table_name")))
    found = wanted.join(targets, "table_name")
    return found.groupBy(F.col("id").alias("source_id"), F.col("name").alias("source_column")).agg(
        F.min_by("target_id", "rank").alias("target_id")).select(
        "source_id", "target_id", "source_column", F.lit("id").alias("target_column"),
        F.lit(NAME_CONFIDENCE).alias("confidence"), F.lit("schema_fk_pattern").alias("method"))


def join_patterns(sql: Column, strict: bool = True) -> Column:
    """Array of ``(left_table, right_table, left_column, right_column)`` in one statement.

    The alias of the joined table is resolved; other aliases stay as written.  With
    ``strict`` a join without alias needs two blanks before ON, as history has it.
    """
    pattern = JOIN_PATTERN if strict else LENIENT_JOIN_PATTERN
    return F.transform(F.regexp_extract_all(F.lower(sql), F.lit(pattern), 0),
                       lambda clause: _resolved(clause, pattern))


def _resolved(clause: Column, pattern: str) -> Column:
    """Tables and columns of one join clause."""
    table, alias, left, left_column, right, right_column = (
        F.regexp_extract(clause, pattern, g) for g in range(1, 7))
    alias = F.when(alias == "", table).otherwise(alias)
    return F.struct(
        F.when(left == alias, table).otherwise(left).alias("left_table"),
        F.when(right == alias, table).otherwise(right).alias("right_table"),
        left_column.alias("left_column"), right_column.alias("right_column"))


def mined_joins(history: DataFrame, sql: str = "sql", strict: bool = True) -> DataFrame:
    """``(left_table, right_table, left_column, right_column, times)`` over all good queries.

    Equal join clauses are counted where they are found and taken apart only then, so a
    join used by a third of the history shuffles one row per task.
    """
    pattern = JOIN_PATTERN if strict else LENIENT_JOIN_PATTERN
    clauses = (
        history.where((F.col("status") == "success") & F.lower(sql).contains("join"))
        .select(F.explode(F.regexp_extract_all(F.lower(sql), F.lit(pattern), 0)).alias("clause"))
        .groupBy("clause").agg(F.count("*").alias("n")))
    return (clauses.select(_resolved(F.col("clause"), pattern).alias("j"), "n").select("j.*", "n")
            .groupBy("left_table", "right_table", "left_column", "right_column").agg(F.sum("n").alias("times")))


def history_relations(datasets: DataFrame, history: DataFrame, strict: bool = True) -> DataFrame:
    """Edges from joins in successful queries, with how often each was seen."""
    names = _by_table(datasets)
    left = names.select(F.col("table_name").alias("left_table"), F.col("target_id").alias("source_id"))
    right = names.select(F.col("table_name").alias("right_table"), "target_id")
    joins = mined_joins(history, strict=strict).join(left, "left_table").join(right, "right_table")
    return joins.select(
        "source_id", "target_id", F.col("left_column").alias("source_column"),
        F.col("right_column").alias("target_column"), F.lit(JOIN_CONFIDENCE).alias("confidence"),
        F.lit("query_history_join").alias("method"), "times")


def merge_edges(edges: DataFrame, order: str = "seq", times: str | None = None) -> DataFrame:
    """One edge per pair of columns.

    The first finding sets the confidence, each repeat adds 20 up to 100; a repeat that
    comes from history marks the method as combined.  ``times`` tells how many equal
    findings a row stands for.
    """
    key = ["source_id", "target_id", "source_column", "target_column"]
    n = F.col(times) if times else F.lit(1)
    # Equal findings of one edge are counted first, so a much repeated edge shuffles little.
    e = (edges.withColumn("_n", n).groupBy(*key, "confidence", "method")
         .agg(F.min(order).alias("_first"), F.sum("_n").alias("_n"))
         .withColumn("_from_history", F.col("method") == "query_history_join"))
    merged = e.groupBy(*key).agg(
        F.min_by(F.struct("confidence", "method", "_from_history"), "_first").alias("f"),
        F.sum("_n").alias("n"), F.sum(F.when(F.col("_from_history"), F.col("_n")).otherwise(0)).alias("h"))
    # History findings besides the very first one.
    later = F.col("h") - F.when(F.col("f._from_history"), 1).otherwise(0)
    return merged.select(
        *key, F.least(F.col("f.confidence") + (F.col("n") - 1) * REPEAT_GAIN, F.lit(100)).cast("int").alias("confidence"),
        F.when(later > 0, "query_history_join+schema").otherwise(F.col("f.method")).alias("method"))


def detect(datasets: DataFrame, columns: DataFrame, history: DataFrame, strict: bool = True) -> DataFrame:
    """All relationships: by name first, then by history, merged, strongest first."""
    named = name_relations(datasets, columns).withColumn("times", F.lit(1).cast("long")).withColumn("seq", F.lit(0))
    mined = history_relations(datasets, history, strict).withColumn("seq", F.lit(1))
    return merge_edges(named.unionByName(mined), "seq", "times").orderBy(
        F.desc("confidence"), "source_id", "target_id", "source_column", "target_column")
