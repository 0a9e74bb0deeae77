"""Table catalogs assembled from the listing tables of a database."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def index_groups(index_rows: DataFrame, key: list[str]) -> DataFrame:
    """``(key…, columns)``: index columns in ordinal order.

    A database limits the columns of an index to a few dozen, so the list is short
    however many indexes there are; repeated rows are dropped while it is made.
    """
    cols = F.array_sort(F.collect_set(F.struct("ordinal", "column_name")))
    return index_rows.groupBy(*key).agg(cols.getField("column_name").alias("columns"))


def foreign_key_groups(fk_rows: DataFrame, key: list[str]) -> DataFrame:
    """``(key…, target_table, columns, target_columns)`` per constraint."""
    rows = F.array_sort(F.collect_set(F.struct("ordinal", "column_name", "target_column", "target_table")))
    return fk_rows.groupBy(*key).agg(
        F.max("target_table").alias("target_table"), rows.alias("_r")).select(
        *key, "target_table", F.col("_r.column_name").alias("columns"),
        F.col("_r.target_column").alias("target_columns"))


def resolve_foreign_keys(usage: DataFrame, constraints: DataFrame, target: DataFrame) -> DataFrame:
    """Three listing tables joined to one row per key column and the column it refers to.

    ``usage(table_name, constraint_name, ordinal, column_name)``,
    ``constraints(constraint_name, unique_name)``,
    ``target(unique_name, ordinal, target_table, target_column)``.
    """
    return (usage.join(constraints, "constraint_name")
            .join(target, ["unique_name", "ordinal"])
            .select("table_name", "constraint_name", "ordinal", "column_name", "target_table", "target_column"))


def table_catalog(columns: DataFrame, primary: DataFrame, stats: DataFrame, indexes: DataFrame,
                  foreign: DataFrame) -> DataFrame:
    """One row per table with nested columns, indexes and foreign keys.

    ``columns(table_name, ordinal, column_name, data_type, nullable)``,
    ``primary(table_name, column_name)``, ``stats(table_name, row_estimate, size_bytes)``,
    ``indexes`` and ``foreign`` as the grouping functions take them, with ``index_name``
    and ``constraint_name``.  Columns, indexes and keys of one table are limited by the
    database, so the nested lists stay small; tables spread over all tasks, and rows are shuffled once for each
    grouping: repeated ones are dropped while lists are made.
    """
    pk = primary.groupBy("table_name").agg(F.collect_set("column_name").alias("_pk"))
    cols = columns.groupBy("table_name").agg(
        F.array_sort(F.collect_set(F.struct("ordinal", "column_name", "data_type", "nullable"))).alias("_columns"))
    cols = cols.join(pk, "table_name", "left").select("table_name", F.transform("_columns", lambda c: F.struct(
        c["ordinal"].alias("ordinal"), c["column_name"].alias("column_name"), c["data_type"].alias("data_type"), c["nullable"].alias("nullable"),
        F.coalesce(F.array_contains("_pk", c["column_name"]), F.lit(False)).alias("is_primary_key"))).alias("columns"))
    idx = index_groups(indexes, ["table_name", "index_name"]).groupBy("table_name").agg(
        F.array_sort(F.collect_list(F.struct("index_name", "columns"))).alias("indexes"))
    fks = foreign_key_groups(foreign, ["table_name", "constraint_name"]).groupBy("table_name").agg(
        F.array_sort(F.collect_list(F.struct(
            "constraint_name", "columns", "target_table", "target_columns"))).alias("foreign_keys"))
    return (cols.join(stats, "table_name", "left").join(idx, "table_name", "left")
            .join(fks, "table_name", "left"))


def document_type(value: Column) -> Column:
    """Type name of one JSON value given as text."""
    v = F.btrim(value)
    whole = v.rlike(r"^-?\d+$")
    wide = whole & (F.abs(v.try_cast("decimal(38,0)")) > F.lit(2147483647))
    return (
        F.when(v.isNull() | (v == "null"), "Null")
        .when(v.startswith('"') & v.rlike(r'^"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d'), "DateTime")
        .when(v.startswith('"'), "String")
        .when(v.startswith("{"), F.when(v.rlike(r'^\{\s*"\$oid"'), "ObjectId").otherwise("Document"))
        .when(v.startswith("["), "Array")
        .when(v.isin("true", "false"), "Boolean")
        .when(wide, "Int64").when(whole, "Int32")
        .when(v.rlike(r"^-?[0-9.]+([eE][+-]?\d+)?$"), "Double")
        .otherwise("Mixed")
    )


def infer_fields(documents: DataFrame, body: str, seq: str, sample: int | None = None) -> DataFrame:
    """``(name, data_type, seen)`` of a document collection.

    All documents count unless a sample size is given; a field keeps the type it had in
    the first document, by ``seq``, that has it.
    """
    docs = documents.orderBy(seq).limit(sample) if sample else documents
    raw = F.from_json(F.col(body), "map<string,variant>")
    fields = docs.select(seq, F.explode(raw).alias("name", "v"))
    # Few types per field: counting them first leaves almost nothing for the ordered step.
    kinds = fields.groupBy("name", document_type(F.to_json("v")).alias("kind")).agg(
        F.min(seq).alias("first"), F.count("*").alias("n"))
    return kinds.groupBy("name").agg(F.min_by("kind", "first").alias("data_type"), F.sum("n").alias("seen"))
