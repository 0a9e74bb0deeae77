"""Column profiles, row counts and schema listings."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnbook.functions.cells import average_text, cell_text, plain_double, type_name

# Columns aggregated per scan: some forty functions.  Fewer cost a scan more for nothing, and beyond it the generated
# code takes as long per column again.  Of columnar files each scan reads only its own columns, so nothing is read twice.
CHUNK = 6

# Different values of one column that a task of the exact count holds before it sends them on.
HELD_VALUES = 2_000_000

PROFILE_COLUMNS = ["column_name", "column_type", "count", "null_percentage", "approx_unique",
                   "min", "max", "avg", "std"]


def _is_number(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def _is_float(dt: T.DataType) -> bool:
    return isinstance(dt, (T.FloatType, T.DoubleType))


def _has_order(dt: T.DataType) -> bool:
    return not isinstance(dt, (T.ArrayType, T.MapType, T.StructType, T.VariantType))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _column_aggs(field: T.StructField, i: int, sketch: bool) -> list[str]:
    c = _quoted(field.name)
    out = [f"count({c}) AS n{i}"]
    if _has_order(field.dataType):
        out += [f"min({c}) AS lo{i}", f"max({c}) AS hi{i}"]
        if sketch:
            out.append(f"approx_count_distinct({c}) AS u{i}")
    if _is_number(field.dataType):
        out += [f"avg(CAST({c} AS DOUBLE)) AS a{i}", f"stddev_samp(CAST({c} AS DOUBLE)) AS s{i}"]
    return out


def _column_facts(field: T.StructField, i: int, sketch: bool) -> str:
    """Facts of one column as a struct: extremes as text, or as numbers still to be shown."""
    ordered, number, is_float = _has_order(field.dataType), _is_number(field.dataType), _is_float(field.dataType)
    name = field.name.replace("\\", "\\\\").replace("'", "\\'")

    def fact(label: str, value: str, kind: str, there: bool) -> str:
        return f"'{label}', CAST({value if there else 'NULL'} AS {kind})"

    def text(value: str) -> str:
        if isinstance(field.dataType, T.BinaryType):
            return f"concat('<', octet_length({value}), ' bytes>')"
        return value

    return "named_struct(" + ", ".join([
        f"'column_name', '{name}'", f"'column_type', '{type_name(field.dataType)}'", f"'n', n{i}",
        fact("approx_unique", f"u{i}", "BIGINT", ordered and sketch),
        fact("lo", text(f"lo{i}"), "STRING", ordered and not is_float),
        fact("hi", text(f"hi{i}"), "STRING", ordered and not is_float),
        fact("lo_number", f"lo{i}", "DOUBLE", is_float), fact("hi_number", f"hi{i}", "DOUBLE", is_float),
        fact("mean", f"a{i}", "DOUBLE", number), fact("deviation", f"s{i}", "DOUBLE", number)]) + ")"


def _different(held_values: int):
    """The different values of every column of a task as pairs (number, text); at most so many of a column are held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def told(no: int, values: pa.Array) -> Iterator[pa.RecordBatch]:
            values = values.drop_null().cast(pa.string())
            for lo in range(0, len(values), 100_000):
                part = values.slice(lo, 100_000)
                yield pa.RecordBatch.from_arrays([pa.array([no] * len(part), pa.int32()), part], names=["no", "v"])

        for batch in batches:
            for no, column in enumerate(batch.columns):
                held.setdefault(no, []).append(column.unique())
                if sum(map(len, held[no])) > held_values:
                    one = pa.chunked_array(held[no]).unique()
                    held[no] = [one]
                    if len(one) > held_values // 2:
                        yield from told(no, one)
                        held[no] = []
        for no, parts in held.items():
            if parts:
                yield from told(no, pa.chunked_array(parts).unique())

    return run


def exact_distinct(df: DataFrame) -> DataFrame:
    """``(column_name, n_distinct)`` exact distinct counts of all columns in one scan and one shuffle.

    The tasks of the scan make the values of every column unique, in vectors, and send pairs of the column's number and a
    value as text: a hot value costs one row per task, and no column is a task of its own.
    """
    fields = [(i, f) for i, f in enumerate(df.schema.fields) if _has_order(f.dataType)]
    spark = df.sparkSession
    if not fields:
        return spark.createDataFrame([], "column_name string, n_distinct long")

    def value(field: T.StructField) -> Column:
        c = F.col(_quoted(field.name))
        if _is_float(field.dataType):
            return c + F.lit(0.0)  # both zeros are one number
        if isinstance(field.dataType, T.BinaryType):
            return F.hex(c)
        plain = (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
        return c if isinstance(field.dataType, plain) else c.cast("string")

    named = df.select(*[value(f).alias(f"c{k}") for k, (_, f) in enumerate(fields)])
    pairs = named.mapInArrow(_different(HELD_VALUES), "no int, v string")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = pairs.repartition(parts, "no", "v").distinct().groupBy("no").agg(F.count(F.lit(1)).alias("n_distinct"))
    # Columns without values, too, have a count.
    every = spark.createDataFrame([(k, f.name) for k, (_, f) in enumerate(fields)], "no int, column_name string")
    return (counts.withColumn("column_name", F.lit(None).cast("string")).unionByName(every.withColumn("n_distinct", F.lit(0).cast("long")))
            .groupBy("no").agg(F.max("column_name").alias("column_name"), F.max("n_distinct").alias("n_distinct")).drop("no"))


def profile(df: DataFrame, exact: bool = False) -> DataFrame:
    """One row per column: count, null share, distinct values, min, max, mean, deviation.

    The default reads every column once, :data:`CHUNK` columns a scan, and shuffles one partial row per task, with
    distinct counts from a HyperLogLog sketch.  ``exact=True`` counts distinct values in one scan more, whose shuffle
    grows with the number of different values.
    """
    parts = []
    for at in range(0, len(df.columns), CHUNK):
        fields = list(enumerate(df.schema.fields[at:at + CHUNK]))
        aggs = [a for i, f in fields for a in _column_aggs(f, i, not exact)]
        facts = ", ".join(_column_facts(f, i, not exact) for i, f in fields)
        parts.append(df.selectExpr("count(1) AS total", *aggs).selectExpr("total", f"inline(array({facts}))"))
    rows = reduce(DataFrame.unionByName, parts)
    if exact:
        # A row or two per column meet in a grouping; columns without an order have no distinct values to count.
        known = exact_distinct(df).withColumnRenamed("n_distinct", "approx_unique")
        facts = [c for c in rows.columns if c != "column_name"]
        both = rows.withColumn("approx_unique", F.lit(0).cast("long")).unionByName(known, allowMissingColumns=True)
        rows = both.groupBy("column_name").agg(*[F.max(c).alias(c) for c in facts])
    nulls = F.expr("CASE WHEN total > 0 THEN round((total - n) * 100.0D / total, 2) ELSE 0.0D END")
    return rows.select(
        "column_name", "column_type", F.col("total").alias("count"), nulls.alias("null_percentage"), "approx_unique",
        F.coalesce("lo", plain_double(F.col("lo_number"))).alias("min"),
        F.coalesce("hi", plain_double(F.col("hi_number"))).alias("max"),
        average_text(F.col("mean")).alias("avg"),
        plain_double(F.round("deviation", 4)).alias("std"))


def sample_profile(df: DataFrame, order_by: list[Column], rows: int = 100) -> DataFrame:
    """Profile of the first ``rows`` rows with text-based minimum and maximum.

    The sample is a top-k, so no more than ``rows`` rows leave any task.
    """
    sample = df.orderBy(*order_by).limit(rows)
    cells = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("pos"),
                 F.when(F.col(f"`{c}`").isNotNull(),
                        cell_text(F.col(f"`{c}`"), df.schema[c].dataType, "iso")).alias("v"))
        for i, c in enumerate(df.columns)])
    return (
        sample.select(F.inline(cells)).groupBy("column_name", "pos")
        .agg(
            F.count("*").alias("count"),
            F.round(F.count_if(F.col("v").isNull()) * 100.0 / F.count("*"), 2).cast("double")
            .alias("null_percentage"),
            F.count_distinct("v").alias("approx_unique"),
            F.min("v").alias("min"), F.max("v").alias("max"),
            average_text(F.avg(F.col("v").try_cast("double"))).alias("avg"),
        ).drop("pos")
    )


def row_count(df: DataFrame) -> DataFrame:
    """One row with the number of rows; Parquet answers it without reading columns."""
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def estimated_rows(size_bytes: Column) -> Column:
    """Row estimate for files that cannot be counted: one row per hundred bytes."""
    return F.floor(size_bytes / 100).cast("long")


def describe(df: DataFrame) -> DataFrame:
    """``(position, column_name, column_type, nullable)`` of a table, from its schema alone."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column_name"),
                 F.lit(type_name(f.dataType)).alias("column_type"),
                 F.lit(f.dataType.simpleString()).alias("spark_type"),
                 F.lit(True).alias("nullable"))
        for i, f in enumerate(df.schema.fields)])
    return df.sparkSession.range(1).select(F.inline(rows))
