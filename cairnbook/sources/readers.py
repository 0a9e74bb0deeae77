"""Table readers: Parquet, the CSV ladder, delimited text, JSON, collections, JDBC, cloud stores."""

from __future__ import annotations

from dataclasses import dataclass, field

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnbook.session import cut_lineage, hadoop_path, new_dir
from cairnbook.sources.catalog import _open, quoted_line_ends, split_records
from cairnbook.sources.jsonranges import json_values, layouts
from cairnbook.sources.listing import list_files
from cairnbook.sources.workbook import workbook_records


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """A table by format name; Parquet needs the footer only to know its columns."""
    if fmt == "parquet":
        return spark.read.options(**options).parquet(path)
    if fmt in ("csv", "tsv"):
        return read_delimited(spark, path, "\t" if fmt == "tsv" else ",")
    if fmt in ("json", "jsonl", "ndjson"):
        return read_json(spark, path)
    if fmt == "xlsx":
        return read_workbook_table(spark, path)
    raise ValueError(f"no reader for {fmt} files; only tabular data can be read")


def read_delimited(spark: SparkSession, path: str, sep: str = ",",
                   schema: T.StructType | str | None = None) -> DataFrame:
    """Delimited text with a header; rows that do not fit are left out."""
    reader = spark.read.option("header", "true").option("sep", sep).option("mode", "DROPMALFORMED")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")
    return reader.csv(path)


def read_json(spark: SparkSession, path: str, multi_line: bool | None = None,
              schema: T.StructType | str | None = None) -> DataFrame:
    """JSON documents with their nested schema found by reading them all.

    Unless told, files whose first line holds a whole document or list are read line by line; if any file of the table
    is laid out otherwise (one list over several lines, indented documents, one endless line), all are cut into their records
    first, by many tasks per file.  What does not parse is left out.
    """
    bad = "_corrupt_record"
    if multi_line is None:
        files = json_files(spark, path)
        parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
        if not layouts(files, _open, parts).where("by_value").isEmpty():
            path = new_dir(spark, "json-values")
            json_values(files, _open, parts).select("value").write.text(path)
        multi_line = False
    if schema is None:
        found = spark.read.option("multiLine", str(multi_line).lower()).json(path).schema
        schema = T.StructType([f for f in found.fields if f.name != bad])
    return (spark.read.schema(schema).option("multiLine", str(multi_line).lower())
            .option("mode", "DROPMALFORMED").json(path))


def json_files(spark: SparkSession, path: str) -> DataFrame:
    """Listing of the data files of a JSON table, one file or a folder of them."""
    return list_files(spark, path, "*").where(~F.substring_index("path", "/", -1).rlike("^[._]")).where("size_bytes > 0")


def _text_csv(spark: SparkSession, path: str, header: bool, names: list[str]) -> DataFrame:
    """All fields as text: short rows padded with nulls, rows with too many fields dropped."""
    extra = "_more_fields"
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, extra]])
    raw = (spark.read.schema(schema).option("header", str(header).lower()).option("mode", "PERMISSIVE")
           .option("enforceSchema", "true").csv(path))
    return raw.where(F.col(extra).isNull()).drop(extra)


def _rung(spark: SparkSession, path: str, rung: int) -> DataFrame:
    header = rung != 3
    if rung == 1:
        return spark.read.option("header", "true").option("inferSchema", "true").option(
            "mode", "FAILFAST").csv(path)
    found = spark.read.option("header", str(header).lower()).option(
        "inferSchema", str(rung != 4).lower()).option("mode", "PERMISSIVE").csv(path)
    text = _text_csv(spark, path, header, found.columns)
    if rung == 4:
        return text
    typed = [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in found.schema.fields]
    lost = F.lit(False)
    for f in found.schema.fields:
        if not isinstance(f.dataType, T.StringType):
            c = F.col(f"`{f.name}`")
            lost = lost | (c.isNotNull() & c.try_cast(f.dataType).isNull())
    return text.where(~lost).select(*typed)


# Types that text is read as, narrowest first.
_TEXT_TYPES = ("int", "bigint", "double", "boolean", "date", "timestamp")


def _record_rung(records: DataFrame, rung: int) -> DataFrame:
    """The rungs over whole records, for files whose quoted fields hold line ends."""
    heads = records.where("start = 0 AND no = 0")
    first = heads.orderBy("path").first()
    if first is None:
        raise ValueError("no columns found")
    width = len(first["fields"])
    names = first["fields"] if rung != 3 else [f"_c{i}" for i in range(width)]
    rows = records if rung == 3 else records.where("NOT (start = 0 AND no = 0)")
    if rung == 1 and not rows.where(F.size("fields") != width).isEmpty():
        raise ValueError("rows of different widths")
    value = [F.nullif(F.get("fields", F.lit(i)), F.lit("")) for i in range(width)]
    rows = rows.where(F.size("fields") <= width)
    if rung == 4:
        return rows.select(*[v.alias(n) for v, n in zip(value, names)])
    fails = rows.agg(*[F.count_if(v.isNotNull() & v.try_cast(t).isNull()).alias(f"{i}_{t}")
                       for i, v in enumerate(value) for t in _TEXT_TYPES],
                     *[F.count(v).alias(f"{i}_all") for i, v in enumerate(value)]).first()
    kinds = [next((t for t in _TEXT_TYPES if fails[f"{i}_all"] and not fails[f"{i}_{t}"]), "string") for i in range(width)]
    return rows.select(*[v.try_cast(t).alias(n) for v, t, n in zip(value, kinds, names)])


def read_workbook_table(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of a workbook, or of all workbooks of a folder, whose first row names the columns.

    Types are the narrowest that all cells of a column fit; short rows are padded, rows with too many cells left out.
    """
    files = list_files(spark, path, "*.xlsx")
    records = cut_lineage(workbook_records(files, _open, parts=max(1, spark.sparkContext.defaultParallelism)), "sheet")
    bad = records.where("error IS NOT NULL").first()
    if bad is not None:
        raise ValueError(f"{bad['path']}: {bad['error']}")
    return _record_rung(records.drop("error"), 2)


def csv_files(spark: SparkSession, path: str) -> DataFrame:
    """Listing of the data files of a delimited table, one file or a folder of them."""
    files = list_files(spark, path, "*").where(~F.substring_index("path", "/", -1).rlike("^[._]"))
    return files.where("size_bytes > 0").withColumn("file_format", F.lit("csv"))


def read_csv_ladder(spark: SparkSession, path: str, out: str | None = None) -> tuple[DataFrame, int]:
    """Convert messy CSV to Parquet by the first of four readings that succeeds.

    1 strict with header; 2 ragged rows padded, bad ones dropped; 3 the same without a
    header; 4 all text.  Files in which a quoted field holds a line end are cut into whole records first, by many
    tasks per file; others go to Spark's reader, which splits at every line end.  Reading is lazy, so a rung counts as good only once its
    Parquet copy is completely written.
    """
    target = out or new_dir(spark, "csv")
    fs, made = hadoop_path(spark, target)
    if fs.exists(made):
        raise ValueError(f"{target} exists")
    last: Exception | None = None
    records = None
    if fs.exists(hadoop_path(spark, path)[1]):
        files = csv_files(spark, path)
        if quoted_line_ends(files):
            records = cut_lineage(split_records(files), "records")
    for rung in (1, 2, 3, 4):
        try:
            df = _rung(spark, path, rung) if records is None else _record_rung(records, rung)
            if not df.columns:
                raise ValueError("no columns found")
            df.write.mode("errorifexists").option("compression", "zstd").parquet(target)
            return spark.read.parquet(target), rung
        except (PySparkException, Py4JError, ValueError) as exc:
            last = exc
            fs.delete(made, True)  # what the failed attempt has left behind
    raise ValueError(f"CSV to Parquet conversion failed after 4 attempts: {last}")


def register_collections(spark: SparkSession, collections: dict[str, str | DataFrame]) -> None:
    """Make document collections queryable by name.

    A string is the path of JSON documents, one per line; nested fields are found by
    reading them all.
    """
    for name, source in collections.items():
        df = read_json(spark, source) if isinstance(source, str) else source
        df.createOrReplaceTempView(name)


# JDBC driver class by database kind.
JDBC_DRIVERS = {
    "mysql": "com.mysql.cj.jdbc.Driver",
    "postgresql": "org.postgresql.Driver",
    "snowflake": "net.snowflake.client.jdbc.SnowflakeDriver",
    "sqlite": "org.sqlite.JDBC",
    "clickhouse": "com.clickhouse.jdbc.ClickHouseDriver",
}


@dataclass
class JdbcSource:
    """A relational database reached through Spark's JDBC reader."""

    kind: str
    url: str
    user: str | None = None
    password: str | None = None
    schema: str | None = None
    driver: str | None = None
    extra: dict[str, str] = field(default_factory=dict)


def jdbc_options(source: JdbcSource, table: str | None = None, query: str | None = None,
                 partition: tuple[str, int, int, int] | None = None, timeout: int = 60) -> dict[str, str]:
    """Reader options: pushdown on, time limit set, optional (column, low, high, parts) split."""
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    out = {
        "url": source.url,
        "queryTimeout": str(timeout),
        "pushDownPredicate": "true", "pushDownAggregate": "true",
        "pushDownLimit": "true", "pushDownTableSample": "true",
    }
    driver = source.driver or JDBC_DRIVERS.get(source.kind)
    if driver:
        out["driver"] = driver
    if source.user is not None:
        out["user"] = source.user
    if source.password is not None:
        out["password"] = source.password
    if source.schema and source.kind == "postgresql":
        out["sessionInitStatement"] = f'SET search_path TO "{source.schema}"'
    if partition:
        column, low, high, parts = partition
        # A split needs a table expression, so a query becomes a derived table.
        out["dbtable"] = table if table is not None else f"({query}) AS part_source"
        out.update(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    elif table is not None:
        out["dbtable"] = table
    else:
        out["query"] = query
    out.update(source.extra)
    return out


def read_jdbc(spark: SparkSession, source: JdbcSource, table: str | None = None, query: str | None = None,
              partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """Table or SELECT of a database; anything but SELECT is refused."""
    if query is not None:
        from cairnbook.operators.guard import check_db_sql

        reason = check_db_sql(query)
        if reason:
            raise ValueError(reason)
    return spark.read.format("jdbc").options(**jdbc_options(source, table, query, partition)).load()


# File system scheme by cloud store kind.
CLOUD_SCHEMES = {"s3": "s3a", "azure": "abfss", "gcs": "gs", "hdfs": "hdfs"}


def cloud_location(kind: str, bucket: str, prefix: str = "", account: str | None = None) -> str:
    """Hadoop path of a bucket prefix, ready for every reader here."""
    scheme = CLOUD_SCHEMES[kind]
    host = f"{bucket}@{account}.dfs.core.windows.net" if kind == "azure" else bucket
    return f"{scheme}://{host}/{prefix.lstrip('/')}"


def cloud_options(kind: str, bucket: str, key: str | None = None, secret: str | None = None,
                  endpoint: str | None = None, region: str | None = None,
                  account: str | None = None) -> dict[str, str]:
    """Hadoop settings for a store's credentials, scoped to the bucket where possible."""
    out: dict[str, str] = {}
    if kind == "s3":
        base = f"fs.s3a.bucket.{bucket}."
        for name, value in (("access.key", key), ("secret.key", secret), ("endpoint", endpoint),
                            ("endpoint.region", region)):
            if value:
                out[base + name] = value
    elif kind == "azure" and secret:
        out[f"fs.azure.account.key.{account}.dfs.core.windows.net"] = secret
    return out
