"""Rendering of values as text: preview cells, numbers, binaries, dates, type names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: largest integer a JSON consumer with double arithmetic keeps exactly.
MAX_SAFE_INTEGER = 9007199254740991


def type_name(dt: T.DataType) -> str:
    """Catalog type name of a Spark type; anything unknown is text."""
    if isinstance(dt, T.BooleanType):
        return "BOOLEAN"
    if isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "BIGINT"
    if isinstance(dt, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "DOUBLE"
    if isinstance(dt, T.DateType):
        return "DATE"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return "TIMESTAMP"
    return "VARCHAR"


def type_name_col(simple: Column) -> Column:
    """The same mapping for a column holding Spark simple type strings."""
    s = F.lower(simple)
    return (
        F.when(s == "boolean", "BOOLEAN")
        .when(s.isin("tinyint", "smallint", "int", "integer", "bigint"), "BIGINT")
        .when(s.isin("float", "double") | s.startswith("decimal"), "DOUBLE")
        .when(s == "date", "DATE")
        .when(s.isin("timestamp", "timestamp_ntz"), "TIMESTAMP")
        .otherwise("VARCHAR")
    )


def plain_double(x: Column) -> Column:
    """Shortest decimal text of a double: no exponent, no trailing ``.0``.

    Whole numbers and everyday magnitudes take a cheap path; only very large or small
    values go through a decimal.
    """
    x = x.cast("double")
    size = F.abs(x)
    digits = F.regexp_replace(
        F.regexp_replace(x.cast("decimal(38,18)").cast("string"), r"0+$", ""), r"\.$", "")
    return (
        F.when(F.isnan(x), "NaN")
        .when(size == float("inf"), F.when(x > 0, "inf").otherwise("-inf"))
        .when((size < 1e15) & (x == F.rint(x)), x.cast("long").cast("string"))
        .when((size >= 1e-3) & (size < 1e7), x.cast("string"))
        .when((size >= 1e-12) & (size < 1e18), digits)
        .otherwise(x.cast("string"))
    )


def average_text(x: Column) -> Column:
    """A mean for display: whole numbers bare, others at most four decimals."""
    return plain_double(F.when(x == F.floor(x), x).otherwise(F.round(x, 4)))


def workbook_number(x: Column) -> Column:
    """Spreadsheet number text: integral values below 1e16 lose the fraction point."""
    return plain_double(x)


def cell_text(col: Column, dt: T.DataType, temporal: str = "epoch") -> Column:
    """Text of one preview cell.

    NULL shows as ``NULL`` and binaries as their size.  ``temporal='epoch'`` renders
    dates as day numbers and timestamps as microseconds; ``'iso'`` keeps calendar text.
    """
    if isinstance(dt, T.BinaryType):
        body = F.concat(F.lit("<"), F.octet_length(col).cast("string"), F.lit(" bytes>"))
    elif isinstance(dt, (T.FloatType, T.DoubleType)):
        body = plain_double(col)
    elif isinstance(dt, T.DateType) and temporal == "epoch":
        body = F.unix_date(col).cast("string")
    elif isinstance(dt, (T.TimestampType, T.TimestampNTZType)) and temporal == "epoch":
        body = F.unix_micros(col.cast("timestamp")).cast("string")
    elif isinstance(dt, (T.ArrayType, T.MapType, T.StructType)):
        body = F.to_json(col)
    else:
        body = col.cast("string")
    return F.coalesce(body, F.lit("NULL"))


def json_safe(col: Column, dt: T.DataType) -> Column:
    """JSON literal text of a number: big integers and decimals quoted, NaN/Inf null."""
    if isinstance(dt, T.DecimalType):
        return F.concat(F.lit('"'), col.cast("string"), F.lit('"'))
    if isinstance(dt, (T.FloatType, T.DoubleType)):
        finite = ~F.isnan(col) & (F.abs(col) != float("inf"))
        return F.when(finite, plain_double(col)).otherwise("null")
    wide = (col > F.lit(MAX_SAFE_INTEGER)) | (col < F.lit(-MAX_SAFE_INTEGER))
    quoted = F.concat(F.lit('"'), col.cast("string"), F.lit('"'))
    return F.coalesce(F.when(wide, quoted).otherwise(col.cast("string")), F.lit("null"))


def hex_text(col: Column) -> Column:
    """``0x`` and lower-case hex digits."""
    return F.concat(F.lit("0x"), F.lower(F.hex(col)))


def binary_preview(col: Column, label: str = "BLOB") -> Column:
    """Readable text of a binary without its trailing NULs, else ``(label) n bytes``."""
    as_hex = F.hex(col)
    trimmed = F.unhex(F.regexp_replace(as_hex, r"^((?:..)*?)(?:00)*$", "$1"))
    text = F.when(F.is_valid_utf8(trimmed.cast("string")), trimmed.cast("string"))
    clean = text.isNotNull() & ~text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{80}-\x{9f}]")
    size = F.concat(F.lit(f"({label}) "), F.octet_length(col).cast("string"), F.lit(" bytes"))
    return F.when(col.isNull(), F.lit(None)).when(clean, text).otherwise(size)


def bit_text(col: Column, bits: int) -> Column:
    """BIT(n) content: digits for n > 1, otherwise the plain number."""
    as_hex = F.hex(col)
    if bits <= 1:
        return F.conv(as_hex, 16, 10)
    nibbles = F.transform(
        F.split(as_hex, "(?<=.)(?=.)"), lambda h: F.lpad(F.conv(h, 16, 2), 4, "0"))
    digits = F.array_join(nibbles, "")
    return F.when(F.length(digits) > bits, F.substring(digits, -bits, bits)).otherwise(digits)


def http_date_epoch(col: Column) -> Column:
    """Seconds since 1970 of an HTTP date in any of its three historic spellings."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(col), r"^[A-Za-z]+,?\s+", ""), r"\s+", " ")
    # Two-digit years from 70 on belong to the last century.
    rest = F.regexp_replace(rest, r"^(\d\d-[A-Za-z]{3})-(?=[7-9]\d )", "$1-19")
    rest = F.regexp_replace(rest, r"^(\d\d-[A-Za-z]{3})-(?=[0-6]\d )", "$1-20")
    utc = F.concat(F.regexp_replace(rest, " GMT$", ""), F.lit(" +0000"))
    imf = F.try_to_timestamp(utc, F.lit("d MMM yyyy HH:mm:ss Z"))
    rfc850 = F.try_to_timestamp(utc, F.lit("dd-MMM-yyyy HH:mm:ss Z"))
    asctime = F.try_to_timestamp(utc, F.lit("MMM d HH:mm:ss yyyy Z"))
    with_zone = rest.endswith(" GMT")
    return F.unix_seconds(F.when(with_zone, F.coalesce(imf, rfc850)).otherwise(asctime))


def day_key(ts: Column) -> Column:
    """UTC calendar day of a timestamp as ``yyyy-MM-dd``."""
    return F.date_format(ts, "yyyy-MM-dd")
