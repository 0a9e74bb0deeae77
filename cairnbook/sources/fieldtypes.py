"""Column types as sets of flags that fold: over values, byte ranges and files, in any order.

Every value rules types out; what is left after all values is the column's type.  The flags of two parts of the data
are joined by a bitwise "and", so a type met first in the last record of the last range counts like any other.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

BOOLEAN, BIGINT, DOUBLE, DATE, TIMESTAMP = (1 << i for i in range(5))
# All types are still possible: no value has been seen.  With none left the column is text.
UNSEEN, TEXT = 31, 0
_NAMES = {BOOLEAN: "BOOLEAN", BIGINT: "BIGINT", DOUBLE: "DOUBLE", DATE: "DATE", TIMESTAMP: "TIMESTAMP"}
# What a column of a type may still become beside others; an empty column leaves all to them.
_FLAGS = {"BOOLEAN": BOOLEAN, "BIGINT": BIGINT | DOUBLE, "DOUBLE": DOUBLE, "DATE": DATE | TIMESTAMP, "TIMESTAMP": TIMESTAMP}
# Stored type of a column without values.
NO_VALUES = "void"

_DAY = r"[1-9][0-9]{3}-(0[1-9]|1[0-2])-(0[1-9]|1[0-9]|2[0-8])"
_CLOCK = r"([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9](\.[0-9]{1,6})?)?"
# Values that surely are of a type; others are tried one by one.
_SURE = {
    BOOLEAN: r"(?i)^(true|false)$",
    BIGINT: r"^[+-]?[0-9]{1,18}$",
    DOUBLE: r"^[+-]?[0-9]+(\.[0-9]*)?([eE][+-]?[0-9]{1,3})?$",
    DATE: f"^{_DAY}$",
    TIMESTAMP: rf"^{_DAY}([T ]{_CLOCK}(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])?)?$",
}


def _number(text: str, kind) -> bool:
    # Python reads these as numbers, tables do not.
    if "_" in text or text != text.strip() or not text.isascii():
        return False
    try:
        value = kind(text)
    except ValueError:
        return False
    return kind is float or -(1 << 63) <= value < 1 << 63


def _moment(text: str, kind) -> bool:
    try:
        kind.fromisoformat(text)
    except ValueError:
        return False
    return text[4:5] == "-" and text[7:8] == "-"


_TRIED = {
    BOOLEAN: lambda v: False,
    BIGINT: lambda v: _number(v, int),
    DOUBLE: lambda v: _number(v, float),
    DATE: lambda v: len(v) == 10 and _moment(v, datetime.date),
    TIMESTAMP: lambda v: _moment(v, datetime.datetime),
}


def fold_texts(values: Iterable[str | None], flags: int = UNSEEN) -> int:
    """``flags`` without the types that one of the texts is not; empty texts and nulls say nothing."""
    if flags == TEXT:
        return flags
    column = pa.array([v for v in values if v], pa.large_string())
    if not len(column):
        return flags
    for flag in _NAMES:
        if flags & flag:
            open_to = column.filter(pc.invert(pc.match_substring_regex(column, _SURE[flag])))
            if len(open_to) and not all(map(_TRIED[flag], open_to.unique().to_pylist())):
                flags &= ~flag
    return flags


def json_flags(value) -> int:
    """Types that a JSON value can be; null says nothing, texts, lists and objects are text."""
    if value is None:
        return UNSEEN
    if type(value) is int and not -(1 << 63) <= value < 1 << 63:
        return DOUBLE
    return {bool: BOOLEAN, int: BIGINT | DOUBLE, float: DOUBLE}.get(type(value), TEXT)


def type_of(flags: int) -> str:
    """Narrowest type left; text if there is none or nothing was seen."""
    return "VARCHAR" if flags == UNSEEN else next((name for flag, name in _NAMES.items() if flags & flag), "VARCHAR")


def type_column(flags: Column) -> Column:
    """Column form of :func:`type_of`."""
    named = F.when(flags == UNSEEN, "VARCHAR")
    for flag, name in _NAMES.items():
        named = named.when(flags.bitwiseAND(F.lit(flag)) != 0, name)
    return named.otherwise("VARCHAR")


def stored_column(flags: Column) -> Column:
    return F.when(flags == UNSEEN, NO_VALUES).otherwise(type_column(flags))


def flags_column(type_name: Column, stored: Column) -> Column:
    """Flags that a column of a known type stands for, to merge it with those of other files."""
    flags = F.when(stored == NO_VALUES, F.lit(UNSEEN))
    for name, left in _FLAGS.items():
        flags = flags.when(type_name == name, F.lit(left))
    return flags.otherwise(F.lit(TEXT))
