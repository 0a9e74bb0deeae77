"""Typed key-value dumps shown as one table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIST_SHOWN = 10


def _joined(items: Column, left: str, right: str) -> Column:
    return F.concat(F.lit(left), F.array_join(items, ", "), F.lit(right))


def render_kv(dump: DataFrame) -> DataFrame:
    """``keys(key, value, value_type, ttl)`` of a dump.

    The dump has ``key, value_type, ttl`` and one column per kind of value: ``text``,
    ``items`` (lists, sets and sorted sets) and ``fields`` (hashes).  Lists and sorted
    sets show their first ten items, hashes and sets all of theirs.
    """
    kind = F.col("value_type")
    pairs = F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    value = (
        F.when(kind == "string", F.coalesce("text", F.lit("")))
        .when(kind.isin("list", "zset"),
              _joined(F.slice(F.coalesce("items", F.array().cast("array<string>")), 1, LIST_SHOWN), "[", "]"))
        .when(kind == "set", _joined(F.coalesce("items", F.array().cast("array<string>")), "{", "}"))
        .when(kind == "hash", _joined(F.coalesce(pairs, F.array().cast("array<string>")), "{", "}"))
        .otherwise("")
    )
    return dump.select("key", value.alias("value"), "value_type", F.coalesce("ttl", F.lit(-1)).alias("ttl"))
