"""Statements on an address: where it leads, what is opened there, and the guarded run with its time limit."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnbook.functions.urls import percent_decode
from cairnbook.operators import copies, guard
from cairnbook.session import hadoop_path, shared_dir
from cairnbook.sources.readers import JdbcSource, read_jdbc

LOCAL, DATABASE = "local://", "db://"


class AddressError(ValueError):
    """An address that leads nowhere; ``places`` are those that were looked at."""

    def __init__(self, why: str, address: str, places: list[str] | None = None):
        super().__init__(f"{why}: {address}" + (f" (tried {', '.join(places)})" if places else ""))
        self.why, self.places = why, places or []


def route(address: str) -> tuple[str, str]:
    """``(kind, rest)``: ``local`` with agent and path, ``db`` with a database's id, or ``path``."""
    for kind, mark in (("local", LOCAL), ("db", DATABASE)):
        if address.startswith(mark):
            return kind, address[len(mark):]
    return "path", address


def candidates(path: str, roots: list[str]) -> list[str]:
    """Places where a local path may lie: as it is, then below every root in their order."""
    own = unquote(path).split("#", 1)[0].lstrip("/")
    return list(dict.fromkeys([f"/{own}", *(f"{r.rstrip('/')}/{own}" for r in roots)]))


def places_tried(missing: DataFrame, roots: DataFrame, address: str = "address") -> DataFrame:
    """``(address, places)`` of local addresses that were not found: where :func:`candidates` would look for each.

    The roots are a configuration; they come to the addresses as one list.
    """
    ordered = F.array_sort(F.collect_list(F.struct("order", "root")))
    below = roots.agg(F.transform(ordered, lambda r: F.rtrim(r["root"], F.lit("/")))).scalar()
    own = F.ltrim(F.substring_index(percent_decode(F.regexp_replace(F.substr(F.col(address), F.lit(len(LOCAL) + 1)), r"^[^/]*/", "")), "#", 1), F.lit("/"))
    named = missing.select(address, F.concat(F.lit("/"), own).alias("_own"), below.alias("_roots"))
    return named.select(address, F.array_distinct(F.concat(F.array("_own"), F.transform("_roots", lambda r: F.concat(r, F.col("_own"))))).alias("places"))


def local_file(spark: SparkSession, rest: str, roots: list[str], agent: str | None, address: str) -> str:
    """The file that ``agent/path`` names: the first candidate that exists and lies under a root."""
    owner, slash, path = rest.partition("/")
    if not slash or not path.strip("/"):
        raise AddressError("bad-format", address)
    if agent is None:
        raise AddressError("no-agent", address)
    if owner != agent:
        raise AddressError("mismatch", address)
    tried = candidates(path, roots)
    for place in tried:
        inside = any(place == r.rstrip("/") or place.startswith(r.rstrip("/") + "/") for r in roots)
        if inside and "/../" not in f"{place}/":
            fs, found = hadoop_path(spark, place)
            if fs.exists(found):
                return place
    raise AddressError("not-found", address, tried)


def run(spark: SparkSession, sql: str, address: str, *, roots: list[str] = (), agent: str | None = None, cache: str | None = None,
        databases: dict[str, JdbcSource] | None = None, limit: int | None = None) -> DataFrame:
    """The result of a statement on an address; what a statement may do is checked before anything is opened.

    On files the address is what a ``read_…`` function of the statement is called on, or ``{{file}}`` stands for it: a path, or
    ``local://agent/path`` below one of the ``roots``; text tables are read by their Parquet copies in ``cache``.  With
    ``db://id`` the whole statement, a SELECT, goes to that database.
    """
    kind, rest = route(address)
    if kind == "db":
        source = (databases or {}).get(rest)
        if source is None:
            raise AddressError("no-database", address)
        out = read_jdbc(spark, source, query=sql)
        return out if limit is None else out.limit(limit)
    bound = guard.bind_address(sql, address)
    reason = guard.check_file_sql(bound)
    if reason:
        raise ValueError(reason)
    path = local_file(spark, rest, list(roots), agent, address) if kind == "local" else rest
    table = copies.table(spark, path, cache or f"{shared_dir(spark)}/copies")
    return guard.guarded_sql(spark, bound, table, limit)


def shown(spark: SparkSession, sql: str, address: str, *, seconds: float = guard.TIMEOUT_SECONDS, rows: int = guard.ROW_CAP,
          act: Callable[[DataFrame], object] | None = None, **options) -> object:
    """Rows for a person to look at (or what ``act`` makes of the result), ended with its Spark jobs after ``seconds``."""
    def action():
        df = run(spark, sql, address, **options)
        return guard.shown(df, rows) if act is None else act(df)

    return guard.with_timeout(spark, action, seconds)
