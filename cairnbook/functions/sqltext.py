"""Functions over SQL text held in a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def index_columns(definition: Column) -> Column:
    """Names between the last opening and the last closing parenthesis of an index definition."""
    inner = F.regexp_extract(definition, r"(?s)^.*\(([^(]*?)(?:\)[^)]*)?$", 1)
    names = F.transform(
        F.split(inner, ","), lambda s: F.btrim(F.btrim(s, F.lit(" \t\n\r")), F.lit('"')))
    return F.filter(names, lambda s: s != "")


def collection_names(sql: Column) -> Column:
    """Distinct names that stand directly behind FROM or JOIN, in their order.

    The statement is read as a row of words, quoted texts, quoted names and signs, without comments; a name in back-quotes
    counts without them, and neither texts nor numbers are names.
    """
    clean = F.regexp_replace(sql, r"(?s)/\*.*?\*/|--[^\n]*", " ")
    parts = F.regexp_extract_all(clean, F.lit(r"(?s)'(?:[^'\\]|\\.)*'|`[^`]*`|\w+|[^\w\s]"), F.lit(0))
    nothing = F.array(F.lit(""))
    behind = F.zip_with(F.concat(nothing, parts), F.concat(parts, nothing), lambda before, part: F.when(
        F.lower(before).isin("from", "join") & part.rlike(r"^[`\p{L}_]"), F.btrim(part, F.lit("`"))))
    return F.array_distinct(F.filter(behind, lambda name: name.isNotNull()))


def leading_keyword(sql: Column) -> Column:
    """Upper-case first word once leading blanks and comments are gone."""
    body = F.regexp_replace(sql, r"(?s)\A(?:\s+|/\*.*?\*/|--[^\n]*\n)+", "")
    return F.upper(F.regexp_extract(body, r"\A([A-Za-z0-9_]+)", 1))


def starts_with_keyword(sql: Column, keywords: list[str]) -> Column:
    """True when the first executable words of the statement are one of ``keywords``."""
    body = F.regexp_replace(sql, r"(?s)\A(?:\s+|/\*.*?\*/|--[^\n]*\n)+", "")
    choice = "|".join(keywords)
    return body.rlike(rf"(?i)\A(?:{choice})(?![A-Za-z0-9_])")
