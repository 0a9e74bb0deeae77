"""Ranked search over datasets: file names, column names, text, catalog fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnbook.functions.text import base_name, extension, snippet

# Scores of a hit by kind, and the number of results shown.
NAME_SCORES = {"equal": 120, "prefix": 95, "contains": 75, "folder": 40}
COLUMN_SCORES = {"equal": 95, "prefix": 75, "contains": 55}
TEXT_SCORE = 50
SKIPPED_SCORES = {"equal": 100, "prefix": 75, "contains": 55}
CATALOG_SCORES = {"equal": 100, "prefix": 90, "contains": 70, "path": 60, "description": 50, "tags": 40}
RESULT_LIMIT = 200


def _graded(text: Column, q: str, scores: dict[str, int]) -> Column:
    return (F.when(text == q, scores["equal"]).when(text.startswith(q), scores["prefix"])
            .when(text.contains(q), scores["contains"]))


def score_entries(entries: DataFrame, query: str) -> DataFrame:
    """Matching entries with score, reasons, best column and snippet.

    ``entries`` has ``folder_path, relative_path, schema ARRAY<STRUCT<name,type>>, text``.
    One pass over the data; nothing is shuffled before the top-k.  Every kind of hit
    contains the query, so one cheap test drops other entries before they are graded.
    """
    q = query.strip().lower()
    path = F.lower("relative_path")
    entries = entries.where(
        path.contains(q) | F.coalesce(F.exists("schema", lambda c: F.lower(c["name"]).contains(q)), F.lit(False))
        | F.coalesce(F.lower("text").contains(q), F.lit(False)))
    by_name = F.coalesce(_graded(base_name(path), q, NAME_SCORES),
                         F.when(path.contains(q), NAME_SCORES["folder"]), F.lit(0))
    cols = F.transform(F.coalesce("schema", F.array().cast("array<struct<name:string,type:string>>")),
                       lambda c, i: F.struct(
                           F.coalesce(_graded(F.lower(c["name"]), q, COLUMN_SCORES), F.lit(0)).alias("score"),
                           (-i).alias("earlier"), c["name"].alias("name"), c["type"].alias("type")))
    scored = entries.withColumn("_name", by_name).withColumn("_col", F.array_max(cols)).withColumn(
        "snippet", snippet(F.col("text"), q))
    col_score = F.coalesce(F.col("_col.score"), F.lit(0))
    has_col = col_score > 0
    score = F.col("_name") + col_score + F.when(F.col("snippet").isNotNull(), TEXT_SCORE).otherwise(0)
    reasons = F.filter(F.array(
        F.when(F.col("_name") > 0, "filename"), F.when(has_col, "column"),
        F.when(F.col("snippet").isNotNull(), "content")), lambda r: r.isNotNull())
    return (scored.withColumn("score", score.cast("int"))
            .withColumn("reasons", reasons)
            .withColumn("match_column", F.when(has_col, F.col("_col.name")))
            .withColumn("match_type", F.when(has_col, F.col("_col.type")))
            .drop("_name", "_col", "text", "schema"))


def _top(scored: DataFrame, limit: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), "relative_path", "folder_path").limit(limit)


def search(entries: DataFrame, query: str, limit: int = RESULT_LIMIT) -> DataFrame:
    """Best matches, highest score first, then by path; an empty query finds nothing."""
    scored = score_entries(entries, query or " ")
    return _top(scored if query.strip() else scored.limit(0), limit)


def score_skipped(skipped: DataFrame, query: str) -> DataFrame:
    """Files known by name only, scored below indexed ones. ``skipped(name, size_bytes, reason)``."""
    q = query.strip().lower()
    score = _graded(F.lower("name"), q, SKIPPED_SCORES)
    return skipped.withColumn("score", score).where(F.col("score").isNotNull()).select(
        F.lit("").alias("folder_path"), F.col("name").alias("relative_path"),
        extension(F.col("name")).alias("file_format"), F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"),
        F.array(F.lit("filename"), F.concat(F.lit("skipped:"), "reason")).alias("reasons"), "score")


def search_everything(entries: DataFrame, skipped: DataFrame, query: str, limit: int = RESULT_LIMIT) -> DataFrame:
    """Indexed and skipped files ranked together; both sides are cut before they meet."""
    found = search(entries, query, limit)
    extra = score_skipped(skipped, query) if query.strip() else score_skipped(skipped, "x").limit(0)
    return _top(found.unionByName(_top(extra, limit), allowMissingColumns=True), limit)


def search_catalog(datasets: DataFrame, query: str, limit: int, workspace: str | None = None) -> DataFrame:
    """Catalog search over name, path, description and tags.

    The query is literal text: ``%`` and ``_`` mean themselves.
    """
    q = query.lower()
    name = F.lower("name")
    other = {"path": F.lower("path"), "description": F.lower("description"),
             "tags": F.lower(F.array_join("tags", ","))}
    score = _graded(name, q, CATALOG_SCORES)
    for field, text in other.items():
        score = score.when(text.contains(q), CATALOG_SCORES[field])
    out = datasets if workspace is None else datasets.where(F.col("workspace_id") == workspace)
    return (out.withColumn("score", score).where(F.col("score").isNotNull())
            .orderBy(F.desc("score"), "name", "id").limit(limit))


def list_catalog(datasets: DataFrame, workspace: str | None = None, folder: str | None = None,
                 query: str = "", limit: int | None = None) -> DataFrame:
    """Catalog rows by name, or by path inside one folder, optionally filtered and limited."""
    out = datasets
    if workspace is not None:
        out = out.where(F.col("workspace_id") == workspace)
    if folder is not None:
        out = out.where(F.col("path").startswith(folder.rstrip("/") + "/"))
    if query.strip():
        out = out.where(F.lower("name").contains(query.strip().lower()))
    out = out.orderBy(*(["path"] if folder is not None else ["name", "id"]))
    return out if limit is None else out.limit(limit)


def filter_keywords(items: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows whose joined columns contain the query, ignoring case."""
    return items.where(F.lower(F.concat_ws(" ", *columns)).contains(query.strip().lower()))
