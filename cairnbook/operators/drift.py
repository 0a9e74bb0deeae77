"""Schema drift between two versions of many datasets at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ORDER = {"Added": 0, "Removed": 1, "TypeChanged": 2}


def parse_schema(df: DataFrame, key: list[str], schema_json: str = "schema_json") -> DataFrame:
    """``(key…, name, type)`` from schema JSON; null, blank or ``null`` mean no columns.

    Text that is not a list of columns with name and type gives no rows either.
    """
    wire = "array<struct<name:string,type:string>>"
    cols = F.from_json(F.col(schema_json), wire)
    return df.select(*key, F.inline(cols)).where(F.col("name").isNotNull() & F.col("type").isNotNull())


def schema_diff(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``(key…, kind, name, old_type, new_type)`` for all datasets with one shuffle.

    Both sides have ``key…, name, type``.  Names are compared as data, so letter case
    counts and order does not; a rename shows as one removal and one addition.  The grouping
    key includes the column name, which keeps one very wide dataset spread out.
    """
    on = [*key, "name"]
    nothing = F.lit(None).cast("string")
    both = old.select(*on, F.col("type").alias("o"), nothing.alias("n")).unionByName(
        new.select(*on, nothing.alias("o"), F.col("type").alias("n")))
    # Equal names within a dataset: the last entry would win; ``max`` makes that definite.
    sides = both.groupBy(*on).agg(F.max("o").alias("old_type"), F.max("n").alias("new_type"))
    kind = (F.when(F.col("old_type").isNull(), "Added").when(F.col("new_type").isNull(), "Removed")
            .when(F.col("old_type") != F.col("new_type"), "TypeChanged"))
    return (sides.withColumn("kind", kind).where(F.col("kind").isNotNull())
            .select(*key, "kind", "name", "old_type", "new_type"))


def in_display_order(changes: DataFrame, key: list[str]) -> DataFrame:
    """Additions, then removals, then type changes, by name inside each."""
    pairs = [F.lit(x) for kv in _ORDER.items() for x in kv]
    return changes.orderBy(*key, F.element_at(F.create_map(*pairs), F.col("kind")), "name")


def catalog_drift(catalog: DataFrame, scanned: DataFrame, key: list[str]) -> DataFrame:
    """Drift of scanned datasets against the catalog; first sight yields no changes.

    Both sides have ``key…, schema_json``.
    """
    seen = scanned.join(catalog.select(*key).distinct(), key, "left_semi")
    present = catalog.join(scanned.select(*key).distinct(), key, "left_semi")
    return schema_diff(parse_schema(present, key), parse_schema(seen, key), key)


def change_counts(changes: DataFrame, key: list[str]) -> DataFrame:
    """``(key…, added, removed, type_changed)``."""
    return changes.groupBy(*key).agg(
        F.count_if(F.col("kind") == "Added").alias("added"),
        F.count_if(F.col("kind") == "Removed").alias("removed"),
        F.count_if(F.col("kind") == "TypeChanged").alias("type_changed"))


def drift_messages(messages: DataFrame, body: str = "message") -> DataFrame:
    """Drift reported by other machines as change rows.

    The messages carry only column names, so types are ``unknown``; the dataset name is
    tagged with the machine it came from.
    """
    wire = ("workspace_id string, dataset_path string, dataset_name string, origin_agent_name string, "
            "origin_agent_id string, drift struct<added:array<string>,removed:array<string>,changed:array<string>>")
    m = messages.select(F.from_json(F.col(body), wire).alias("m")).select("m.*")
    unknown = F.lit("unknown")
    nothing = F.lit(None).cast("string")

    def side(names: str, kind: str, old, new):
        listed = F.coalesce(F.col(f"drift.{names}"), F.array().cast("array<string>"))
        return F.transform(F.filter(listed, lambda n: n.isNotNull()), lambda n: F.struct(
            F.lit(kind).alias("kind"), n.alias("name"), old.alias("old_type"), new.alias("new_type")))

    changes = F.concat(side("added", "Added", nothing, unknown), side("removed", "Removed", unknown, nothing),
                       side("changed", "TypeChanged", unknown, unknown))
    path = F.coalesce("dataset_path", F.lit(""))
    shown = F.coalesce("dataset_name", F.substring_index(path, "/", -1))
    return m.select(
        F.coalesce("workspace_id", F.lit("")).alias("workspace_id"), path.alias("dataset_path"),
        F.concat(shown, F.lit(" (from "), F.coalesce("origin_agent_name", F.lit("another machine")),
                 F.lit(")")).alias("dataset_name"),
        F.col("origin_agent_id"), F.inline(changes))
