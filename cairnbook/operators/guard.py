"""Policy for user-written SQL, for one statement or a table of them, and guarded execution."""

from __future__ import annotations

import re
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What user SQL may not contain, and the limits of one query.
FILE_FUNCTIONS = (
    "read_csv", "read_csv_auto", "read_parquet", "read_json", "read_json_auto", "read_json_objects",
    "read_ndjson", "read_ndjson_auto", "read_ndjson_objects", "read_blob", "read_text", "glob",
    "parquet_scan", "parquet_metadata",
)
FILE_KEYWORDS = ("attach", "copy", "install", "load", "pragma", "export", "import")
DB_KEYWORDS = (
    "insert", "update", "delete", "drop", "create", "alter", "truncate", "replace", "merge", "call",
    "exec", "grant", "revoke", "attach", "detach", "install", "load", "copy", "export", "import",
)
PLACEHOLDER = "{{file}}"
ROW_CAP = 100_000
TIMEOUT_SECONDS = 60
MISSING = "SQL is missing the {{file}} placeholder"



def _tokens(functions: tuple[str, ...], keywords: tuple[str, ...]) -> str:
    """One pattern for all forbidden tokens, standing alone and in any letter case.

    Functions count only when called, keywords wherever they are a whole word.
    """
    called = rf"(?:{'|'.join(functions)})(?=[ \t\n]*\()|" if functions else ""
    return rf"(?i)(?<![a-z0-9_])({called}(?:{'|'.join(keywords)})(?![a-z0-9_]))"


_FILE_TOKENS = _tokens(FILE_FUNCTIONS, FILE_KEYWORDS)
_DB_TOKENS = _tokens((), DB_KEYWORDS)
_FILE_REASONS = {f: f"forbidden file-access function: {f}" for f in FILE_FUNCTIONS} | {
    k: f"forbidden keyword: {k.upper()}" for k in FILE_KEYWORDS}
_DB_REASONS = {k: f"only SELECT may reach a database, found {k}" for k in DB_KEYWORDS}

# What Spark itself could do from inside a statement.  Comments, quoted text and back-quotes are gone first.
_NOISE = r"(?s)/\*.*?\*/|--[^\n]*"
_TEXTS = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""
_NAME = r"[a-z_][a-z0-9_]*"
_SPARK_RULES = {
    "not a SELECT": r"(?i)\A\s*(?!select\b|with\b|\(|values\b|from\b)|;\s*\S",
    "changes something": r"(?i)\b(?:insert|overwrite|directory|create|drop|alter|truncate|merge\s+into|refresh|analyze|cache\s+table|set\s+role|use\s+(?:schema|database|catalog))\b",
    "runs a script": r"(?i)\btransform\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?:row\s+format\b.*?)?using\b|\b(?:map|reduce)\s+[^;]*?\busing\s+§",
    "file address": r"(?i)\b(?:parquet|csv|json|orc|text|avro|binaryfile|delta|jdbc|xml)\s*\.\s*(?:§|[^\s.(]*[/:])",
    "forbidden function": r"(?i)\b(?:java_method|reflect|try_reflect|read_files|sql_keywords)\s*\(",
}
_FROM_LIST = rf"(?i)\b(?:from|join)\s+((?:lateral\s+)?[^\s,()]+(?:(?:\s+(?:as\s+)?{_NAME})?\s*,\s*(?:lateral\s+)?[^\s,()]+)*)"
_CTE = rf"(?i)(?:\bwith|,)\s*({_NAME})\s*(?:\([^()]*\)\s*)?as\s*\("
# FROM inside a call, as in trim(both 'x' from y), names no table.
_CALL_FROM = r"(?i)\b(extract|trim|substr|substring|overlay)(\s*\([^()]*?)\bfrom\b"
# A single table in brackets is that table.
_IN_BRACKETS = r"(?i)\b(from|join)\s*\((?:\s*\()*\s*(?!(?:select|with|values|from|table)\b)(?=[^\s()])"
_FOREIGN = "names a table other than {{file}}"
# What the placeholder is no placeholder in: texts, names in back-quotes and comments.
_UNBOUND = rf"(?s){_TEXTS}|`[^`]*`|/\*.*?\*/|--[^\n]*"

# Kinds of plan nodes a SELECT is made of; everything else is refused.
_PLAN_NODES = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Join", "Union", "Intersect",
    "Except", "SubqueryAlias", "UnresolvedSubqueryColumnAliases", "UnresolvedRelation", "UnresolvedWith", "UnresolvedHaving",
    "WithWindowDefinition", "Window", "Generate", "LateralJoin", "OneRowRelation", "UnresolvedInlineTable", "Pivot", "Unpivot",
    "Sample", "UnresolvedOrdinal", "UnresolvedHint", "GroupingSets", "Expand", "LocalRelation", "ResolvedInlineTable", "View",
}
_CALLS = {"java_method", "reflect", "try_reflect", "read_files", "sql_keywords", *FILE_FUNCTIONS}


def _first_reason(sql: str, pattern: str, reasons: dict[str, str]) -> str | None:
    found = {m.lower() for m in re.findall(pattern, sql)}
    return next((why for token, why in reasons.items() if token in found), None)


def check_file_sql(sql: str) -> str | None:
    """Reason why a statement on a bound file is refused, or None."""
    if PLACEHOLDER not in sql:
        return MISSING
    return _first_reason(sql, _FILE_TOKENS, _FILE_REASONS) or _spark_reason(sql)


def _bare(sql: str) -> str:
    """Statement without comments, with quoted texts as one sign and without back-quotes."""
    bare = re.sub(_CALL_FROM, r"\1\2,", re.sub(_TEXTS, "§", re.sub(_NOISE, " ", sql)))
    return re.sub(_IN_BRACKETS, r"\1 ", re.sub(r"`([^`]*)`", lambda m: m[1] if re.fullmatch(r"\w+", m[1]) else "§", bare))


def _spark_reason(sql: str) -> str | None:
    bare = _bare(sql)
    for why, rule in _SPARK_RULES.items():
        if re.search(rule, bare):
            return why
    known = {PLACEHOLDER, *(n.lower() for n in re.findall(_CTE, bare))}
    for part in re.findall(_FROM_LIST, bare):
        for item in part.split(","):
            name = re.sub(r"(?i)^\s*lateral\s+", "", item).split()[0].lower()
            if name not in known and not re.fullmatch(r"(?i)select|values|lateral|\w+\(.*", name):
                return _FOREIGN
    return None


def _bound_to(sql: str, name: str, text=lambda part: part) -> str:
    """The statement with ``name`` for the placeholder; texts, comments and quoted names stay as ``text`` leaves them."""
    out, at = [], 0
    for part in [*re.finditer(_UNBOUND, sql), None]:
        end = part.start() if part else len(sql)
        out.append(name.join(text(x) for x in sql[at:end].split(PLACEHOLDER)))
        if part:
            out.append(text(part[0]))
            at = part.end()
    return "".join(out)


def plan_reason(spark: SparkSession, sql: str, bound: str = "bound_table") -> str | None:
    """Reason why Spark's own parser finds more than a SELECT over the table named ``bound`` in ``sql``."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as exc:  # noqa: BLE001 - a statement that does not parse says so when it is run
        return None if "ParseException" in type(exc).__name__ or "Parse" in str(exc) else str(exc)
    jvm = spark._jvm
    subquery = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.expressions.PlanExpression")

    def each(seq):
        return [seq.apply(i) for i in range(seq.size())]

    def expressions(node, known):
        for e in each(node.expressions()):
            yield from expression(e, known)

    def expression(e, known):
        if e.getClass().getSimpleName() == "UnresolvedFunction":
            name = each(e.nameParts())[-1].lower()
            if name in _CALLS:
                yield f"forbidden function: {name}"
        if subquery.isInstance(e):
            yield from walk(e.plan(), known)
        for child in each(e.children()):
            yield from expression(child, known)

    def walk(node, known):
        kind = node.getClass().getSimpleName()
        if kind not in _PLAN_NODES:
            yield f"not a plain SELECT: {kind}"
            return
        if kind == "UnresolvedRelation":
            name = [p.lower() for p in each(node.multipartIdentifier())]
            if len(name) != 1 or name[0] not in known:
                yield _FOREIGN
        if kind == "UnresolvedWith":
            for pair in each(node.cteRelations()):
                yield from walk(pair._2(), known)
                known = known | {pair._1().lower()}
        yield from expressions(node, known)
        for child in each(node.children()):
            yield from walk(child, known)

    return next(walk(plan, frozenset({bound})), None)


def check_db_sql(sql: str) -> str | None:
    """Reason why a statement on a database is refused, or None."""
    return _first_reason(sql, _DB_TOKENS, _DB_REASONS)


def _first_reason_col(sql: Column, pattern: str, reasons: dict[str, str]) -> Column:
    """The same for a column: one pass over the text, then the first rule it breaks."""
    found = F.transform(F.regexp_extract_all(sql, F.lit(pattern), 1), F.lower)
    rules = F.array(*[F.lit(t) for t in reasons])
    why = F.create_map(*[F.lit(x) for kv in reasons.items() for x in kv])
    return F.try_element_at(why, F.get(F.array_intersect(rules, found), F.lit(0)))


def file_sql_reason(sql: Column) -> Column:
    """First reason of refusal for statements in a column, null when allowed."""
    bare = F.regexp_replace(F.regexp_replace(sql, _NOISE, " "), _TEXTS, "§")
    bare = F.regexp_replace(bare, _CALL_FROM, "$1$2,")
    bare = F.regexp_replace(F.regexp_replace(bare, r"`(\w+)`", "$1"), "`[^`]*`", "§")
    bare = F.regexp_replace(bare, _IN_BRACKETS, "$1 ")
    known = F.concat(F.array(F.lit(PLACEHOLDER)), F.transform(F.regexp_extract_all(bare, F.lit(_CTE), 1), F.lower))
    lists = F.regexp_extract_all(bare, F.lit(_FROM_LIST), 1)
    names = F.transform(F.flatten(F.transform(lists, lambda x: F.split(x, ","))), lambda x: F.lower(
        F.regexp_extract(F.regexp_replace(x, r"(?i)^\s*lateral\s+", ""), r"^\s*(\S+)", 1)))
    foreign = F.exists(names, lambda n: ~F.array_contains(known, n) & ~n.rlike(r"(?i)^(?:select|values|lateral|\w+\(.*)$"))
    rules = F.when(foreign, _FOREIGN)
    for why, rule in reversed(_SPARK_RULES.items()):
        rules = F.when(bare.rlike(rule), why).otherwise(rules)
    return F.when(~sql.contains(PLACEHOLDER), MISSING).otherwise(
        F.coalesce(_first_reason_col(sql, _FILE_TOKENS, _FILE_REASONS), rules))


def db_sql_reason(sql: Column) -> Column:
    """First word that makes a database statement more than a SELECT, as a reason."""
    return _first_reason_col(sql, _DB_TOKENS, _DB_REASONS)


def bind_address(sql: str, address: str) -> str:
    """The statement with the placeholder where a reader function was called on ``address``.

    A call is a name that begins with ``read_``, and its arguments up to the parenthesis that closes it.
    """
    out, at = [], 0
    for call in re.finditer(r"(?i)\bread_\w+\s*\(", sql):
        if call.start() < at:
            continue
        depth, quote, end = 1, "", call.end()
        while end < len(sql) and depth:
            c = sql[end]
            if quote:
                quote = "" if c == quote else quote
            elif c in "'\"":
                quote = c
            else:
                depth += (c == "(") - (c == ")")
            end += 1
        first = sql[call.end():end - 1].strip()
        if not depth and first[:1] in ("'", '"') and first[1:].startswith(address + first[0]):
            out += [sql[at:call.start()], PLACEHOLDER]
            at = end
    return "".join([*out, sql[at:]])


def guarded_sql(spark: SparkSession, sql: str, table: DataFrame, limit: int | None = None) -> DataFrame:
    """Run one checked SELECT against one bound table; the result is whole unless a ``limit`` is asked for.

    The words of the statement are checked first, then the plan that Spark's parser makes of it: only nodes
    of a SELECT, only the bound table and the statement's own common table expressions.  The table is bound under a
    name made up for this call, so no statement can know it.
    """
    reason = check_file_sql(sql)
    if reason:
        raise ValueError(reason)
    text, name = sql.strip().rstrip(";"), f"bound_{uuid.uuid4().hex}"
    reason = plan_reason(spark, _bound_to(text, name), name)
    if reason:
        raise ValueError(reason)
    # Braces of the statement itself are kept as they are.
    text = _bound_to(text, f"{{{name}}}", lambda part: part.replace("{", "{{").replace("}", "}}"))
    out = spark.sql(text, **{name: table})
    return out if limit is None else out.limit(limit)


def shown(df: DataFrame, limit: int = ROW_CAP) -> tuple[list, bool]:
    """Rows for a person to look at, and whether there are more than the ``limit`` shown."""
    rows = df.limit(limit + 1).collect()
    return rows[:limit], len(rows) > limit


def result_meta(df: DataFrame, limit: int) -> DataFrame:
    """Rows returned under a cap and whether any were cut off."""
    return df.limit(limit + 1).agg(F.count(F.lit(1)).alias("_n")).select(
        F.least("_n", F.lit(limit)).cast("long").alias("row_count"), (F.col("_n") > limit).alias("truncated"))


def with_timeout(spark: SparkSession, action, seconds: float = TIMEOUT_SECONDS, tag: str = "guarded"):
    """Run a driver action; after ``seconds`` its Spark jobs are cancelled, also those it starts later, with a ``TimeoutError``."""
    context = spark.sparkContext
    own, over, late = f"{tag}-{uuid.uuid4().hex}", threading.Event(), threading.Event()

    def watch() -> None:
        if not over.wait(seconds):
            late.set()
            while True:
                context.cancelJobsWithTag(own)
                if over.wait(0.2):
                    return

    context.addJobTag(own)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        return action()
    except Exception as exc:
        if late.is_set():
            raise TimeoutError(f"ended after {seconds} seconds") from exc
        raise
    finally:
        over.set()
        watcher.join()
        context.removeJobTag(own)
