"""Text functions: snippets, page and size limits, file and dataset names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters kept around a hit, characters per page, text cap, SQL cap.
SNIPPET_MARGIN = 40
CHARS_PER_PAGE = 2500
TEXT_CAP = 512_000
SQL_CAP = 2000

# Fixed wording of the notices shown to readers.
TEXT_CAP_NOTICE = "\n\n[content truncated at 500 KB]"
READ_ALL_NOTICE = 'Click "Read all pages" to extract the full document.*'
EMPTY_PAGE = "*(no text — may be a scanned image)*"

_BLANKS = " \t\n\r\x0b\x0c"


def snippet(text: Column, query: str, margin: int = SNIPPET_MARGIN) -> Column:
    """Text around the first case-insensitive hit on one line; null without a hit."""
    def around(pos: Column) -> Column:
        start = F.greatest(pos - margin, F.lit(1))
        cut = F.substr(text, start, pos + F.lit(len(query) + margin) - start)
        return F.when(pos > 0, F.btrim(F.replace(cut, F.lit("\n"), F.lit(" ")), F.lit(_BLANKS)))

    # A one-element array binds the position, so the text is folded and searched once.
    return F.transform(F.array(F.locate(query.lower(), F.lower(text))), around)[0]


def truncate_pages(text: Column, max_pages: int) -> Column:
    """First pages of extracted text.

    Form feeds separate pages and give each a heading.  Without them a page counts
    as 2500 characters and the cut moves back to the last blank line.
    """
    pages = F.split(text, "\x0c")
    n = F.size(pages)
    body = F.array_join(
        F.transform(
            F.slice(pages, 1, max_pages),
            lambda p, i: F.concat(
                F.lit("## Page "), (i + 1).cast("string"), F.lit("\n\n"),
                F.when(F.btrim(p, F.lit(_BLANKS)) == "", EMPTY_PAGE)
                .otherwise(F.btrim(p, F.lit(_BLANKS)))),
        ), "\n\n")
    paged = F.when(
        n > max_pages,
        F.concat(body, F.lit(f"\n\n---\n*Showing first {max_pages} of "), n.cast("string"),
                 F.lit(f" pages. {READ_ALL_NOTICE}"))).otherwise(body)

    limit = max_pages * CHARS_PER_PAGE
    head = F.substr(text, F.lit(1), F.lit(limit))
    back = F.instr(F.reverse(head), "\n\n")
    kept = F.when(back > 0, F.substr(head, F.lit(1), F.lit(limit) - back - 1)).otherwise(head)
    guessed = F.when(F.length(text) <= limit, text).otherwise(
        F.concat(kept, F.lit(f"\n\n---\n*Showing first ~{max_pages} pages. {READ_ALL_NOTICE}")))
    return F.when(n > 1, paged).otherwise(guessed)


def cap_text(text: Column, cap: int = TEXT_CAP) -> Column:
    """Plain text up to ``cap`` characters, with a notice when something was cut."""
    return F.when(F.length(text) > cap, F.concat(
        F.substr(text, F.lit(1), F.lit(cap)), F.lit(TEXT_CAP_NOTICE))).otherwise(text)


def cap_sql(sql: Column, cap: int = SQL_CAP) -> Column:
    """SQL text as kept in the history log."""
    return F.when(F.length(sql) > cap, F.concat(
        F.substr(sql, F.lit(1), F.lit(cap)), F.lit("…"))).otherwise(sql)


def base_name(path: Column) -> Column:
    """Text after the last slash."""
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension of a path; a leading dot alone starts no extension."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]*)$", 1))


def dataset_name(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(base_name(path), r"(?s)^(.+)\.[^.]*$", "$1")


def relation_name(name: Column) -> Column:
    """Table name used when datasets are related to each other by name."""
    out = F.regexp_replace(name, r"(\.parquet)+$", "")
    out = F.regexp_replace(out, r"(\.csv)+$", "")
    return F.lower(F.regexp_replace(out, r"(\.xlsx)+$", ""))


def safe_file_name(name: Column) -> Column:
    """Replace everything but ASCII letters, digits, dash and underscore."""
    return F.regexp_replace(name, r"[^A-Za-z0-9_-]", "_")


def ensure_extension(name: Column, ext: str) -> Column:
    """Append ``.ext`` unless the name ends with it in any letter case."""
    dotted = f".{ext}"
    return F.when(F.lower(name).endswith(dotted.lower()), name).otherwise(
        F.concat(name, F.lit(dotted)))
