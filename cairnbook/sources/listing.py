"""File listings: walking folders, filters over paths, fingerprints and folder sizes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnbook.functions.text import extension
from cairnbook.session import cut_lineage

# Extension classes, skipped extensions, default excludes and limits.
TABULAR = ("parquet", "csv", "xlsx", "xls", "ods", "json")
DOCUMENT = ("docx", "pptx", "html", "htm", "ipynb", "pdf", "odt", "odp", "ppt", "rtf")
TEXT = (
    "txt", "md", "markdown", "rst", "py", "js", "ts", "jsx", "tsx", "mjs", "cjs", "rs", "go",
    "java", "kt", "swift", "c", "cpp", "h", "hpp", "cs", "rb", "php", "sql", "sh", "bash", "zsh",
    "fish", "yaml", "yml", "toml", "ini", "xml", "log",
)
SUPPORTED = TABULAR + DOCUMENT + ("xml",)
ALWAYS_SKIP = (
    "exe", "dll", "so", "dylib", "lib", "a", "o", "dmg", "iso", "img", "vmdk", "vhd", "app", "deb",
    "rpm", "apk", "ipa", "class", "pyc", "pyo", "wasm", "swp", "swo", "tmp", "bak",
)
FINGERPRINTED = ("parquet", "csv", "xlsx", "xls", "docx", "pptx", "html", "htm", "ipynb", "pdf")
LISTED_BY_DEFAULT = ("csv", "tsv", "parquet")
FULL_TIER = ("parquet", "csv", "xlsx", "ods", "json")
CONTENT_TIER = ("docx", "pptx", "pdf", "odt", "odp", "ppt", "rtf", "html", "htm")
DEFAULT_EXCLUDES = (
    ".DS_Store", "__MACOSX", ".git", "node_modules", ".venv", "venv", "target", ".cache", "~$*",
    ".~lock*",
)
MAX_FILE_MB = 1024
MAX_DOCUMENT_MB = 50


def glob_to_regex(pattern: str) -> str | None:
    """Regular expression of a shell glob, or None when the glob is malformed.

    ``*`` and ``?`` also cross slashes; ``**`` must stand alone between slashes.
    """
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "*":
            run = re.match(r"\*+", pattern[i:]).group(0)
            end = i + len(run)
            if len(run) == 1:
                out += ".*"
            else:
                alone = (i == 0 or pattern[i - 1] == "/") and (end == len(pattern) or pattern[end] == "/")
                if len(run) > 2 or not alone:
                    return None
                if end < len(pattern):
                    out, end = out + "(?:.*/)?", end + 1
                else:
                    out += ".*"
            i = end
        elif ch == "?":
            out, i = out + ".", i + 1
        elif ch == "[":
            found = re.match(r"\[(!?)(\]?[^\]]*)\]", pattern[i:])
            if not found or not found.group(2):
                return None
            body = re.sub(r"([\\\[\]^&~])", r"\\\1", found.group(2))
            out += f"[{'^' if found.group(1) else ''}{body}]"
            i += found.end()
        else:
            out, i = out + (re.escape(ch) if not ch.isalnum() else ch), i + 1
    return out


def excluded(relative: Column, patterns: tuple[str, ...] = DEFAULT_EXCLUDES) -> Column:
    """True when a glob matches the path, its file name or any folder on the way."""
    usable = [r for r in (glob_to_regex(p) for p in patterns) if r is not None]
    if not usable:
        return F.lit(False)
    whole = r"(?s)\A(?:" + "|".join(usable) + r")\z"
    return relative.rlike(whole) | F.exists(F.split(relative, "/"), lambda part: part.rlike(whole))


def always_skipped(path: Column) -> Column:
    return extension(path).isin(*ALWAYS_SKIP)


def within_size(path: Column, size: Column, max_mb: int = MAX_FILE_MB,
                max_document_mb: int = MAX_DOCUMENT_MB) -> Column:
    """Size caps: a general one and a lower one for documents."""
    mb = 1024 * 1024
    cap = F.when(extension(path).isin(*DOCUMENT), F.lit(min(max_mb, max_document_mb) * mb)).otherwise(
        F.lit(max_mb * mb))
    return size <= cap


def format_class(ext: Column) -> Column:
    """``document``, ``text``, ``tabular`` or ``other``."""
    ext = F.lower(ext)
    return (F.when(ext.isin(*DOCUMENT), "document").when(ext.isin(*TEXT), "text")
            .when(ext.isin(*TABULAR), "tabular").otherwise("other"))


def scan_tier(ext: Column, overrides: dict[str, str] | None = None) -> Column:
    """How deeply a file is read; override values count in any letter case."""
    tier = (F.when(ext.isin(*FULL_TIER), "full").when(ext.isin(*CONTENT_TIER), "content")
            .otherwise("shallow"))
    known = {k: v.lower() for k, v in (overrides or {}).items()
             if v.lower() in ("full", "content", "shallow")}
    if not known:
        return tier
    pairs = [F.lit(x) for kv in known.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), ext), tier)


def reader_for(ext: Column, content_type: Column) -> Column:
    """Reader chosen for a remote file; null means it must be downloaded first."""
    ext, ctype = F.lower(ext), F.coalesce(content_type, F.lit(""))
    return (F.when(ext == "parquet", "parquet").when(ext.isin("csv", "tsv"), "csv")
            .when(ext.isin("xlsx", "xls"), F.lit(None).cast("string"))
            .when(ctype.contains("parquet"), "parquet").otherwise("csv"))


def _file_system(path: str):
    """pyarrow file system and inner path of a Hadoop style path, whatever signs its names have."""
    scheme, mark, rest = path.partition(":")
    if not mark or "/" in scheme:
        return pafs.LocalFileSystem(), path
    if scheme == "file":
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    authority, slash, inner = rest.removeprefix("//").partition("/")
    return pafs.FileSystem.from_uri(f"{scheme}://{authority}{slash}{quote(inner)}")


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One level below each folder: its files, and its folders for the next round; a folder that cannot be read says why."""
    for batch in batches:
        out = []
        for folder in batch["path"]:
            prefix = folder.rstrip("/")
            try:
                fs, inner = _file_system(folder)
                info = fs.get_file_info(inner)
                found = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(inner))
            except (OSError, pa.ArrowException) as exc:
                out.append((folder, False, None, None, f"{type(exc).__name__}: {exc}"))
                continue
            for f in found:
                own = folder if f is info else f"{prefix}/{f.base_name}"
                out.append((own, f.type == pafs.FileType.Directory, f.size, f.mtime_ns and f.mtime_ns // 1000, None))
        yield pd.DataFrame(out, columns=["path", "is_folder", "size_bytes", "modified_us", "error"]).astype(
            {"size_bytes": "Int64", "modified_us": "Int64"})


def _address(root: str) -> str:
    return (root if re.match(r"[a-z0-9]+:", root) else f"file:{root}").rstrip("/")


def walk_folders(spark: SparkSession, root: str) -> DataFrame:
    """``(path, size_bytes, modified_us, error)``: all files below a folder, and the folders that could not be read.

    Folders are listed level by level in tasks, each level written to the shared folder, so the driver holds no
    file names and no file content is read.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    folders, levels = spark.createDataFrame([(_address(root),)], "path string"), []
    while True:
        level = cut_lineage(folders.repartition(parts, "path").mapInPandas(
            _listed, "path string, is_folder boolean, size_bytes long, modified_us long, error string"), "listing")
        levels.append(level.where("NOT is_folder").drop("is_folder"))
        folders = level.where("is_folder").select("path")
        if folders.isEmpty():
            break
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found


def unreadable(found: DataFrame) -> DataFrame:
    """``(path, error)`` of the folders that :func:`walk_folders` could not read."""
    return found.where("error IS NOT NULL").select("path", "error")


def list_files(spark: SparkSession, root: str, glob: str | None = None,
               limit: int | None = None, found: DataFrame | None = None) -> DataFrame:
    """``(path, relative_path, size_bytes, modified)`` of all files below a folder.

    Empty files and names that begin with a dot or an underscore are files like any other.  Without a glob the listing
    keeps csv, tsv and parquet files.  Folders below the root that cannot be read are left out (``found``, from
    :func:`walk_folders`, tells which); a root that cannot be read is an error.
    """
    base = _address(root)
    found = walk_folders(spark, root) if found is None else found
    lost = found.where((F.col("path") == base) & F.col("error").isNotNull()).first()
    if lost is not None:
        raise FileNotFoundError(lost["error"])
    base += "/"
    files = found.where("error IS NULL").select(
        "path", F.when(F.col("path").startswith(base), F.substr("path", F.lit(len(base) + 1)))
        .otherwise(F.substring_index("path", "/", -1)).alias("relative_path"), "size_bytes",
        F.timestamp_micros("modified_us").alias("modified"))
    if glob is None:
        files = files.where(extension(F.col("path")).isin(*LISTED_BY_DEFAULT))
    else:
        files = files.where(F.substring_index("path", "/", -1).rlike(rf"(?s)\A(?:{glob_to_regex(glob)})\z"))
    if limit is not None:
        files = files.orderBy("path").limit(limit)
    return files


def scannable(listing: DataFrame, patterns: tuple[str, ...] = DEFAULT_EXCLUDES) -> DataFrame:
    """Listing without excluded and never indexed files; size does not matter."""
    rel = F.col("relative_path")
    return listing.where(~excluded(rel, patterns) & ~always_skipped(rel))


def folder_fingerprint(listing: DataFrame, folder: list[str], path: str = "relative_path",
                       size: str = "size_bytes", mtime: str = "mtime", every: bool = False) -> DataFrame:
    """One fingerprint per folder over (path, size, mtime) of its data files, or of ``every`` file listed.

    Every file is hashed on its own and the hashes are added up as four 64-bit
    words, then hashed again with the file count.  Sums combine on the map side, so
    neither the number of files nor one huge folder ever meets in a single task, and
    the order in which files arrive does not matter.
    """
    files = listing if every else listing.where(extension(F.col(path)).isin(*FINGERPRINTED) & ~excluded(F.col(path)))
    # A part that is missing is no empty part, and a sign inside a part is none between parts.
    parts = [F.coalesce(F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|")), F.lit("\\0"))
             for c in (path, size, mtime)]
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    words = files.select(*folder, *[
        F.conv(F.substring(digest, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)").alias(f"w{i}")
        for i in range(4)])
    sums = words.groupBy(*folder).agg(
        F.count(F.lit(1)).alias("files"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(4)])
    text = F.concat_ws(":", F.col("files").cast("string"), *[F.col(f"w{i}").cast("string") for i in range(4)])
    return sums.select(*folder, "files", F.sha2(text, 256).alias("fingerprint"))


def ancestors(path: Column) -> Column:
    """Every folder above a path, shortest first: ``a/b/c`` gives ``a``, ``a/b``."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(
        F.sequence(F.lit(1), F.size(parts) - 1),
        lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def subtree_sizes(listing: DataFrame, path: str, size: str) -> DataFrame:
    """Bytes and files below every folder; partial sums keep the shuffle to folders."""
    return (
        listing.select(F.explode(ancestors(F.col(path))).alias("folder"), F.col(size).alias("b"))
        .groupBy("folder").agg(F.sum("b").alias("total_bytes"), F.count(F.lit(1)).alias("files"))
    )
