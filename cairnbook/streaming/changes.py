"""Changes of a folder as a stream: files that are new, changed or gone, each told once.

The source's offset is a *manifest*, a listing that was written once and never changes: Parquet files dealt into shards
by a hash of the path, and a small file beside them that says how many.  A micro-batch is the difference of two
manifests, made shard by shard in tasks, so a batch that is run again after a restart gives the same rows.  The listing
itself is made by the source, level by level with several threads, or by a Spark job (:func:`publish`) where a folder is
too large for that; the source then only looks for the newest manifest.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from cairnbook.session import hadoop_path
from cairnbook.sources import listing

FORMAT = "folder_changes"
SCHEMA = "change string, path string, relative_path string, size_bytes long, modified timestamp"
# Files of one shard: two shards of this size are compared in the memory of one task.
SHARD_FILES = 100_000
THREADS = 16
_DONE = "_done.json"
_ROWS = pa.schema([("path", pa.string()), ("size_bytes", pa.int64()), ("modified_us", pa.int64())])
_OUT = pa.schema([("change", pa.string()), ("path", pa.string()), ("relative_path", pa.string()), ("size_bytes", pa.int64()),
                  ("modified", pa.timestamp("us", tz="UTC"))])


def _address(path: str) -> str:
    return path.rstrip("/") if re.match(r"[a-z0-9]+:", path) else f"file:{path.rstrip('/')}"


def shards_for(files: int) -> int:
    """A power of two, so that shards of two manifests line up."""
    return 1 << max(3, (files // SHARD_FILES).bit_length())


def _words(path: str, size: int, modified: int) -> int:
    return int.from_bytes(hashlib.sha256(f"{path}\0{size}\0{modified}".encode()).digest()[:15], "big")


def manifests(folder: str) -> list[str]:
    """Names of the finished manifests, oldest first; names begin with their number."""
    fs, inner = listing._file_system(_address(folder))
    found = fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True))
    names = sorted(f.base_name for f in found if f.type == pafs.FileType.Directory)
    return [n for n in names if fs.get_file_info(f"{inner}/{n}/{_DONE}").type == pafs.FileType.File]


def _facts(folder: str, name: str) -> dict:
    """``shards, files, sum`` of a manifest; the empty name is the listing of nothing."""
    if not name:
        return {"shards": 1, "files": 0, "sum": "0"}
    fs, inner = listing._file_system(_address(folder))
    with fs.open_input_file(f"{inner}/{name}/{_DONE}") as f:
        return json.loads(f.read())


def _next_name(names: list[str]) -> str:
    return f"{int(names[-1].split('-')[0]) + 1 if names else 1:012d}-{uuid.uuid4().hex[:8]}"


def _each_file(root: str) -> Iterator[list[tuple[str, int, int]]]:
    """Files folder by folder, several folders at a time; a folder that cannot be read ends the listing, one that went does not."""
    fs, inner = listing._file_system(root)

    def look(pair):
        address, place = pair
        return address, fs.get_file_info(pafs.FileSelector(place, allow_not_found=True))

    level = [(root, inner)]
    with ThreadPoolExecutor(THREADS) as pool:
        while level:
            below = []
            for address, found in pool.map(look, level):
                below += [(f"{address}/{f.base_name}", f.path) for f in found if f.type == pafs.FileType.Directory]
                yield [(f"{address}/{f.base_name}", f.size, (f.mtime_ns or 0) // 1000) for f in found if f.type == pafs.FileType.File]
            level = below


def list_manifest(root: str, folder: str) -> str:
    """Name of the manifest that holds what is below ``root`` now; the last one, if nothing has changed since."""
    names = manifests(folder)
    last = _facts(folder, names[-1] if names else "")
    shards, name = shards_for(last["files"]), _next_name(names)
    fs, inner = listing._file_system(_address(folder))
    held: list[list] = [[] for _ in range(shards)]
    writers: dict[int, pq.ParquetWriter] = {}
    files = total = 0

    def flush(shard: int) -> None:
        if shard not in writers:
            fs.create_dir(f"{inner}/{name}/shard={shard}", recursive=True)
            writers[shard] = pq.ParquetWriter(f"{inner}/{name}/shard={shard}/part.parquet", _ROWS, filesystem=fs)
        writers[shard].write_table(pa.table([list(c) for c in zip(*held[shard])], schema=_ROWS))
        held[shard] = []

    for found in _each_file(_address(root)):
        for row in found:
            files, total = files + 1, total + _words(*row)
            shard = zlib.crc32(row[0].encode()) % shards
            held[shard].append(row)
            if len(held[shard]) >= 10_000:
                flush(shard)
    if names and (files, str(total)) == (last["files"], last["sum"]):
        for writer in writers.values():
            writer.close()
        if writers:
            fs.delete_dir(f"{inner}/{name}")
        return names[-1]
    for shard, rows in enumerate(held):
        if rows:
            flush(shard)
    for writer in writers.values():
        writer.close()
    fs.create_dir(f"{inner}/{name}", recursive=True)
    with fs.open_output_stream(f"{inner}/{name}/{_DONE}") as f:
        f.write(json.dumps({"shards": shards, "files": files, "sum": str(total)}).encode())
    return name


def publish(spark: SparkSession, root: str, folder: str) -> str:
    """The same by a Spark job: folders are listed in tasks and every task writes its part of the shards."""
    names = manifests(folder)
    last = _facts(folder, names[-1] if names else "")
    found = listing.walk_folders(spark, root)
    lost = listing.unreadable(found).first()
    if lost is not None:  # else its files would be told as removed
        raise OSError(f"{lost['path']}: {lost['error']}")
    files = listing.list_files(spark, root, "*", found=found).select("path", "size_bytes", F.unix_micros("modified").alias("modified_us"))
    digest = F.sha2(F.concat_ws("\0", "path", F.col("size_bytes").cast("string"), F.col("modified_us").cast("string")), 256)
    # Fifteen bytes of each hash, added up in two halves that stay within the decimals Spark adds exactly.
    halves = [F.sum(F.conv(F.substring(digest, *at), 16, 10).cast("decimal(20,0)")) for at in ((1, 15), (16, 15))]
    count, high, low = files.agg(F.count(F.lit(1)), *halves).first()
    total = (int(high or 0) << 60) + int(low or 0)
    if names and (count, str(total)) == (last["files"], last["sum"]):
        return names[-1]
    shards, name = shards_for(count), _next_name(names)
    target = f"{_address(folder)}/{name}"
    dealt = files.withColumn("shard", F.pmod(F.crc32(F.col("path").cast("binary")), F.lit(shards)).cast("int"))
    dealt.repartition(shards, "shard").write.partitionBy("shard").parquet(target)
    fs, place = hadoop_path(spark, f"{target}/{_DONE}")
    out = fs.create(place, False)
    out.write(bytearray(json.dumps({"shards": shards, "files": count, "sum": str(total)}), "utf-8"))
    out.close()
    return name


@dataclass
class Shards(InputPartition):
    """One shard of the finer of two manifests, beside the shard of the other that covers it."""

    number: int
    count: int
    old: str | None
    new: str | None

    def __post_init__(self):
        super().__init__(self.number)


def _shard_rows(address: str | None, number: int, count: int) -> dict[str, tuple[int, int]]:
    """Paths of a shard with size and time; of a coarser shard those that belong to the finer one."""
    if address is None:
        return {}
    fs, inner = listing._file_system(address)
    if fs.get_file_info(inner).type != pafs.FileType.Directory:
        return {}
    rows = ds.dataset(inner, _ROWS, format="parquet", filesystem=fs).to_table()
    paths = rows.column("path").to_pylist()
    facts = zip(rows.column("size_bytes").to_pylist(), rows.column("modified_us").to_pylist())
    return {p: f for p, f in zip(paths, facts) if zlib.crc32(p.encode()) % count == number}


class ChangesReader(DataSourceStreamReader):
    """Offsets are names of manifests; a batch is the difference between two of them."""

    def __init__(self, root: str, folder: str, published: bool):
        self.root, self.folder, self.published = _address(root), _address(folder), published

    def initialOffset(self) -> dict:
        return {"manifest": ""}

    def latestOffset(self) -> dict:
        if self.published:
            names = manifests(self.folder)
            return {"manifest": names[-1] if names else ""}
        return {"manifest": list_manifest(self.root, self.folder)}

    def partitions(self, start: dict, end: dict) -> list[Shards]:
        old, new = start["manifest"], end["manifest"]
        if old == new:
            return []
        sizes = [_facts(self.folder, name)["shards"] for name in (old, new)]
        count = max(sizes)

        def shard(name: str, size: int, number: int) -> str | None:
            return f"{self.folder}/{name}/shard={number % size}" if name else None

        return [Shards(k, count, shard(old, sizes[0], k), shard(new, sizes[1], k)) for k in range(count)]

    def read(self, partition: Shards) -> Iterator[pa.RecordBatch]:
        before = _shard_rows(partition.old, partition.number, partition.count)
        now = _shard_rows(partition.new, partition.number, partition.count)
        rows = [("created" if path not in before else "changed", path, *facts) for path, facts in now.items() if before.get(path) != facts]
        rows += [("removed", path, *facts) for path, facts in before.items() if path not in now]
        base = self.root + "/"
        for lo in range(0, len(rows), 10_000):
            change, path, size, modified = zip(*rows[lo:lo + 10_000])
            relative = [p[len(base):] if p.startswith(base) else p.rsplit("/", 1)[-1] for p in path]
            time = pc.cast(pa.array(modified, pa.int64()), pa.timestamp("us", tz="UTC"))
            yield pa.RecordBatch.from_arrays([pa.array(change), pa.array(path), pa.array(relative), pa.array(size, pa.int64()), time], schema=_OUT)

    def commit(self, end: dict) -> None:
        """Manifests older than what has been told are not asked for again."""
        fs, inner = listing._file_system(self.folder)
        for name in manifests(self.folder):
            if name < end["manifest"]:
                fs.delete_dir(f"{inner}/{name}")


class FolderChanges(DataSource):
    """``spark.readStream.format("folder_changes")``; options ``path``, ``manifests`` and ``published``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> ChangesReader:
        return ChangesReader(self.options["path"], self.options["manifests"], self.options.get("published", "false").lower() == "true")


def watch_changes(spark: SparkSession, root: str, folder: str, patterns: tuple[str, ...] = listing.DEFAULT_EXCLUDES,
                  published: bool = False) -> DataFrame:
    """Stream of ``change, path, relative_path, size_bytes, modified`` below ``root``, without excluded files.

    ``folder`` keeps the manifests; it belongs to one stream, like its checkpoint, and lies outside ``root``.  With
    ``published`` they come from :func:`publish`.
    """
    spark.dataSource.register(FolderChanges)
    found = spark.readStream.format(FORMAT).option("manifests", folder).option("published", str(published).lower()).load(root)
    return listing.scannable(found, patterns)
