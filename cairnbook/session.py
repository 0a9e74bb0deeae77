"""Session set-up and the shared folder jobs may write to."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


# The JVM never compiles methods above 8000 bytes of bytecode.  Beyond it Spark should split
# a wide projection into several methods rather than run one huge method interpreted.
JIT_METHOD_LIMIT = "8000"


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("cairnbook")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("CAIRNBOOK_DRIVER_MEMORY", "8g"))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.codegen.hugeMethodLimit", JIT_METHOD_LIMIT)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Settings the operators rely on, for sessions made elsewhere."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", JIT_METHOD_LIMIT)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Where the cluster names none (tests, a laptop) a scratch folder is chosen once
    and stored in the session, so later calls agree on it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        named = tempfile.mkdtemp(prefix="cairnbook-")
        spark.sparkContext.setCheckpointDir(named)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def new_dir(spark: SparkSession, label: str) -> str:
    """A fresh, not yet existing path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame, label: str = "cut", partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written files outlive any executor, so a lost node costs only the tasks it ran.
    """
    spark = df.sparkSession
    path = new_dir(spark, label)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that does not exist yet; False if it does, whoever was faster.

    Others see the whole file or none: it is written beside its place and then linked (local folders) or renamed (HDFS)
    there, which fails where a file is.  Other stores create it on condition that it is absent.
    """
    fs, place = hadoop_path(spark, path)
    scheme = place.toUri().getScheme() or fs.getUri().getScheme()
    if scheme == "file":
        target = place.toUri().getPath()
        os.makedirs(os.path.dirname(target), exist_ok=True)
        beside = f"{os.path.dirname(target)}/.{uuid.uuid4().hex}"
        with open(beside, "w", encoding="utf-8") as out:
            out.write(text)
        try:
            os.link(beside, target)
        except FileExistsError:
            return False
        finally:
            os.unlink(beside)
        return True
    if scheme in ("hdfs", "viewfs"):
        beside = hadoop_path(spark, f"{path}.{uuid.uuid4().hex}")[1]
        _put(fs.create(beside, False), text)
        if fs.rename(beside, place):
            return True
        fs.delete(beside, False)
        return False
    try:
        _put(fs.create(place, False), text)
    except Py4JError:
        return False
    return True


def _put(stream, text: str) -> None:
    stream.write(bytearray(text, "utf-8"))
    stream.close()


def hadoop_path(spark: SparkSession, path: str):
    """``(file system, path)`` of the Hadoop client for driver-side file operations."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p
