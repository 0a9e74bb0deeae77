"""One job at a time on a folder: leases that end by themselves and carry a fencing number.

A lease is a file with the next number, created only if it is absent, that says until when it holds.  Who creates it has
the folder; others wait or leave.  A holder that works longer renews its file; one that dies lets it run out, and the
next job takes the next number.  Numbers only grow, so a table that remembers the highest one it has seen
(:func:`cairnbook.operators.keyed.change`) refuses what a holder thought dead still tries to commit.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession

from cairnbook.session import create_if_absent, hadoop_path

# Fixed value: seconds after which a job that says nothing counts as dead.
LEASE_SECONDS = 300


class LeaseTaken(RuntimeError):
    """Another job works on the folder."""


class LeaseLost(RuntimeError):
    """The lease ran out and another job has taken over."""


@dataclass
class Lease:
    spark: SparkSession
    folder: str
    number: int
    seconds: float

    def check(self) -> None:
        """Raise :class:`LeaseLost` unless this is still the newest lease."""
        newest = max(_numbers(self.spark, self.folder), default=0)
        if newest != self.number:
            raise LeaseLost(f"lease {self.number} of {self.folder} was followed by {newest}")

    def renew(self) -> None:
        self.check()
        _rewrite(self.spark, self.folder, self.number, time.time() + self.seconds)

    def release(self) -> None:
        """End the lease; its number is never used again."""
        if max(_numbers(self.spark, self.folder), default=0) == self.number:
            _rewrite(self.spark, self.folder, self.number, 0.0)


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    fs, place = hadoop_path(spark, folder)
    if not fs.exists(place):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(place))
    return sorted(int(n.removeprefix("_lease-")) for n in names if n.startswith("_lease-"))


def _file(folder: str, number: int) -> str:
    return f"{folder}/_lease-{number:012d}"


def _rewrite(spark: SparkSession, folder: str, number: int, until: float) -> None:
    fs, place = hadoop_path(spark, _file(folder, number))
    out = fs.create(place, True)
    out.write(bytearray(json.dumps({"until": until}), "utf-8"))
    out.close()


def _until(spark: SparkSession, folder: str, number: int, seconds: float) -> float:
    """When a lease ends; one that is just being renewed holds from then on."""
    fs, place = hadoop_path(spark, _file(folder, number))
    stream = fs.open(place)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return float(json.loads(text)["until"])
    except ValueError:
        return fs.getFileStatus(place).getModificationTime() / 1000 + seconds


def acquire(spark: SparkSession, folder: str, seconds: float = LEASE_SECONDS, wait: float = 0.0, pause: float = 0.5) -> Lease:
    """The lease of a folder; :class:`LeaseTaken` if another job still has it after ``wait`` seconds."""
    end = time.monotonic() + wait
    while True:
        newest = max(_numbers(spark, folder), default=0)
        if not newest or _until(spark, folder, newest, seconds) <= time.time():
            if create_if_absent(spark, _file(folder, newest + 1), json.dumps({"until": time.time() + seconds})):
                if newest > 1:  # the file before the last is of no use to anyone
                    fs, old = hadoop_path(spark, _file(folder, newest - 1))
                    fs.delete(old, False)
                return Lease(spark, folder, newest + 1, seconds)
        if time.monotonic() >= end:
            raise LeaseTaken(f"another job works on {folder}")
        time.sleep(pause)


@contextmanager
def held(spark: SparkSession, folder: str, seconds: float = LEASE_SECONDS, wait: float = 0.0) -> Iterator[Lease]:
    """A lease that is renewed while the block runs, and released behind it."""
    lease, over = acquire(spark, folder, seconds, wait), threading.Event()

    def keep() -> None:
        while not over.wait(seconds / 3):
            try:
                lease.renew()
            except Exception:  # noqa: BLE001 - the commit finds out
                return

    keeper = threading.Thread(target=keep, daemon=True)
    keeper.start()
    try:
        yield lease
    finally:
        over.set()
        keeper.join()
        lease.release()
