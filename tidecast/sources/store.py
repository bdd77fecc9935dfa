"""Tables that outlive the plan that made them: stages of a run, and versions for readers.

Both live in the folder that the driver and all executors share, spark.checkpoint.dir, or in
one that the caller names. What is read from them is planned from files of a known size,
and survives the loss of an executor.
"""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where none is set, and only in local mode, a temporary folder."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tidecast-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


class Stages:
    """The tables of one run. Each stage is written once and read by its schema, so that
    later stages neither plan nor run it again; release() deletes them all."""

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark = spark
        self.path = (path or f"{shared_folder(spark)}/run-{uuid.uuid4().hex}").rstrip("/")
        self.written: list[str] = []

    def keep(self, name: str, df: DataFrame) -> DataFrame:
        at = f"{self.path}/{len(self.written)}-{name}"
        df.write.mode("overwrite").parquet(at)
        self.written.append(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def release(self) -> None:
        files, at = _files(self.spark, self.path)
        files.delete(at, True)
        self.written.clear()


class Snapshots:
    """Versions of a set of named tables, for readers that ask while new ones are made.

    A version is a folder of one table each. It counts once its marker is there, which is
    written last: a publisher that is lost leaves nothing that a reader would see, and the
    next one starts a later version. Readers take the newest version; expire() deletes
    older ones, after a time that covers requests under way.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def versions(self) -> list[int]:
        """Finished versions, oldest first."""
        files, at = _files(self.spark, f"{self.path}/v=*/_PUBLISHED")
        return sorted(int(x.getPath().getParent().getName().split("=")[1]) for x in files.globStatus(at) or [])

    def _begun(self) -> list[int]:
        files, at = _files(self.spark, f"{self.path}/v=*")
        return [int(x.getPath().getName().split("=")[1]) for x in files.globStatus(at) or []]

    def publish(self, **tables: DataFrame) -> int:
        """Write the tables as a new version; its number."""
        version = max(self._begun(), default=0) + 1
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/v={version}/{name}")
        files, at = _files(self.spark, f"{self.path}/v={version}/_PUBLISHED")
        files.create(at).close()
        return version

    def age(self, version: int) -> float:
        """Seconds since a version was published."""
        files, at = _files(self.spark, f"{self.path}/v={version}/_PUBLISHED")
        return time.time() - files.getFileStatus(at).getModificationTime() / 1000

    def read(self, name: str, version: int | None = None, most_seconds: float | None = None) -> DataFrame:
        """A table of the newest version, or of a given one. A version that is older than
        most_seconds isn't served: LookupError, as where there is none."""
        found = self.versions()
        wanted = version if version is not None else (found[-1] if found else None)
        if wanted not in found:
            raise LookupError(f"no version {'' if version is None else version} under {self.path}")
        if most_seconds is not None and self.age(wanted) > most_seconds:
            raise LookupError(f"version {wanted} is older than {most_seconds} s")
        return self.spark.read.parquet(f"{self.path}/v={wanted}/{name}")

    def expire(self, keep: int = 1, after_seconds: float = 0.0) -> list[int]:
        """Delete finished versions but the newest `keep`, once they are so old, and what unfinished
        publishers before them left; the versions deleted."""
        found = self.versions()
        gone = [v for v in found[: len(found) - keep] if self.age(v) >= after_seconds]
        lost = [v for v in self._begun() if v not in found and found and v < found[-1]]
        for v in gone + lost:
            files, at = _files(self.spark, f"{self.path}/v={v}")
            files.delete(at, True)
        return gone
