"""Where intermediate tables live: Parquet in the folder that all executors share.

Iterative operators cut their lineage by writing a table and reading it again. Unlike cached blocks such a table survives the loss
of any executor, is columnar and compressed, and tells Catalyst its size, so that a later join is broadcast only when the table is
known to be small.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_local: list[str] = []
_held: list[Workspace] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where it is unset, a temporary one, but only in local mode."""
    said = spark.conf.get("spark.checkpoint.dir", None)
    if said:
        return said.rstrip("/")
    if not (spark.conf.get("spark.master", "") or "").startswith(("local[", "local")) or "cluster" in spark.conf.get("spark.master", ""):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="driftloom-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return f"file://{_local[0]}"


class Workspace:
    """A folder of written intermediate tables; ``drop`` removes one as soon as nothing reads it any more.

    What is left when the process ends is removed then, or by ``release``: results are lazy and may still read it until the caller has run them.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._kept: list[tuple[DataFrame, str]] = []
        if not _held:
            atexit.unregister(release)
            atexit.register(release)  # after the session's own, so that it runs while the session still lives
        _held.append(self)

    def write(self, df: DataFrame, sized: bool = False) -> str:
        """The path of the written table.

        :param sized: plain encoding, so that the files are about as large as the rows in memory. Spark takes the size of files for the size of rows when it decides
            on a broadcast; packed files would pass its threshold with many times the data that it allows.
        """
        self._n += 1
        path = f"{self.root}/t{self._n}"
        plain = {"compression": "none", "parquet.enable.dictionary": "false"}
        df.write.options(**(plain if sized else {"compression": "zstd"})).parquet(path)
        return path

    def count(self, df: DataFrame, sized: bool = False, **of: Column) -> tuple[str, dict[str, int]]:
        """The path of the written table and how many of its rows satisfy each condition (``rows``: all), counted by the writing tasks themselves, without another job."""
        seen = Observation()
        path = self.write(df.observe(seen, F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(k) for k, c in of.items())), sized)
        return path, seen.get

    def keep(self, df: DataFrame, sized: bool = False) -> DataFrame:
        """The same rows, read from a written table with the frame's own schema."""
        path = self.write(df, sized)
        kept = self.spark.read.schema(df.schema).parquet(path)
        self._kept.append((kept, path))
        return kept

    def forget(self, kept: DataFrame) -> None:
        """Removes the table of a frame that ``keep`` gave, once nothing reads it any more."""
        for path in [p for f, p in self._kept if f is kept]:
            self.drop(path)
        self._kept = [(f, p) for f, p in self._kept if f is not kept]

    def drop(self, path: str) -> None:
        self._remove(path)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may already be gone
            if path.startswith(("file:", "/")):
                shutil.rmtree(path.removeprefix("file:").replace("//", "/"), ignore_errors=True)


def release() -> None:
    """Removes all intermediate tables written so far. Results that were not run before can no longer be: for between the queries of a long session."""
    while _held:
        ws = _held.pop()
        ws._remove(ws.root)
