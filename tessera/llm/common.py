"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_own_root: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder that the driver and all executors can reach: ``spark.checkpoint.dir``.

    Where it is unset (tests on a local master) a folder of this machine is
    made and removed at exit; on a cluster an unset folder is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="tessera-")
        atexit.register(shutil.rmtree, made, ignore_errors=True)
        _own_root[app] = f"file://{made}"
    return _own_root[app]


def new_folder(spark: SparkSession, tag: str) -> str:
    """A path, not yet made, in the shared folder."""
    return f"{shared_root(spark)}/tessera-{tag}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, so that any store will do."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Staged:
    """Tables written in the shared folder; they cut lineage and outlive lost executors.

    ``done`` removes those that the caller no longer needs.  What a result is
    still to be read from stays until the folder is cleared.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.tag, self.paths = spark, tag, {}

    def __call__(self, df: DataFrame, name: str, rows: int = 1000) -> DataFrame:
        """Write ``df`` and read it again; ``rows`` go to Python in one batch, fewer where a row is large."""
        path = new_folder(self.spark, f"{self.tag}-{name}")
        before = self.spark.conf.get(_BATCH)
        self.spark.conf.set(_BATCH, str(rows))
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(_BATCH, before)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def done(self, *names: str) -> None:
        """Remove these tables, and let Spark's cleaner take the shuffle files that only their making needed."""
        for name in names:
            remove(self.spark, self.paths.pop(name))
        gc.collect()
        self.spark._jvm.System.gc()


#: What a worker process remembers from task to task, by operator: how to forget it.
MEMORIES: dict[str, Callable[[], None]] = {}


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, own: str = "") -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a task holds Python objects of few texts at a time.

    Workers serve one operator after the other: what others than ``own`` remember goes.
    """
    for name, forget in MEMORIES.items():
        if name != own:
            forget()
    pa.default_memory_pool().release_unused()
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks_for(spark: SparkSession) -> int:
    """How many tasks a keyed shuffle is dealt to: the session's own setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: str = "text"):
    """The text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def fold(column: str = "doc_id"):
    """crc32 of the id as text, modulo 5."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(5))
