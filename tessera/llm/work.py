"""Working tables in the folder that driver and executors share, and small helpers for plans."""

from __future__ import annotations

import ctypes
import math
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset, a folder of our own if all runs on one machine, else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        found = _own.get(app) or _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tessera-"))
    return found.rstrip("/")


class Work:
    """A folder for the intermediate tables of one run. Tables are written once, so a lost executor never costs more than a stage. It is deleted when the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.kept_path = path
        return out

    def forget(self) -> None:
        """Let Spark delete shuffle files of plans that have ended; it does when the driver's JVM collects them."""
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t.kept_path)
            path.getFileSystem(conf).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows and bytes of an Arrow batch, of which a worker holds a few copies: texts are long, and packed rows longer.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes, if they are larger."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows, "10000")) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    if spark.conf.get(size, "67108864b") in ("67108864b", "64MB", "64m"):
        spark.conf.set(size, f"{BATCH_BYTES}b")


RELEASE_SECONDS = 0.3


def release() -> None:
    """Give freed memory of this worker back to the system, which else counts against the executor through all later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, releasing memory at its end and between the batches that it puts out, RELEASE_SECONDS apart or more."""

    @wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = time.monotonic()
        for out in run(batches):
            yield out
            del out
            if time.monotonic() - last > RELEASE_SECONDS:
                release()
                last = time.monotonic()
        release()

    return wrapped


def by_bucket(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[list[pa.RecordBatch]]:
    """The rows of each value of column k of a partition that is sorted by it: a task works on one bucket at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        value = b.column(k).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(value)) + 1).tolist(), len(value)]
        for p, q in zip(edges, edges[1:], strict=False):
            if p < q and held and value[p] != now:
                yield held
                held = []
            if p < q:
                now = value[p]
                held.append(b.slice(p, q - p))
    if held:
        yield held


def buckets_for(spark: SparkSession, rows: int, rows_per_bucket: int) -> int:
    """A number of buckets that grows with the input and is never below the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), math.ceil(rows / rows_per_bucket))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
